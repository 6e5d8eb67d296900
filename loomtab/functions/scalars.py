"""Scalar expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A divisor nearer to 0 gives 0.
TINY = 1e-10


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is almost 0 or the result is NaN or infinite."""
    a, b = a.cast("double"), b.cast("double")
    r = F.when(F.abs(b) > TINY, F.try_divide(a, b)).otherwise(0.0)
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")), 0.0).otherwise(r)


def multiply(a: Column, b: Column) -> Column:
    return a.cast("double") * b.cast("double")


def psi_level(psi: Column) -> Column:
    """severe over 0.30, moderate over 0.20, else none."""
    return F.when(psi > 0.30, "severe").when(psi > 0.20, "moderate").otherwise("none")


def normal_name(text: str) -> str:
    """Lower-case ASCII letters and digits, else _, at most 64, a letter first."""
    name = re.sub(r"[^a-z0-9]", "_", text.lower())[:64]
    return name if name[:1].isalpha() else f"n{name}"[:64]


def timestamp_or_least(c: Column) -> Column:
    """An ISO timestamp, the earliest one where it can't be read."""
    return F.coalesce(F.try_to_timestamp(c), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def yeo_johnson(y: Column, lam: float) -> Column:
    up = F.log1p(y) if abs(lam) < 1e-12 else (F.pow(y + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-y) if abs(lam - 2) < 1e-12 else -(F.pow(1 - y, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(y >= 0, up).otherwise(down)


def yeo_johnson_inverse(z: Column, lam: float) -> Column:
    up = F.expm1(z) if abs(lam) < 1e-12 else F.pow(z * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-z) if abs(lam - 2) < 1e-12 else 1 - F.pow(1 - (2 - lam) * z, F.lit(1 / (2 - lam)))
    return F.when(z >= 0, up).otherwise(down)


def box_cox(y: Column, lam: float) -> Column:
    return F.log(y) if abs(lam) < 1e-12 else (F.pow(y, F.lit(lam)) - 1) / lam


def box_cox_inverse(z: Column, lam: float) -> Column:
    return F.exp(z) if abs(lam) < 1e-12 else F.pow(z * lam + 1, F.lit(1 / lam))
