"""Class labels of any type as codes from 0, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import col

#: Distinct values up to which a target is taken for a class.
MOST_CLASSES = 1000


class LabelError(ValueError):
    """A target that can't be a class."""


@dataclass(frozen=True)
class Labels:
    """The values of ``column``, of type ``kind``, as strings in ascending order of the values; code i is the i-th."""

    column: str
    kind: str
    values: list[str]

    def encode(self, df: DataFrame) -> DataFrame:
        """The rows whose target has a known value, with its code in the target's place."""
        known = F.array(*map(F.lit, self.values)) if self.values else F.array().cast("array<string>")
        at = F.array_position(known, col(self.column).cast("string"))
        return df.withColumn(self.column, (at - 1).cast("int")).where(col(self.column) >= 0)

    def decode(self, code: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.values)), code.cast("int")).cast(self.kind)


def fit_labels(df: DataFrame, target: str) -> Labels:
    """All values of the target in their own order; null is no class."""
    found = df.select(col(target).alias("v")).where(col(target).isNotNull()).distinct().select("v", F.col("v").cast("string").alias("s")).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise LabelError(f"{target} has over {MOST_CLASSES} values")
    return Labels(target, dict(df.dtypes)[target], [r.s for r in sorted(found, key=lambda r: r.v)])
