"""Column roles from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _DATES)]


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns of both frames, by name."""
    return sorted(set(left.columns) & set(right.columns))


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def as_number(name: str) -> Column:
    """The column as double; null where it is null or NaN."""
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def unpivoted(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value): the numbers of the columns, a row each; nulls and NaN left out."""
    entries = F.array(*[F.struct(F.lit(n).alias("column"), as_number(n).alias("value")) for n in names])
    return df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it one that no column has."""
    while name in df.columns:
        name += "_"
    return name
