"""Preparation: column checks, imputation, dates, target orientation and category codes as fitted transforms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import as_number, categorical_columns, col, date_columns, free_name, numeric_columns, unpivoted
from .quantiles import quantiles
from .splits import range_of, value_codes


class PrepError(ValueError):
    """A frame or setting that preparation can't work with."""


def drop_columns(df: DataFrame, names: list[str], target: str | None = None) -> DataFrame:
    """Without ``names``; an unknown name or the target among them is an error."""
    if unknown := [n for n in names if n not in df.columns]:
        raise PrepError(f"no such columns: {unknown}")
    if target in names:
        raise PrepError(f"{target} is the target")
    return df.drop(*names)


def medians(df: DataFrame, names: list[str], accuracy: int | None = None) -> dict[str, float | None]:
    """Exact medians of numeric columns, by ``quantiles``; with ``accuracy`` those of a sketch in one pass."""
    if not names:
        return {}
    if accuracy:
        row = df.agg(*[F.percentile_approx(as_number(n), 0.5, accuracy).alias(str(i)) for i, n in enumerate(names)]).first()
        return {n: row[i] for i, n in enumerate(names)}
    found = quantiles(unpivoted(df, names), [0.5])
    return {n: found[n][0] if n in found else None for n in names}


def modes(df: DataFrame, names: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column, the smallest of equally frequent ones; nulls don't count."""
    if not names:
        return {}
    # one shuffle for all columns: (column, value) counts, then the best of each column
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(n).cast("string").alias("v")) for i, n in enumerate(names)])).alias("p")).select("p.*").where("v is not null")
    best = pairs.groupBy("c", "v").count().groupBy("c").agg(F.min(F.struct(-F.col("count"), "v")).alias("m"))
    found = {r.c: r.m["v"] for r in best.collect()}
    return {n: found.get(i) for i, n in enumerate(names)}


def date_parts(df: DataFrame, names: list[str]) -> DataFrame:
    """Year, month, day and ISO weekday in place of each date; the prefix is its name without _date and _dt."""
    if not names:
        return df
    parts: list[Column] = []
    for n in names:
        prefix = n.replace("_date", "").replace("_dt", "")
        parts += [F.year(col(n)).alias(f"{prefix}_year"), F.month(col(n)).alias(f"{prefix}_month"), F.dayofmonth(col(n)).alias(f"{prefix}_day"), (F.weekday(col(n)) + 1).alias(f"{prefix}_weekday")]
    return df.select(*[col(c) for c in df.columns if c not in names], *parts)


def orient_target(df: DataFrame, target: str, positive: str) -> DataFrame:
    """Target 1 where it is ``positive``, else 0, null included; the target must have two values, null counted."""
    values = {r[0] for r in df.select(col(target).cast("string")).distinct().limit(3).collect()}
    if positive not in values:
        raise PrepError(f"{positive} is no value of {target}")
    if len(values) != 2:
        raise PrepError(f"{target} is not binary")
    return df.withColumn(target, F.when(col(target).cast("string") == positive, 1).otherwise(0))


def category_codes(df: DataFrame, name: str, code: str) -> DataFrame:
    """A table (value, code) of the column's values in ascending order, from 0."""
    return value_codes(df, name, name, code)


@dataclass(frozen=True)
class PrepModel:
    """What preparation learned.  ``transform`` is expressions; codes of large columns come by a join.

    ``codes`` has the values in ascending order; ``tables`` has (value, code) of large columns and their number of values.
    """

    drops: list[str]
    fills: dict[str, float | None]
    tops: dict[str, str | None]
    dates: list[str]
    codes: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns: the others, then numeric, then categorical ones, then date parts."""
        df = df.drop(*self.drops)
        rest = [c for c in df.columns if c not in self.fills and c not in self.tops]
        number = [F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None).cast("double")), F.lit(v)).alias(c) for c, v in self.fills.items() if c in df.columns]
        text = []
        for i, (c, top) in enumerate(self.tops.items()):
            if c not in df.columns:
                continue
            filled = F.coalesce(col(c), F.lit(top))
            if c in self.tables:
                table, n = self.tables[c]
                value, code = (free_name(df, f"_{x}{i}") for x in "vc")
                df = df.join(table.select(F.col("value").alias(value), F.col("code").alias(code)), filled == F.col(value), "left")
                filled = F.when(filled.isNotNull(), F.coalesce(F.col(code), F.lit(n)).cast("int"))
            if c in self.codes:
                # the last known value that isn't greater, if it is equal; unseen values get the next code
                known = F.array(*[F.lit(v) for v in self.codes[c]]) if self.codes[c] else F.array().cast("array<string>")
                at = range_of(filled, self.codes[c]) - 1
                filled = F.when(filled.isNotNull(), F.when(F.coalesce(F.get(known, at) == filled, F.lit(False)), at).otherwise(F.lit(len(self.codes[c]))).cast("int"))
            text.append(filled.alias(c))
        return date_parts(df.select(*[col(c) for c in rest], *number, *text), [d for d in self.dates if d in df.columns])


    def release(self) -> None:
        """Give up the cached code tables, when nothing is transformed any more; they would be made anew."""
        for table, _ in self.tables.values():
            table.unpersist()


#: Distinct values up to which a category column is coded by an inline table.
INLINE_CODES = 1000


def fit_prep(df: DataFrame, target: str | None = None, ignore: list[str] | None = None, encode: bool = True, accuracy: int | None = None) -> PrepModel:
    """Learn fills and codes from ``df`` (the training rows).  The target is left alone.

    Columns of over ``INLINE_CODES`` values are coded alike, by a cached table and a join.
    """
    drop_columns(df, ignore or [], target)
    df = df.drop(*(ignore or []))
    number = [c for c in numeric_columns(df) if c != target]
    text = [c for c in categorical_columns(df) if c != target]
    codes, tables = {}, {}
    if encode and text:
        sizes = df.agg(*[F.approx_count_distinct(col(c)).alias(str(i)) for i, c in enumerate(text)]).first()
        for i, c in enumerate(text):
            if sizes[i] <= INLINE_CODES:
                codes[c] = sorted(r[0] for r in df.select(col(c)).where(col(c).isNotNull()).distinct().collect())
            else:
                values = df.select(col(c).alias("value")).where("value is not null").distinct()
                table = value_codes(values, "value").cache()
                tables[c] = table, table.count()
    return PrepModel(ignore or [], medians(df, number, accuracy), modes(df, text), [c for c in date_columns(df) if c != target], codes, tables)
