"""Exact order statistics and quantiles of many columns at once, by counting in ever narrower ranges.

The first round counts every column's values by sign and power of two.  Each further round cuts the ranges in which a wanted
rank lies into ``PARTS`` equal parts and counts again, until a range has one value or few rows; those are looked at
themselves.  A range at least halves its parts' span, from one power of two on, so a few rounds are enough for any column.
Nothing grows with the number of distinct values: aggregates hold counts by range, the driver the ranges of wanted ranks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a range is cut into in a round; rows of a range from which on they are looked at themselves.
PARTS, FEW = 256, 2000


def power_of_two(x: Column) -> Column:
    """A number that never falls as ``x`` rises: its sign and, of its size, the power of two."""
    size = F.when(F.abs(x) == float("inf"), F.lit(3000)).otherwise(F.lit(1200) + F.floor(F.log2(F.abs(x))).cast("int"))
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size)


@dataclass
class _Range:
    """Values from ``low`` to ``high``: ``count`` of them, ``below`` smaller ones in the column."""

    low: float
    high: float
    below: int
    count: int

    def has(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.count


def _in_order(parts: list[tuple[float, float, int]], below: int) -> list[_Range]:
    out = []
    for low, high, n in sorted(parts):
        out.append(_Range(low, high, below, n))
        below += n
    return out


def order_statistics(values: DataFrame, ranks) -> dict[str, dict[int, float]]:
    """The values of given ranks, counted from 0, of each column of ``values`` (column, value; no null, no NaN).

    ``ranks`` is called with a column's name and number of values and gives the ranks wanted.
    """
    spark = values.sparkSession
    values = values.select("column", F.col("value").cast("double").alias("value"))
    counted = values.groupBy("column", power_of_two(F.col("value")).alias("power")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    first: dict[str, list[tuple[float, float, int]]] = {}
    for r in counted.collect():  # some thousand rows a column at most
        first.setdefault(r.column, []).append((r.low, r.high, r.n))
    wanted, found, open_ = {}, {}, {}
    for column, parts in first.items():
        wanted[column] = sorted(set(ranks(column, sum(n for _, _, n in parts))))
        found[column] = {}
        open_[column] = _narrowed(_in_order(parts, 0), wanted[column], found[column])
    while any(open_.values()):
        few = {c: [r for r in own if r.count <= FEW] for c, own in open_.items()}
        many = {c: [r for r in own if r.count > FEW] for c, own in open_.items()}
        if any(few.values()):
            rows = _inside(spark, values, few).groupBy("column", "at", "value").agg(F.count(F.lit(1)).alias("n"))
            held: dict[tuple[str, int], list[tuple[float, float, int]]] = {}
            for r in rows.collect():  # FEW values a range at most
                held.setdefault((r.column, r["at"]), []).append((r.value, r.value, r.n))
            for (c, i), parts in held.items():
                _narrowed(_in_order(parts, few[c][i].below), wanted[c], found[c])
        open_ = many
        if any(many.values()):
            inside = _inside(spark, values, many)
            share = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))
            part = F.least(F.floor(share * PARTS).cast("int"), F.lit(PARTS - 1))
            rows = inside.groupBy("column", "at", part.alias("part")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
            cut: dict[tuple[str, int], list[tuple[float, float, int]]] = {}
            for r in rows.collect():  # PARTS rows a range at most
                cut.setdefault((r.column, r["at"]), []).append((r.low, r.high, r.n))
            open_ = {c: [x for i, own in enumerate(many[c]) for x in _narrowed(_in_order(cut[c, i], own.below), wanted[c], found[c])] for c in many}
    return found


def _narrowed(ranges: list[_Range], ranks: list[int], found: dict[int, float]) -> list[_Range]:
    """The ranges that hold a wanted rank and several values; ranks of a single value are ``found``."""
    out = []
    for x in ranges:
        own = ranks[bisect_left(ranks, x.below) : bisect_left(ranks, x.below + x.count)]
        if own and x.low == x.high:
            found.update(dict.fromkeys(own, x.low))
        elif own:
            out.append(x)
    return out


def _inside(spark, values: DataFrame, ranges: dict[str, list[_Range]]) -> DataFrame:
    """(column, value, at, low, high): the values within a column's ranges, which are apart, and the number of their range."""
    rows = [(c, [(i, x.low, x.high) for i, x in enumerate(own)]) for c, own in ranges.items() if own]
    table = spark.createDataFrame(rows, "column string, ranges array<struct<at: int, low: double, high: double>>")
    own = F.get(F.filter("ranges", lambda r: (r["low"] <= F.col("value")) & (F.col("value") <= r["high"])), F.lit(0))
    return values.join(F.broadcast(table), "column").withColumn("own", own).where("own is not null").select("column", "value", "own.*")


def quantiles(values: DataFrame, shares: Iterable[float]) -> dict[str, list[float]]:
    """Exact quantiles of each column of ``values`` (column, value), interpolated between neighbours; no null, no NaN.

    A column without values is not in the result.
    """
    shares = list(shares)
    count: dict[str, int] = {}

    def ranks(column: str, n: int) -> list[int]:
        count[column] = n
        low = [int(s * (n - 1)) for s in shares]
        return [*low, *(min(r + 1, n - 1) for r in low)]

    found = order_statistics(values, ranks)
    return {c: [_between(found[c], s * (n - 1), n) for s in shares] for c, n in count.items()}


def _between(found: dict[int, float], at: float, n: int) -> float:
    low = int(at)
    a, b = found[low], found[min(low + 1, n - 1)]
    return a if a == b or at == low else (low + 1 - at) * a + (at - low) * b
