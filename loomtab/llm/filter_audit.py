"""Interaction audit of five document filters: what each order removes where, and each filter's Shapley value.

A document fails a set of filters, its *mask*.  For one part of the corpus the number of documents that a set of filters
removes is a game over filters, and its multilinear extension is the *removal polynomial*

    f(x) = sum over masks m of n[m] * (1 - product of (1 - x_i) over i in m),

whose coefficients follow from the mask counts.  At a corner of the cube (x_i is 1 for the filters applied so far) it is
the number of removed documents, so differences of corners are what a step removes.  The integral of the partial
derivative by x_i along the diagonal is the Shapley value of filter i, a rational number; times 120 it is the sum over all
120 orders of what the filter removes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import cut, prepare

#: The filters in order of their bits.
FILTERS = "ABCDE"
_SPACE = " \t\n\x0b\x0c\r"


def failures(text: Column) -> list[tuple[str, Column]]:
    """(letter, condition) of the filters that a text alone decides; ``text`` is not null."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        ("A", F.size(words) < 50),
        ("B", F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(65) * F.size(words).cast("long")),
        ("C", F.lit(100) * capitals.cast("long") > F.lit(5) * F.length(text).cast("long")),
        ("D", text.rlike(r"[#$%&*|]")),
    ]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask, good, toxic) of each row; the mask is without the filter for repeated texts.

    A null text is empty, a null source the empty string.  A document is good or toxic if any of its rows in ``labels``
    says so; one without an id has no labels.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(fails, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0)) for letter, fails in failures(text)]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(text)).alias("digest"), mask.alias("mask"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    nameless = rows.where("doc_id is null").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    return marked.unionByName(nameless).fillna(False, ["good", "toxic"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each set of failed filters, and how many of them are good or toxic.

    A row repeats an earlier text if any row of the same text has a smaller doc_id: all rows but those that hold their
    text's smallest id.  Rows of equal id and text are equally early; a row without an id neither repeats nor is repeated.
    So the rows that do not repeat are found by a join on text and id together, which no large group of copies can
    make one task's work, and the others are what is left of all rows.
    """
    rows = cut(masks(docs, labels))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    early = rows.join(firsts, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null").select("digest", "doc_id", "part", "mask", "good", "toxic"))
    keys, repeats = ("part", "mask", "good", "toxic"), 1 << FILTERS.index("E")
    # a few rows for each part: all of them under the mask with E, then the early ones moved over to the mask without
    every = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("mask", F.col("mask") + repeats)
    kept = early.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    moved = kept.unionByName(kept.withColumns({"mask": F.col("mask") + repeats, "n": -F.col("n")}))
    counted = every.unionByName(moved).groupBy("part", "mask")
    found = counted.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    return found.where("n > 0")


class RemovalPolynomial:
    """The multilinear extension of "documents removed by a set of filters", by its integer coefficients.

    ``counts[m]`` is the number of documents whose failed filters are the bits of m.  The coefficient of the product of x_i
    over i in T is the signed number of documents that fail all of T.
    """

    def __init__(self, counts: Sequence[int]):
        self.size = len(counts).bit_length() - 1
        above = [int(c) for c in counts]
        for bit in range(self.size):
            for m in range(len(above)):
                if not m >> bit & 1:
                    above[m] += above[m | 1 << bit]
        self.total = above[0]
        self.coefficients = [0, *(above[t] if t.bit_count() % 2 else -above[t] for t in range(1, len(above)))]

    def corner(self, applied: int) -> int:
        """Documents removed once the filters of ``applied`` have run."""
        return sum(a for t, a in enumerate(self.coefficients) if t & applied == t)

    def corners(self) -> list[int]:
        return [self.corner(s) for s in range(len(self.coefficients))]

    def derivative_on_diagonal(self, i: int) -> list[int]:
        """Coefficients, from the constant on, of the partial derivative by x_i where all variables are t."""
        out = [0] * self.size
        for t, a in enumerate(self.coefficients):
            if t >> i & 1:
                out[t.bit_count() - 1] += a
        return out

    def shapley(self, i: int) -> Fraction:
        return sum((Fraction(a, power + 1) for power, a in enumerate(self.derivative_on_diagonal(i))), Fraction(0))


_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_LETTER = np.array([[FILTERS.index(c) for c in o] for o in _ORDERS])
_AFTER = np.cumsum(1 << _LETTER, axis=1)
_BEFORE = _AFTER - (1 << _LETTER)


def audit_part(part: str, n: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> dict:
    """All orders and steps of one part from its counts by mask, as columns."""
    removal = RemovalPolynomial(n)
    removed, lost_good, lost_toxic = (np.array(p.corners(), np.int64) for p in (removal, RemovalPolynomial(good), RemovalPolynomial(toxic)))
    whole = (1 << len(FILTERS)) - 1
    fails = np.array([removal.corner(1 << i) for i in range(len(FILTERS))])
    alone = np.array([removal.corner(whole) - removal.corner(whole - (1 << i)) for i in range(len(FILTERS))])
    values = [removal.shapley(i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    if any(v.denominator != 1 for v in values):
        raise ArithmeticError("a sum over all orders must be whole")
    step = removed[_AFTER] - removed[_BEFORE]
    orders, steps = len(_ORDERS), len(FILTERS)
    columns = {
        "kept": removal.total - removed[_AFTER], "removed": step, "redundant": fails[_LETTER] - step, "unique_fails": alone[_LETTER],
        "good_lost": lost_good[_AFTER] - lost_good[_BEFORE], "toxic_lost": lost_toxic[_AFTER] - lost_toxic[_BEFORE], "shapley": np.array([int(v) for v in values])[_LETTER],
    }
    named = {"part": [part] * orders * steps, "filter_order": np.repeat(_ORDERS, steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), orders)}
    return named | {k: v.reshape(-1) for k, v in columns.items()}


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic; other columns are not read.  An empty
    table has no parts and gives no rows.  A part's counts, at most 32 masks, are one row when they are audited.
    """
    spark = prepare(docs.sparkSession)
    size = 1 << len(FILTERS)
    by_mask = mask_counts(docs, labels).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))

    def dense(k: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[k], F.lit(0).cast("long"))).alias(k)

    spread = by_mask.select("part", *map(dense, ("n", "good", "toxic")))

    def audited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame(audit_part(r.part, r.n, r.good, r.toxic))

    return spread.mapInPandas(audited, _RESULT)


def op13_shapley_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over the whole of ``documents``, for each source."""
    return filter_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_SQL = r"""
with marks as (
    select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as toxic from labels where doc_id is not null group by doc_id
), base as (
    select d.doc_id, coalesce(d.source, '') as part, coalesce(d.text, '') as t, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic
    from documents d left join marks m on d.doc_id = m.doc_id
), worded as (
    select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from base
), failing as (
    select part, good, toxic,
        {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
         'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(doc_id > least, false)} as f
    from worded
), flags as (
    select part, good, toxic, f.A::int as a, f.B::int as b, f.C::int as c, f.D::int as d, f.E::int as e from failing
), counted as (
    select part, a, b, c, d, e, count(*) as n, sum(good) as good, sum(toxic) as toxic from flags group by all
), letters as (
    select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order from letters p, letters q, letters r, letters s, letters t
    where len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps as (
    select filter_order, s.step::int as step, filter_order[s.step] as own, filter_order[1:s.step - 1] as earlier from orders, generate_series(1, 5) as s(step)
), placed as (
    select k.part, s.filter_order, s.step, k.n, k.good, k.toxic,
        (case s.own when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end) as own_fails,
        (a * contains(s.earlier, 'A')::int + b * contains(s.earlier, 'B')::int + c * contains(s.earlier, 'C')::int + d * contains(s.earlier, 'D')::int + e * contains(s.earlier, 'E')::int) as failed_before,
        a + b + c + d + e as failed, s.own
    from counted k, steps s
), summed as (
    select part, filter_order, step, own,
        sum(case when own_fails = 0 and failed_before = 0 then n else 0 end)::bigint as kept,
        sum(case when own_fails = 1 and failed_before = 0 then n else 0 end)::bigint as removed,
        sum(case when own_fails = 1 and failed_before > 0 then n else 0 end)::bigint as redundant,
        sum(case when own_fails = 1 and failed = 1 then n else 0 end)::bigint as unique_fails,
        sum(case when own_fails = 1 and failed_before = 0 then good else 0 end)::bigint as good_lost,
        sum(case when own_fails = 1 and failed_before = 0 then toxic else 0 end)::bigint as toxic_lost
    from placed group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint as shapley
from summed
"""

QUERIES = {"op13_shapley_audit": op13_shapley_audit}
ORACLES = {"op13_shapley_audit": _SQL}
