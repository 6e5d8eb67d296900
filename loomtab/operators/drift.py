"""Two-sample drift: Kolmogorov-Smirnov, chi-squared, PSI and a classifier between the samples.

All columns go through one unpivoted job: a row per (column, side, value), grouped by value before anything is
ordered, so that a window sees distinct values only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import psi_level
from ..functions.special import chi2_p_value, ks_p_value
from ..schema import as_number, col, common_columns, numeric_columns
from .quantiles import quantiles

ALPHA, BINS, FLOOR, SEPARABLE = 0.05, 10, 1e-6, 0.7


def _unpivot(df: DataFrame, columns: list[str], side: int, value) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("e")).select("e.column", "e.value", F.lit(side).alias("side")).where("value is not null")


def unpivot_numbers(reference: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, side): reference 0, live 1; nulls and NaN left out."""
    return _unpivot(reference, columns, 0, as_number).unionByName(_unpivot(live, columns, 1, as_number))


def numeric_common(reference: DataFrame, live: DataFrame) -> list[str]:
    return [c for c in common_columns(reference, live) if c in numeric_columns(reference) and c in numeric_columns(live)]


def ks_statistics(reference: DataFrame, live: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, d, n_ref, n_live); d is null if a side is empty."""
    columns = numeric_common(reference, live) if columns is None else columns
    values = unpivot_numbers(reference, live, columns).groupBy("column", "value").agg(F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("l"))
    # running counts: totals of value ranges first, so that no column has to fit into one task
    upto = Window.partitionBy("column", "part").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = _with_value_ranges(values)
    parts = ranged.groupBy("column", "part").agg(F.sum("r").alias("pr"), F.sum("l").alias("pl"))
    over = Window.partitionBy("column").orderBy("part")
    base = parts.select("column", "part", (F.sum("pr").over(over) - F.col("pr")).alias("br"), (F.sum("pl").over(over) - F.col("pl")).alias("bl"), F.sum("pr").over(Window.partitionBy("column")).alias("n_ref"), F.sum("pl").over(Window.partitionBy("column")).alias("n_live"))
    run = ranged.withColumns({"cr": F.sum("r").over(upto), "cl": F.sum("l").over(upto)}).join(F.broadcast(base), ["column", "part"])
    gap = F.abs(F.try_divide(F.col("br") + F.col("cr"), F.col("n_ref")) - F.try_divide(F.col("bl") + F.col("cl"), F.col("n_live")))
    return run.groupBy("column").agg(F.max(gap).alias("d"), F.max("n_ref").alias("n_ref"), F.max("n_live").alias("n_live"))


#: Ranges of values that the running counts of a column are cut into.
VALUE_RANGES = 64


def _with_value_ranges(values: DataFrame) -> DataFrame:
    """Add ``part``: the value's range between approximate quantiles of its column, ascending."""
    cuts = values.groupBy("column").agg(F.percentile_approx("value", [i / VALUE_RANGES for i in range(1, VALUE_RANGES)], 1000).alias("cuts"))
    return values.join(F.broadcast(cuts), "column").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")


def category_counts(reference: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, r, l): counts of each category on both sides, 0 where it is missing."""
    text = lambda c: col(c).cast("string")
    both = _unpivot(reference, columns, 0, text).unionByName(_unpivot(live, columns, 1, text))
    return both.groupBy("column", "value").agg(F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("l"))


def chi2_statistics(reference: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """(column, statistic, dof): homogeneity of category counts; with two categories, Yates-corrected."""
    counts = category_counts(reference, live, columns)
    totals = counts.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("l").alias("nl"), F.count(F.lit(1)).alias("k"))
    both = counts.join(F.broadcast(totals), "column")

    def term(seen: str, size: str) -> Column:
        expected = (F.col("r") + F.col("l")) * F.col(size) / (F.col("nr") + F.col("nl"))
        off = F.abs(F.col(seen) - expected)
        off = F.when(F.col("k") == 2, off - F.least(F.lit(0.5), off)).otherwise(off)
        return F.try_divide(off * off, expected)

    return both.groupBy("column").agg(F.sum(term("r", "nr") + term("l", "nl")).alias("statistic"), (F.max("k") - 1).alias("dof"), F.max("nr").alias("n_ref"), F.max("nl").alias("n_live"))


@dataclass(frozen=True)
class ColumnDrift:
    column: str
    test_used: str
    p_value: float
    drift_detected: bool


@dataclass(frozen=True)
class DriftReport:
    columns: list[ColumnDrift]

    @property
    def drift_detected(self) -> bool:
        return any(c.drift_detected for c in self.columns)

    @property
    def n_drifted(self) -> int:
        return sum(c.drift_detected for c in self.columns)


def drift_report(reference: DataFrame, live: DataFrame, alpha: float = ALPHA) -> DriftReport:
    """KS for numeric, chi-squared for other common columns; a side without values gives p = 1."""
    number = numeric_common(reference, live)
    other = [c for c in common_columns(reference, live) if c not in number]
    p: dict[str, tuple[str, float]] = {c: ("ks", 1.0) for c in number} | {c: ("chi2", 1.0) for c in other}
    if number:
        for r in ks_statistics(reference, live, number).collect():
            p[r.column] = "ks", ks_p_value(r.d, r.n_ref, r.n_live)
    if other:
        for r in chi2_statistics(reference, live, other).collect():
            p[r.column] = "chi2", chi2_p_value(r.statistic, r.dof) if r.n_ref and r.n_live else 1.0
    return DriftReport([ColumnDrift(c, test, round(v, 6), v < alpha) for c, (test, v) in sorted(p.items())])


def psi_bins(reference: DataFrame, live: DataFrame, columns: list[str] | None = None, bins: int = BINS, accuracy: int | None = None) -> DataFrame:
    """(column, bin, r, l): counts between pooled quantiles; bin i is from the i-th inner edge on.

    Edges are exact, by ``quantiles``, unless ``accuracy`` asks for those of a sketch in one pass.
    """
    columns = numeric_common(reference, live) if columns is None else columns
    values = unpivot_numbers(reference, live, columns)
    inner = [i / bins for i in range(1, bins)]
    if accuracy:
        edges = values.groupBy("column").agg(F.percentile_approx("value", inner, accuracy).alias("edges"))
    else:
        edges = reference.sparkSession.createDataFrame(list(quantiles(values, inner).items()), "column string, edges array<double>")
    placed = values.join(F.broadcast(edges), "column").withColumn("bin", F.size(F.filter("edges", lambda e: F.col("value") >= e)))
    return placed.groupBy("column", "bin").agg(F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("l"))


def psi_report(reference: DataFrame, live: DataFrame, columns: list[str] | None = None, bins: int = BINS, accuracy: int | None = None) -> DataFrame:
    """(column, psi, level) of every common numeric column with values; 0 if a side is empty."""
    counts = psi_bins(reference, live, columns, bins, accuracy)
    whole = Window.partitionBy("column")
    share = counts.withColumns({"nr": F.sum("r").over(whole), "nl": F.sum("l").over(whole)})
    p, q = (F.greatest(F.try_divide(F.col(a), F.col(b)), F.lit(FLOOR)) for a, b in (("r", "nr"), ("l", "nl")))
    one = F.when((F.col("nr") > 0) & (F.col("nl") > 0), (q - p) * F.log(q / p)).otherwise(0.0)
    psi = share.groupBy("column").agg(F.round(F.sum(one), 6).alias("psi"))
    return psi.withColumn("level", psi_level(F.col("psi")))


#: Ranges of the hash order in which rows are numbered for folds.
HASH_RANGES = 256


def domain_auc(reference: DataFrame, live: DataFrame, cap: int = 10_000, folds: int = 5, seed: int = 42) -> float:
    """Mean cross-validated ROC-AUC of a logistic regression that tells live from reference rows; 0.5 without numbers.

    Equal rows are counted together, and each of them is dealt to folds by itself.  A model is fitted on at most
    ``cap`` rows of each side, every n-th row of a fold in hash order, so that a value set has its share of the sample
    to within a row a fold; the AUC is over all rows of the fold left out.
    """
    from .metrics import roc_auc
    from .models import logistic

    columns = numeric_common(reference, live)
    if not columns:
        return 0.5
    names = [col(c) for c in columns]
    clean = [df.select(*[as_number(c).alias(c) for c in columns]).dropna().withColumn("_side", F.lit(side)) for side, df in ((0, reference), (1, live))]
    groups = clean[0].unionByName(clean[1]).groupBy(*names, "_side").agg(F.count(F.lit(1)).alias("_n"))
    hashed = groups.withColumn("_h", F.xxhash64(F.lit(seed), *names)).withColumn("_part", F.pmod("_h", F.lit(HASH_RANGES)).cast("int")).cache()
    try:
        base, total = [], [0, 0]  # at most HASH_RANGES rows of each side
        for r in sorted(hashed.groupBy("_side", "_part").agg(F.sum("_n").alias("n")).collect()):
            base.append((r["_side"], r["_part"], total[r["_side"]]))
            total[r["_side"]] += r["n"]
        least = min(*total, cap)
        if least < 2:
            return 0.5
        k = min(folds, least)
        upto = F.sum("_n").over(Window.partitionBy("_side", "_part").orderBy("_h", *names))
        bases = reference.sparkSession.createDataFrame(base, "_side int, _part int, _base long")
        placed = hashed.withColumn("_upto", upto).join(F.broadcast(bases), ["_side", "_part"]).withColumn("_upto", F.col("_base") + F.col("_upto"))
        # the rows of a side are numbered; row p is row p div k of fold p mod k
        each = placed.withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        before = lambda p: F.expr(f"({p} - _fold + {k - 1}) div {k}")
        size = F.when(F.col("_side") == 0, F.lit(total[0])).otherwise(F.lit(total[1]))
        each = each.withColumns({"_from": before("(_upto - _n)"), "_to": before("_upto"), "_size": size}).withColumn("_size", before("_size")).where("_to > _from")
        quota = F.lit(cap // k) + (F.col("_fold") < cap % k).cast("int")
        each = each.withColumn("_quota", F.least(quota.cast("long"), "_size")).withColumns({"_rows": F.col("_to") - F.col("_from"), "_take": F.expr("(_to * _quota) div _size - (_from * _quota) div _size")})
        rows = each.select(*names, "_side", "_fold", "_rows", "_take").cache()
        try:
            sample = rows.where("_take > 0").select(*names, "_side", "_fold", F.explode(F.sequence(F.lit(1).cast("long"), "_take"))).drop("col")
            found = []
            for f in range(k):
                scored = logistic()(sample.where(F.col("_fold") != f), columns, "_side")(rows.where(F.col("_fold") == f))
                found.append(roc_auc(scored.withColumn("_s", F.get("probability", F.lit(1))), "_side", "_s", "_rows").first()[0])
            return sum(found) / k
        finally:
            rows.unpersist()
    finally:
        hashed.unpersist()


def detect(reference: DataFrame, live: DataFrame, method: str = "ks") -> dict:
    """By ``ks``, ``psi``, ``domain_classifier``, or ``both`` (PSI or the classifier)."""
    if method == "ks":
        report = drift_report(reference, live)
        return {"method": method, "drift_detected": report.drift_detected, "columns": report.columns}
    out: dict = {"method": method, "drift_detected": False}
    if method in ("psi", "both"):
        rows = psi_report(reference, live).orderBy("column").collect()
        out |= {"psi": {r.column: r.psi for r in rows}, "moderate": sum(r.level == "moderate" for r in rows), "severe": sum(r.level == "severe" for r in rows)}
        out["drift_detected"] = out["severe"] > 0
    if method in ("domain_classifier", "both"):
        out["auc"] = domain_auc(reference, live)
        out["drift_detected"] |= out["auc"] > SEPARABLE
    if len(out) == 2:
        raise ValueError(f"unknown drift method {method}")
    return out
