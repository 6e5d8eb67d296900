"""Profiles, declared contracts and pre-flight checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import col, date_columns, numeric_columns, unpivoted
from .quantiles import quantiles


def _wide(df: DataFrame, exprs: dict[str, dict[str, F.Column]]) -> DataFrame:
    """One aggregate row turned into a row per column: ``exprs[column][name]``."""
    names = list(next(iter(exprs.values())))
    row = df.agg(*[e.alias(f"{i}_{n}") for i, c in enumerate(exprs) for n, e in exprs[c].items()])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in names]) for i, c in enumerate(exprs)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_null, null_ratio) in one pass; the ratio of an empty table is 0."""
    rows = F.greatest(F.count(F.lit(1)), F.lit(1))
    return _wide(df, {c: {"n_null": (n := F.count_if(col(c).isNull())), "null_ratio": n / rows} for c in columns or df.columns})


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_unique); null counts as a value.  Exact counts shuffle every value once: no column is expanded."""
    columns = columns or df.columns
    if approximate:
        return _wide(df, {c: {"n_unique": F.approx_count_distinct(col(c)) + F.max(col(c).isNull().cast("long"))} for c in columns})
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in columns])).alias("e")).select("e.*")
    return pairs.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column, nulls left out."""
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame) -> DataFrame:
    """(column, n, n_null, mean, std, min, q25, q50, q75, max) of the numeric columns; quartiles exact, without NaN."""
    names = numeric_columns(df)
    quartiles = quantiles(unpivoted(df, names), [0.25, 0.5, 0.75]) if names else {}
    return _wide(
        df,
        {
            c: {
                "n": F.count(x := col(c).cast("double")),
                "n_null": F.count_if(x.isNull()),
                "mean": F.avg(x),
                "std": F.stddev_samp(x),
                "min": F.min(x),
                **{f"q{q}": F.max(F.lit(v).cast("double")) for q, v in zip((25, 50, 75), quartiles.get(c, [None] * 3), strict=True)},
                "max": F.max(x),
            }
            for c in names
        },
    )


def high_cardinality(df: DataFrame, target: str | None = None, over: int = 50) -> list[str]:
    """String and integer columns of more than ``over`` distinct values, null counted; the target left out."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)
    names = [f.name for f in df.schema if isinstance(f.dataType, whole) and f.name != target]
    if not names:
        return []
    counts = {r.column: r.n_unique for r in distinct_counts(df, names).collect()}
    return [n for n in names if counts.get(n, 0) > over]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``n_duplicates``, all rows that have an equal one."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_duplicates"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of every key that stands in more than one row."""
    return df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class ContractError(ValueError):
    """A table that breaks its contract; ``problems`` lists how."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


#: Names of types as contracts spell them, beside Spark's own.
TYPE_NAMES = {"int64": "bigint", "int32": "int", "int16": "smallint", "int8": "tinyint", "float64": "double", "float32": "float", "string": "string", "utf8": "string", "bool": "boolean", "date": "date", "datetime": "timestamp_ntz"}


@dataclass(frozen=True)
class Contract:
    """Required columns with types, unique keys, and largest null ratios (``default`` for columns not named)."""

    required: dict[str, str] = field(default_factory=dict)
    unique: list[str] = field(default_factory=list)
    null_ratio: dict[str, float] = field(default_factory=dict)

    def problems(self, df: DataFrame) -> list[str]:
        types, found = dict(df.dtypes), []
        for name, want in self.required.items():
            if name not in types:
                found.append(f"missing column {name}")
            elif types[name] not in (want.lower(), TYPE_NAMES.get(want.lower())):
                found.append(f"{name} is {types[name]}, not {want}")
        if self.unique and not (missing := set(self.unique) - set(types)):
            if repeated := repeated_keys(df, self.unique).count():
                found.append(f"{repeated} keys {self.unique} repeat")
        elif self.unique:
            found.append(f"missing key columns {sorted(missing)}")
        limits = {c: self.null_ratio.get(c, self.null_ratio.get("default")) for c in df.columns}
        limits = {c: v for c, v in limits.items() if v is not None}
        if limits:
            for r in null_counts(df, list(limits)).collect():
                if r.null_ratio > limits[r.column]:
                    found.append(f"{r.column}: {r.null_ratio:.4f} null, over {limits[r.column]}")
        return found

    def check(self, df: DataFrame) -> None:
        if found := self.problems(df):
            raise ContractError(found)


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    column: str | None
    message: str


_ID_HINTS = ("id", "uuid", "guid", "key", "index")


def preflight(df: DataFrame, target: str, task: str, ignore: list[str] | None = None, positive: str | None = None, strategy: str = "kfold", folds: int = 5) -> list[Issue]:
    """What would spoil a training run, most severe first; task is ``classification`` or ``regression``.

    One aggregate over all columns and one count of the target's values.
    """
    out: list[Issue] = []
    add = lambda severity, code, column, message: out.append(Issue(severity, code, column, message))
    for name in ignore or []:
        if name == target:
            add("error", "ignored_target", name, "the target is ignored")
        elif name not in df.columns:
            add("error", "unknown_column", name, "no such column to ignore")
    if target not in df.columns:
        add("error", "missing_target", target, "no such target")
        return out
    if folds < 2:
        add("error", "few_folds", None, "fewer than 2 folds")
    kept = [c for c in df.columns if c not in (ignore or [])]
    stats = {r.column: r for r in _wide(df, {c: {"rows": F.count(F.lit(1)), "nulls": F.count_if(col(c).isNull()), "values": F.approx_count_distinct(col(c), 0.01)} for c in {*kept, target}}).collect()}
    rows = stats[target].rows
    unique = {r.column: r.n_unique for r in distinct_counts(df, [target]).collect()}.get(target, 0)
    if stats[target].nulls:
        add("error", "null_target", target, f"{stats[target].nulls} null labels")
    if unique <= 1:
        add("error", "constant_target", target, "the target has one value")
    kind = df.schema[target].dataType
    if task == "classification":
        counts = sorted(r.n for r in value_counts(df, target).orderBy("n").limit(1).collect())
        rarest = counts[0] if counts else 0
        if positive is not None:
            seen = {str(r[0]) for r in df.select(col(target).cast("string")).distinct().limit(3).collect()}
            if positive not in seen and df.where(col(target).cast("string") == positive).isEmpty():
                add("error", "missing_positive", target, f"{positive} is no value")
            elif unique != 2:
                add("error", "not_binary", target, "a positive class needs two values")
            else:
                add("info", "positive_class", target, f"{positive} counts as 1")
        if unique > 20 and isinstance(kind, T.FractionalType):
            add("warning", "continuous_target", target, "many float values for a classification")
        if rows and rarest < 0.01 * rows:
            add("warning", "rare_class", target, f"the rarest class has {rarest} rows")
        if strategy == "stratified" and rarest < folds:
            add("error", "rare_for_folds", target, f"the rarest class has fewer rows than {folds} folds")
    else:
        if not isinstance(kind, T.NumericType):
            add("error", "text_target", target, "a regression target must be numeric")
        elif unique < 20:
            add("warning", "few_values", target, "few distinct values for a regression")
    if rows < 2 * folds:
        add("error", "few_rows", None, f"{rows} rows for {folds} folds")
    if strategy == "timeseries" and not date_columns(df):
        add("error", "no_time", None, "no date column for a time split")
    maybe = [c for c in kept if c != target and rows > 20 and stats[c].values >= 0.9 * rows and any(h in c.lower() for h in _ID_HINTS)]
    exact = {r.column: r.n_unique for r in distinct_counts(df, maybe).collect()} if maybe else {}
    for c in kept:
        if c == target:
            continue
        if rows and stats[c].nulls == rows:
            add("warning", "all_null", c, "only nulls")
        elif exact.get(c) == rows:
            add("warning", "id_like", c, "a value of its own in every row")
    rank = {"error": 0, "warning": 1, "info": 2}
    return sorted(out, key=lambda i: rank[i.severity])
