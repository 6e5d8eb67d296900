"""Reproducible splits as membership tables (row_id, fold, role, repeat).

Rows are ordered by their id, a content hash, so that a split survives reordering.  Positions come from running
counts of id prefixes: no sort of all rows meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import written
from ..schema import col

SCHEMA = "row_id string, fold smallint, role string, repeat smallint"
#: Ranges of the ordering key that are numbered apart; hex digits of a hash that name a range of it.
RANGES, DIGITS = 256, 3


class SplitError(ValueError):
    """A split that can't be made or doesn't hold."""


def _shuffled(key: Column, seed: int | None) -> Column:
    """The ordering key: the id itself, or its hash with the seed."""
    return key if seed is None else F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)


def range_of(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``; 0 for null.  In two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    blocks = [F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)]
    upto = lambda values: F.size(F.filter(values, lambda b: b <= value))
    block = upto(F.array(*map(F.lit, bounds[::step])))
    return F.when(value.isNull() | (block == 0), 0).otherwise((block - 1) * step + upto(F.get(F.array(*blocks), block - 1)))


def positions(df: DataFrame, order: list[Column], name: str = "pos", within: list[str] | None = None, bounds: list | None = None, hexed: bool = False, hexed_ties: bool = False) -> DataFrame:
    """Add the 0-based position in the order of ``order`` (within groups of equal ``within``).

    The first order column cuts the rows into ranges at approximate quantiles or ``bounds``; each range is numbered by
    itself and moved on by the rows of the ranges before.  ``hexed``: it is a hash in lower-case hex digits, whose
    first ``DIGITS`` name the range.  ``hexed_ties``: the second order column is such a hash; rows that share a frequent
    value of the first, a day's or an instant's, are then parted by it.
    """
    within = within or []
    keyed = df.withColumns({f"_o{i}": o for i, o in enumerate(order)})
    digits = lambda c: F.conv(F.substring(c, 1, DIGITS), 16, 10).cast("int")
    if hexed:
        part = digits("_o0")
    else:
        key = _spread(keyed)
        found = [r for r in (_quantiles(keyed, key) if bounds is None else bounds) if r is not None]
        part = range_of(key if bounds is None else F.col("_o0"), sorted(set(found)))
        if hexed_ties and bounds is None and (often := sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})):
            # a bound that comes twice is a value of many rows: first of its range, in ranges of the ties' hash
            wide = 16**DIGITS + 1
            part = part * wide + F.when(key.isin(often), digits("_o1")).otherwise(wide - 1)
    cut = keyed.withColumn("_part", part)
    counts = cut.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*within).orderBy("_part")) - F.col("_n")).drop("_n")
    # the positions of a group's ranges: groups x RANGES rows, joined by key
    inner = Window.partitionBy(*within, "_part").orderBy(*[f"_o{i}" for i in range(len(order))])
    joined = cut.withColumn("_i", F.row_number().over(inner) - 1).join(before, [*within, "_part"])
    return joined.withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).select(*[col(c) for c in df.columns], name)


def _spread(keyed: DataFrame) -> Column:
    """The first order column, a time as microseconds: of the instant, or of the written date and time."""
    kind = dict(keyed.dtypes)["_o0"]
    if kind == "timestamp":
        return F.unix_micros("_o0")
    if kind == "timestamp_ntz":
        seconds = F.unix_date(F.col("_o0").cast("date")).cast("long") * 86400 + F.hour("_o0") * 3600 + F.minute("_o0") * 60
        return seconds * 1_000_000 + (F.expr("extract(second from _o0)") * 1_000_000).cast("long")
    return F.unix_date("_o0") if kind == "date" else F.col("_o0")


def _quantiles(keyed: DataFrame, key: Column) -> list:
    """Range bounds of the first order column in ascending order; one that stands for much comes several times."""
    if dict(keyed.dtypes)["_o0"] == "string":
        return text_bounds(keyed.select("_o0").distinct(), "_o0")
    return sorted(keyed.agg(F.percentile_approx(key, [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0] or [])


def value_codes(df: DataFrame, column: str, value: str = "value", code: str = "code") -> DataFrame:
    """(value, code): the column's distinct values ascending, coded from 0; nulls have none."""
    values = df.select(col(column).alias(value)).where(col(value).isNotNull()).distinct()
    kind = dict(values.dtypes)[value]
    spread = kind in ("string", "date", "timestamp", "timestamp_ntz", "tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    numbered = positions(values, [col(value)], code, bounds=None if spread else [])
    return numbered.select(col(value), F.col(code).cast("int").alias(code))


def text_bounds(values: DataFrame, column: str) -> list[str]:
    """Range bounds of distinct strings: quantiles of a bounded sample by hash.  They spread the work; positions stay exact."""
    seen = sorted(r[0] for r in values.select(col(column).alias("v")).where("v is not null").orderBy(F.xxhash64("v"), "v").limit(16 * RANGES).collect())
    return sorted({seen[i * len(seen) // RANGES] for i in range(1, RANGES)}) if seen else []


def _all_hex(key: Column) -> Column:
    """Whether every key begins with as many lower-case hex digits as name a range."""
    return F.bool_and(F.coalesce(F.substring(key, 1, DIGITS).rlike(f"^[0-9a-f]{{{DIGITS}}}$"), F.lit(False)))


def _members(folded: DataFrame, folds: int, repeat: int = 0) -> DataFrame:
    """Every row in every fold: validation in its own, train in the others."""
    each = folded.select("row_id", F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    role = F.when(F.col("own") == F.col("fold"), "validation").otherwise("train")
    return each.select("row_id", F.col("fold").cast("smallint").alias("fold"), role.alias("role"), F.lit(repeat).cast("smallint").alias("repeat"))


def fold_of_position(pos: Column, n: Column, folds: int) -> Column:
    """Contiguous blocks; the first n mod folds are one larger."""
    q, r = F.floor(n / folds), n % folds
    large = r * (q + 1)
    return F.when(pos < large, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - large) / F.greatest(q, F.lit(1)))).cast("int")


def kfold(ids: DataFrame, folds: int = 5, seed: int | None = None, repeat: int = 0) -> DataFrame:
    """Blocks in id order; with ``seed`` in the order of the seeded hash."""
    n, plain = ids.agg(F.count(F.lit(1)), _all_hex(F.col("row_id"))).first()
    if folds < 2 or n < folds:
        raise SplitError(f"{n} rows for {folds} folds")
    placed = positions(ids.select("row_id"), [_shuffled(F.col("row_id"), seed)], hexed=seed is not None or plain)
    return _members(placed.withColumn("fold", fold_of_position(F.col("pos"), F.lit(n), folds)), folds, repeat)


def _upto(sizes: DataFrame, folds: int) -> DataFrame:
    """(y, fold, upto) from (y, n, first): how many of a class's rows, in their order, lie in a fold or before it."""
    # one row for each class and fold
    line = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(line), F.lit(0)))
    each = start.select("y", "start", "n", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    lead = F.pmod(F.col("fold") - F.col("start"), F.lit(folds))
    share = F.greatest(F.lit(0), F.ceil((F.col("n") - lead) / folds))
    return each.select("y", "fold", F.sum(share).over(Window.partitionBy("y").orderBy("fold")).alias("upto"))


#: Fold bounds that are sent to every executor at most; more are joined by class.
BOUNDS = 20_000


def fold_bounds(rows: DataFrame, folds: int = 5, label: str | None = None, seed: int | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """What adds to any of the rows the fold that ``kfold``, or ``stratified`` by ``label``, validates them in.

    The row ids are hashes in lower-case hex digits.  A class's folds are blocks in the order of the ids, so all that is
    needed is the ids at which they begin: exact order statistics, found by counting ranges of ids.  Only the rows of
    those ranges are sorted, and none are shuffled for their fold.
    """
    key = _shuffled(F.col("row_id"), seed)
    label_of = F.coalesce(col(label).cast("string"), F.lit("\0null")) if label else F.lit("")
    named = rows.select(label_of.alias("y"), key.alias("key"), F.substring(key, 1, DIGITS).alias("part"))
    counts = named.groupBy("y", "part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).cache()
    try:
        sizes = counts.groupBy("y").agg(F.sum("n").alias("n"), F.min("first").alias("first")).cache()
        n, classes, small = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") < folds)).first()
        if label is None and (folds < 2 or n < folds):
            raise SplitError(f"{n} rows for {folds} folds")
        if small:
            raise SplitError(f"a class has fewer rows than {folds} folds")
        sent = F.broadcast if classes * folds <= BOUNDS else lambda x: x
        before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("y").orderBy("part")) - F.col("n"))
        begins = _upto(sizes, folds).where(F.col("fold") < folds - 1).join(before.select("y", "part", "before", "n"), "y").where("upto >= before and upto < before + n")
        wanted = written(begins.select("y", "part", (F.col("upto") - F.col("before")).alias("at")))
        inside = Window.partitionBy("y", "part").orderBy("key")
        near = named.join(sent(wanted.select("y", "part").distinct()), ["y", "part"]).withColumn("at", F.row_number().over(inside) - 1)
        bounds = written(near.join(sent(wanted), ["y", "part", "at"]).groupBy(F.col("y").alias("_y")).agg(F.array_sort(F.collect_list("key")).alias("_from")))
    finally:
        counts.unpersist()
        sizes.unpersist()

    def add(some: DataFrame, name: str) -> DataFrame:
        placed = some.join(sent(bounds), label_of == F.col("_y"), "left")
        return placed.withColumn(name, F.coalesce(F.size(F.filter("_from", lambda b: b <= key)), F.lit(0))).drop("_y", "_from")

    return add


def listed(own: Column, folds: int, repeat: int = 0) -> Column:
    """The memberships of a row, validation in its ``own`` fold and train in the others, as an array."""
    role = lambda f: F.when(f == own, "validation").otherwise("train")
    return F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: F.struct(f.cast("smallint").alias("fold"), role(f).alias("role"), F.lit(repeat).cast("smallint").alias("repeat")))


def stratified(rows: DataFrame, label: str, folds: int = 5, seed: int | None = None, repeat: int = 0) -> DataFrame:
    """Each class spread over the folds in proportion.

    In id order classes are numbered by first appearance; in the class-sorted sequence, fold f gets as many rows
    of a class as positions of it are f modulo ``folds``; the class's rows fill fold 0 first.
    """
    order = _shuffled(F.col("row_id"), seed)
    named = rows.select("row_id", F.coalesce(col(label).cast("string"), F.lit("\0null")).alias("y"))
    sizes = named.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), _all_hex(F.col("row_id")).alias("plain"))
    small, plain = sizes.agg(F.count_if(F.col("n") < folds), F.bool_and("plain")).first()
    if small:
        raise SplitError(f"a class has fewer rows than {folds} folds")
    upto = _upto(sizes, folds).groupBy("y").agg(F.array_sort(F.collect_list("upto")).alias("upto"))
    placed = positions(named, [order], within=["y"], hexed=seed is not None or bool(plain)).join(upto, "y")
    return _members(placed.withColumn("fold", F.size(F.filter("upto", lambda u: u <= F.col("pos")))), folds, repeat)


def deal(load: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Give ``count`` groups of one size to the lightest fold each, in place: (first group, folds taken in turn) of each stretch.

    A stretch lasts until its folds have reached the next lightest one, so there are at most as many as folds.
    """
    out, at = [], 0
    while at < count:
        order = sorted(range(len(load)), key=lambda f: (load[f], f))
        low = order[0]
        turn = [f for f in order if (load[f], f) < (load[low] + size, low)]
        rounds = min(((load[f] - load[low] - (f < low)) // size for f in order[len(turn) :]), default=count)
        n = min(rounds * len(turn), count - at)
        for i, f in enumerate(turn):
            load[f] += size * (n // len(turn) + (i < n % len(turn)))
        out.append((at, turn))
        at += n
    return out


def group_kfold(rows: DataFrame, group: str, folds: int = 5, repeat: int = 0) -> DataFrame:
    """Groups whole: the largest first, each to the lightest fold; equal sizes by key.

    The greedy pass needs only how many groups there are of each size: n rows have at most sqrt(2n) different sizes.
    Groups are numbered among those of their size in Spark, and their number tells the fold.
    """
    sizes = rows.groupBy(col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    load, table = [0] * folds, []
    for r in sorted(sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: -r.n):
        stretches = deal(load, r.n, r.m)
        table.append((r.n, [a for a, _ in stretches], [t for _, t in stretches]))
    if sum(x > 0 for x in load) < folds:
        raise SplitError(f"fewer groups than {folds} folds")
    dealt = rows.sparkSession.createDataFrame(table, "n long, starts array<long>, turns array<array<int>>")
    numbered = positions(sizes, [F.coalesce("g", F.lit("")), F.col("g").isNotNull()], within=["n"], bounds=text_bounds(sizes, "g"))
    placed = numbered.join(F.broadcast(dealt), "n").withColumn("at", F.size(F.filter("starts", lambda a: a <= F.col("pos"))) - 1)
    turn = F.get("turns", F.col("at"))
    fold = F.get(turn, F.pmod(F.col("pos") - F.get("starts", F.col("at")), F.size(turn)).cast("int"))
    named = placed.select("g", fold.alias("fold"))
    joined = rows.select("row_id", col(group).cast("string").alias("k")).join(named, F.col("k").eqNullSafe(F.col("g")))
    return _members(joined.select("row_id", "fold"), folds, repeat)


def time_split(rows: DataFrame, time: str, folds: int = 5, gap: int = 0, embargo: int = 0, repeat: int = 0) -> DataFrame:
    """Expanding windows by (time, row_id): each fold validates a block, and trains on all before it less ``gap``.

    ``embargo`` drops as many of the last training rows besides.  A null time is an error.
    """
    n, missing, plain = rows.agg(F.count(F.lit(1)), F.count_if(col(time).isNull()), _all_hex(F.col("row_id"))).first()
    if missing:
        raise SplitError(f"{missing} rows without {time}")
    size = n // (folds + 1)
    if size == 0:
        raise SplitError(f"{n} rows for {folds} folds")
    placed = positions(rows.select("row_id", col(time).alias("t")), [F.col("t"), F.col("row_id")], hexed_ties=bool(plain))
    each = placed.select("row_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    start = n - (folds - F.col("fold")) * size
    role = F.when((F.col("pos") >= start) & (F.col("pos") < start + size), "validation").when(F.col("pos") < start - gap - embargo, "train")
    return each.select("row_id", F.col("fold").cast("smallint").alias("fold"), role.alias("role"), F.lit(repeat).cast("smallint").alias("repeat")).where("role is not null")


def fold_counts(members: DataFrame) -> DataFrame:
    """(fold, role, n)."""
    return members.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def split_summary(members: DataFrame) -> DataFrame:
    """One row of counts: rows, other roles, repeated rows, folds without a role, overlaps of train and validation."""
    each = members.groupBy("row_id", "fold", "repeat").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("role") == "train").alias("t"),
        F.count_if(F.col("role") == "validation").alias("v"),
        F.count_if(~F.coalesce(F.col("role").isin("train", "validation", "test"), F.lit(False))).alias("o"),
        F.countDistinct("role").alias("r"),
    )
    rows = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_bad_roles"), F.coalesce(F.sum(F.when(F.col("n") > F.col("r"), F.col("n"))), F.lit(0)).alias("n_duplicates"), F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("n_overlap"))
    folds = members.groupBy("fold", "repeat").agg(F.max((F.col("role") == "train").cast("int")).alias("t"), F.max((F.col("role") == "validation").cast("int")).alias("v"))
    return rows.crossJoin(F.broadcast(folds.agg(F.count_if((F.col("t") == 0) | (F.col("v") == 0)).alias("n_one_sided"))))


def validate_split(members: DataFrame) -> None:
    """SplitError unless the table has the columns, rows, known roles, no repeats, both roles in each fold, no overlap."""
    if missing := {"row_id", "fold", "role", "repeat"} - set(members.columns):
        raise SplitError(f"missing columns {sorted(missing)}")
    r = split_summary(members).first()
    problems = ([] if r.n_rows else ["no rows"]) + [f"{what}: {n}" for what, n in (("unknown roles", r.n_bad_roles), ("repeated rows", r.n_duplicates), ("rows on both sides", r.n_overlap), ("folds with one role only", r.n_one_sided)) if n]
    if problems:
        raise SplitError("; ".join(problems))


def validate_listed(rows: DataFrame, name: str) -> tuple[int, int]:
    """``validate_split`` of rows that hold their memberships as an array ``name``; the numbers of rows and of memberships.

    Ids are told apart by 16 of their digits, and by all of them only where those come twice.
    """
    each, where = F.col(name), lambda role: F.transform(F.filter(name, lambda m: m["role"] == role), lambda m: F.struct(m["fold"], m["repeat"]))
    unknown = F.size(F.filter(each, lambda m: ~F.coalesce(m["role"].isin("train", "validation", "test"), F.lit(False))))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(each)), F.lit(0)).alias("m"), F.coalesce(F.sum(unknown), F.lit(0)).alias("bad"), F.count_if(F.size(each) > F.size(F.array_distinct(each))).alias("twice"), F.count_if(F.arrays_overlap(where("train"), where("validation"))).alias("overlap")).first()
    ids = rows.select("row_id", F.substring("row_id", 1, 16).alias("head"))
    again = r.n - ids.select(F.unhex("head").alias("head")).distinct().count()
    if again:
        often = ids.groupBy("head").count().where("count > 1").select("head")
        again = ids.join(often, "head").groupBy("row_id").count().where("count > 1").count()
    roles = rows.select(F.inline(name)).groupBy("fold", "repeat").agg(F.max((F.col("role") == "train").cast("int")).alias("t"), F.max((F.col("role") == "validation").cast("int")).alias("v"))
    one_sided = roles.where("t = 0 or v = 0").count()
    found = (("unknown roles", r.bad), ("repeated rows", r.twice + again), ("rows on both sides", r.overlap), ("folds with one role only", one_sided))
    if problems := ([] if r.m else ["no rows"]) + [f"{what}: {n}" for what, n in found if n]:
        raise SplitError("; ".join(problems))
    return r.n, r.m


def temporal_summary(members: DataFrame, rows: DataFrame, time: str) -> DataFrame:
    """(fold, last_train, first_validation, ok): training must end before validation begins; a tie is not before."""
    joined = members.join(rows.select("row_id", col(time).alias("t")), "row_id")
    by = joined.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("t"))).alias("last_train"), F.min(F.when(F.col("role") == "validation", F.col("t"))).alias("first_validation"))
    return by.withColumn("ok", F.coalesce(F.col("last_train") < F.col("first_validation"), F.lit(False)))


def validate_time_split(members: DataFrame, rows: DataFrame, time: str) -> None:
    bad = [r.fold for r in temporal_summary(members, rows, time).where("not ok").select("fold").orderBy("fold").collect()]
    if bad:
        raise SplitError(f"folds whose training reaches into validation: {bad}")


def with_split(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows with their fold and role; ids without membership go."""
    return rows.join(members, "row_id")
