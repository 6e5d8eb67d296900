"""Row identity by content, and digests of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import col


def canonical(df: DataFrame) -> Column:
    """A string of a row's values, alike for equal rows: columns by name, nulls and separators marked."""
    parts = []
    for name in sorted(df.columns):
        kind = df.schema[name].dataType
        x = col(name)
        if isinstance(kind, T.BinaryType):
            x = F.hex(x)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            x = F.to_json(x)
        else:
            x = x.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("="), x), F.lit("~")))
    return F.concat_ws("|", *parts)


#: Copies of a row that one task numbers at a time.
COPIES = 10_000


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a SHA-256 of the row's content and its number among equal rows; independent of any order."""
    row = F.struct(*[col(c) for c in df.columns])
    # equal rows are counted, and the counts unfolded again in stretches that are dealt to all tasks
    kinds = df.select(F.unhex(F.sha2(canonical(df), 256)).alias("digest"), row.alias("row")).groupBy("digest").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"))
    small = kinds.where(F.col("n") <= COPIES).select("digest", "row", "n", F.lit(0).cast("long").alias("k"))
    large = kinds.where(F.col("n") > COPIES).select("digest", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))).alias("k"))
    first = F.col("k") * COPIES
    dealt = small.unionByName(large.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest", "k"))
    each = dealt.select("digest", "row", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)).alias("turn"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.sha2(F.concat_ws(":", F.lower(F.hex("digest")), F.col("turn").cast("string")), 256).alias(name))


def row_id_parts(df: DataFrame, parts: int, name: str = "row_id") -> list[DataFrame]:
    """``with_row_ids`` in parts by a hash of the rows, equal rows together: each shuffles its own share of them only."""
    hashed = [col(f.name) for f in df.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(F.lit(31), *hashed), F.lit(parts)) if hashed else F.lit(0)
    return [with_row_ids(df.where(part == i), name) for i in range(parts)]


def schema_string(df: DataFrame) -> str:
    return ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))


def frame_digest(df: DataFrame) -> DataFrame:
    """One row (n_rows, digest): SHA-256 of the schema and of four sums over the rows' SHA-256; no row is gathered.

    Each sum adds 15 of the hex digits, so the digest does not depend on any order and counts repeated rows.
    """
    rows = df.select(F.sha2(canonical(df), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)"))
    agg = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(part(i), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return agg.select("n_rows", F.sha2(F.concat_ws("|", F.lit(schema_string(df)), F.col("n_rows").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("digest"))


#: Hex digits of a row's digest that name its range, at the tree's leaves; each inner node has 16 children.
DEPTH = 3


def digest_leaves(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(prefix, n_rows, digest): the leaves of the frame's tree, one for each range of row digests that has rows.

    A leaf's digest is that of its number of rows and of four sums over their SHA-256, so no row is gathered, repeated
    rows count, and order doesn't.
    """
    rows = df.select(F.sha2(canonical(df), 256).alias("h")).withColumn("prefix", F.substring("h", 1, depth))
    part = lambda i: F.sum(F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    agg = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_rows"), *[part(i).alias(f"s{i}") for i in range(4)])
    return agg.select("prefix", "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("digest"))


def merkle_nodes(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(prefix, n_rows, digest) of all nodes: an inner node's digest is that of its children's prefixes and digests in order.

    A node has 16 children at most, so each level is one aggregate of small groups; the root's prefix is empty.
    """
    out = level = leaves
    for k in range(depth - 1, -1, -1):
        child = F.struct("prefix", "digest")
        above = level.groupBy(F.substring("prefix", 1, k).alias("up")).agg(F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list(child)).alias("c"))
        level = above.select(F.col("up").alias("prefix"), "n_rows", F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"]))), 256).alias("digest"))
        out = out.unionByName(level)
    return out


def merkle_digest(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row (n_rows, digest): SHA-256 of the schema and of the tree's root; an empty frame has the root of no leaves."""
    root = merkle_nodes(digest_leaves(df, depth), depth).where("prefix = ''").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("digest"), F.lit("")).alias("digest"))
    return root.select("n_rows", F.sha2(F.concat_ws("|", F.lit(schema_string(df)), "digest"), 256).alias("digest"))


def differing_ranges(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(prefix, n_left, n_right): the leaves in which two trees (``merkle_nodes`` of equal depth) differ.

    Nodes are compared from the root down; below nodes that agree nothing is looked at.
    """
    found = None
    for k in range(depth + 1):
        own, other = (x.where(F.length("prefix") == k) for x in (left, right))
        pairs = own.select("prefix", F.col("n_rows").alias("n_left"), F.col("digest").alias("dl")).join(other.select("prefix", F.col("n_rows").alias("n_right"), F.col("digest").alias("dr")), "prefix", "full_outer")
        pairs = pairs.where(~F.col("dl").eqNullSafe(F.col("dr"))).select("prefix", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
        if found is not None:
            pairs = pairs.join(found.select(F.col("prefix").alias("up")), F.substring("prefix", 1, k - 1) == F.col("up"), "left_semi")
        found = pairs
    return found


def rows_of_ranges(df: DataFrame, ranges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows whose digest lies in one of ``ranges`` (prefix): what has to be looked at, or restored."""
    names = [col(c) for c in df.columns]
    return df.withColumn("_prefix", F.substring(F.sha2(canonical(df), 256), 1, depth)).join(F.broadcast(ranges.select(F.col("prefix").alias("_prefix"))), "_prefix", "left_semi").select(*names)
