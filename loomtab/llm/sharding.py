"""Minimax contiguous partition of atomic groups into shards, in DataFrame functions.

Groups of equal texts, ordered by the digest of their text, are cut into contiguous shards so that the largest
shard is as small as possible: binary search over the capacity, a greedy pass as the check.

Of the partitions within that capacity, the most even one is taken, shard by shard.

The search runs on a table of ordered *items*, ranges of digests with their bytes, whose number is bounded
whatever the corpus.  A range can only matter if a cut may fall inside it; those ranges, a few dozen for each cut,
are split by more digits of the digest and counted again, until every cut is certain to fall between groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import cut, prepare

#: Hex digits of the first ranges (4: at most 65,536), digits that a split adds, and of a whole digest.
FIRST_DIGITS, MORE_DIGITS, ALL_DIGITS = 4, 2, 32
#: Rows are numbered within this many buckets of each shard.
SLOT_BUCKETS = 512


@dataclass(frozen=True)
class Item:
    """The groups whose digest starts with ``prefix``; ``groups`` of them, ``size`` bytes in all."""

    prefix: str
    size: int
    groups: int


def greedy_cuts(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Positions after each shard when every shard takes all that fits; None if ``shards`` don't hold it all.

    ``sums[i]`` is the size of the first i groups.
    """
    cuts, at, n = [], 0, len(sums) - 1
    for _ in range(shards):
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to == at and at < n:
            return None
        cuts.append(to)
        at = to
    return cuts if at == n else None


def smallest_capacity(sizes: Iterable[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity with which the ordered sizes fit into ``shards``, and the greedy cuts there."""
    sizes = list(sizes)
    sums = [0, *accumulate(sizes)]
    low, high = max([*sizes, -(-sums[-1] // shards)]), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, greedy_cuts(sums, low, shards)


def _open_items(items: list[Item], shards: int, least: int, most: int) -> set[str]:
    """Prefixes of the items inside which a cut may fall when the capacity is between ``least`` and ``most``."""
    sums = [0, *accumulate(i.size for i in items)]
    low = high = 0
    found: set[str] = set()
    for _ in range(shards):
        a = max(0, bisect_right(sums, low + least) - 1)
        b = min(len(items), bisect_left(sums, high + most))
        # a cut stands in item a at the earliest and before the end of item b - 1 at the latest
        found.update(i.prefix for i in items[a:b] if i.groups > 1)
        low, high = sums[a], min(high + most, sums[-1])
        if a == len(items):
            break
    return found


def even_cuts(items: list[Item], capacity: int, shards: int) -> tuple[list[int], set[str]]:
    """Cuts that keep every shard within ``capacity`` and as near to an equal part of the rest as that allows.

    Also the prefixes of the items, if any, inside which a nearer cut may lie.
    """
    sums = [0, *accumulate(i.size for i in items)]
    cuts, at, inner = [], 0, set()
    for left in range(shards, 1, -1):
        goal = sums[at] + (sums[-1] - sums[at]) / left
        far = bisect_right(sums, sums[at] + capacity) - 1
        after = bisect_left(sums, goal)
        if after <= far and sums[after] > goal and items[after - 1].groups > 1:
            inner.add(items[after - 1].prefix)
        near = min((j for j in (after - 1, after) if at <= j <= far), key=lambda j: abs(sums[j] - goal), default=far)
        # what remains must fit: the later the cut, the easier; the greedy cut always does
        low, high = near, far
        while low < high:
            mid = (low + high) // 2
            rest = [x - sums[mid] for x in sums[mid:]]
            if greedy_cuts(rest, capacity, left - 1) is None:
                low = mid + 1
            else:
                high = mid
        at = low
        cuts.append(at)
    return [*cuts, len(items)], inner


def minimax_boundaries(count: Callable[[list[str], int], list[Item]], largest_group: int, shards: int) -> list[str]:
    """First digests of shards 1, 2, ...: ``count(prefixes, digits)`` gives the items of those ranges.

    The largest shard is as small as can be; within that capacity the cuts are as even as can be.  Fewer boundaries
    than shards less one mean that the last shards are empty.
    """
    items = count([], FIRST_DIGITS)
    if not items:
        return []

    def split(opened: set[str]) -> list[Item]:
        deeper: dict[str, list[Item]] = {}
        for length in sorted({len(p) for p in opened}):
            own = [p for p in opened if len(p) == length]
            for item in count(own, min(ALL_DIGITS, length + MORE_DIGITS)):
                deeper.setdefault(item.prefix[:length], []).append(item)
        return [x for i in items for x in (sorted(deeper[i.prefix], key=lambda y: y.prefix) if i.prefix in opened else [i])]

    while True:
        total = sum(i.size for i in items)
        capacity, _ = smallest_capacity((i.size for i in items), shards)
        if not (opened := _open_items(items, shards, max(largest_group, -(-total // shards)), capacity)):
            break
        items = split(opened)
    while True:
        cuts, opened = even_cuts(items, capacity, shards)
        if not opened:
            return [items[c].prefix for c in cuts if c < len(items)]
        items = split(opened)


def shard_minimax(df: DataFrame, shards: int, text: str = "text", size: Column | None = None, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard) to every row.

    Rows of equal text stay together; null texts are one group.  ``size`` is a row's weight, by default the UTF-8
    bytes of its text plus 1.  Repeated rows all keep their own slot; an empty table stays empty.  With fewer
    groups than shards some shards are empty.
    """
    if {shard, slot} & set(df.columns):
        raise ValueError(f"columns {shard} and {slot} must be new")
    prepare(df.sparkSession)
    body = F.col(f"`{text}`")
    weight = F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1 if size is None else size
    # the caller's columns travel in one struct, so that no name of theirs can meet one of these
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    slim = df.select(row.alias("row"), weight.alias("size"), F.coalesce(F.md5(body.cast("binary")), F.lit("0" * ALL_DIGITS)).alias("key"))
    groups = cut(slim.groupBy("key").agg(F.sum("size").alias("bytes")))
    largest = groups.agg(F.max("bytes")).first()[0]

    def count(prefixes: list[str], digits: int) -> list[Item]:
        part = groups
        if prefixes:
            part = groups.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
        by = part.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("bytes").alias("size"), F.count(F.lit(1)).alias("n"))
        return sorted((Item(r.prefix, r.size, r.n) for r in by.collect()), key=lambda i: i.prefix)

    bounds = minimax_boundaries(count, largest or 0, shards)
    which = F.lit(0)
    for b in bounds:
        which = which + (F.col("key") >= b).cast("int")
    numbered = _with_slots(slim.select("row", which.cast("int").alias("shard")))
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("shard").alias(shard), F.col("slot").alias(slot))


def _with_slots(df: DataFrame) -> DataFrame:
    """Number the rows (row, shard) of each shard without bringing a shard into one task.

    Rows are dealt to buckets by the hash of all their columns' values, numbered within a bucket, and moved on by
    the rows of earlier buckets; only equal rows share a bucket by nature.
    """
    hashed = F.xxhash64("row")
    dealt = df.withColumn("bucket", F.pmod(hashed, F.lit(SLOT_BUCKETS)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most shards x SLOT_BUCKETS rows
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(hashed)) - 1)
    joined = numbered.join(F.broadcast(before), ["shard", "bucket"])
    return joined.select("row", "shard", (F.col("before") + F.col("number")).cast("long").alias("slot"))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    body = F.col("text").cast("binary")
    # one pass over the texts; from here on a document is four numbers
    slim = cut(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            F.md5(body).alias("digest"),
        )
    )
    out = shard_minimax(slim, 16, text="digest", size=F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op2_minimax_shards": op2_minimax_shards}
ORACLES: dict[str, str] = {}
