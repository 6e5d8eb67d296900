"""Near-duplicate embeddings: cross-polytope hashing with multiprobe buckets, every candidate pair verified.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the largest coordinate and its sign are
the nearest corner of the cross-polytope.  ``K`` such corners name the vector's bucket in a table; its probes are
buckets in which one corner is the second largest, first where that is nearest to the largest.  Vectors meet in the
buckets they share, main or probe, and are linked by their cosine in double precision.

Equal vectors of a label are one class and are hashed once.  A bucket too large for a task is cut into blocks, and every pair
of blocks is a task of its own, so no pair is left out.  Pairs are never written: a bucket gives for each of its vectors the
number of links first seen there, and the root of its component there.  A pair that shares several buckets counts in
the first of them only, which its two vectors tell by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import BROADCAST_IDS, column, cut, forget, prepare, shuffle_parts, whole_groups
from .words import mix

U = np.uint64
LEAST = 0.98
#: Hash tables; probes of a vector in each besides its main bucket.  With these, recall at a cosine of 0.98 and more was
#: 1.0000 on 28,617 pairs of 64 dimensions, with two corners for each table as with three.
TABLES, PROBES = 4, 2
#: Vectors for each bucket that the number of corners aims at; there are two corners at least.
FILL = 1000
#: Bytes of double precision that a block of a bucket holds at most, about; pairs looked at together.
BLOCK_BYTES, PAIRS = 1 << 20, 1 << 17


def corners_for(n: int, dim: int) -> int:
    """Corners that name a bucket, so that ``n`` vectors of ``dim`` dimensions fill one with about ``FILL``."""
    return max(2, math.ceil(math.log(max(n / FILL, 1)) / math.log(2 * _padded(dim))))


def _padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


@lru_cache(maxsize=256)
def _signs(table: int, corner: int, width: int) -> np.ndarray:
    """Three rows of random signs, the same on every machine."""
    at = np.arange(3 * width, dtype=U) + U(((table * 64 + corner + 1) << 32) & 0xFFFFFFFFFFFF)
    return (1.0 - 2.0 * (mix(mix(at) + U(0x5851F42D4C957F2D)) >> U(63)).astype(float)).reshape(3, width)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; their length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
        h *= 2
    return x


def buckets(unit: np.ndarray, table: int, corners: int, probes: int = PROBES) -> np.ndarray:
    """The codes of each row's main bucket and probes in a table, side by side."""
    n, dim = unit.shape
    width = _padded(dim)
    wide = np.zeros((n, width))
    wide[:, :dim] = unit
    best, second, margin = (np.zeros((n, corners), kind) for kind in (U, U, float))
    rows = np.arange(n)
    for k in range(corners):
        y = wide
        for signs in _signs(table, k, width):
            y = hadamard(y * signs)
        size = np.abs(y)
        top = size.argmax(1)
        largest = size[rows, top]
        size[rows, top] = -1.0
        next_top = size.argmax(1)
        for out, at in ((best, top), (second, next_top)):
            out[:, k] = (2 * at + (y[rows, at] < 0)).astype(U)
        margin[:, k] = 1 - size[rows, next_top] / np.maximum(largest, 1e-300)
    near = np.argsort(margin, axis=1, kind="stable")
    codes = [_named(best)]
    for p in range(min(probes, corners)):
        probe = best.copy()
        probe[rows, near[:, p]] = second[rows, near[:, p]]
        codes.append(_named(probe))
    return np.stack(codes, 1).view(np.int64)


def _named(corners: np.ndarray) -> np.ndarray:
    out = np.zeros(len(corners), U)
    for k in range(corners.shape[1]):
        out = mix(out + corners[:, k] + U(1))
    return out


def units(values: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list array, all of ``dim`` finite values, as unit vectors in double precision."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _by_dim(batch: pa.RecordBatch | pa.Table, name: str) -> Iterator[tuple[int, np.ndarray]]:
    """(dimensions, rows of that many)."""
    dims = column(batch, "dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _place(table: int, corners_of: dict[int, int], whole: bool):
    """Map function: a row for each bucket of each class; with the vector if ``whole``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch, "dim"):
                own = batch.take(pa.array(rows))
                codes = buckets(units(column(own, "embedding"), dim), table, corners_of[dim])
                for k in range(codes.shape[1]):
                    # two probes of a vector may not be one bucket: that of another corner differs there
                    head = [column(own, "label"), column(own, "dim"), pa.array(codes[:, k])]
                    rest = [column(own, c) for c in ("class", "n", "embedding")] if whole else []
                    yield pa.RecordBatch.from_arrays([*head, *rest], names=["label", "dim", "bucket", *(("class", "n", "embedding") if whole else ())])

    return placed


def _roots(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The least vertex of each one's component, links (a, b) added to what ``root`` has joined before."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _first_meeting(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs share no bucket of an earlier table, and none below ``bucket`` in the last."""
    ok = np.ones(len(a), bool)
    for t, own in enumerate(codes):
        for i in range(own.shape[1]):
            for j in range(own.shape[1]):
                same = own[a, i] == own[b, j]
                if t == len(codes) - 1:
                    same &= own[a, i] < bucket
                ok &= ~same
    return ok


def _pairs(start: np.ndarray, size: np.ndarray, left: np.ndarray, crossed: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
    """(group, rows, rows) to compare, in portions: in a ``crossed`` group the first ``left`` rows with the others only."""
    for g in range(len(start)):
        s, e, m = int(start[g]), int(start[g] + size[g]), int(start[g] + left[g])
        first, others = ((s, m), slice(m, e)) if crossed[g] else ((s, e), slice(s, e))
        step = max(1, PAIRS // (e - s))
        for at in range(*first, step):
            yield g, slice(at, min(at + step, first[1])), others


def _linked(table: int, corners_of: dict[int, int], least: float):
    """Map function over rows sorted by bucket and block: (class, links, root) of the classes with a link in a bucket."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 5, 2048, BLOCK_BYTES):
            held = held.combine_chunks()
            for dim, rows in _by_dim(held, "dim"):
                own = held.take(pa.array(rows))
                out = _of_groups(own, dim, table, corners_of[dim], least)
                if out is not None:
                    yield out

    return found


def _of_groups(own: pa.Table, dim: int, table: int, corners: int, least: float) -> pa.RecordBatch | None:
    keys = [own.column(c).to_numpy() for c in ("label", "bucket", "i", "j")]
    second = own.column("second").to_numpy(zero_copy_only=False)
    new = np.ones(own.num_rows, bool)
    if own.num_rows:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, own.num_rows))
    left = np.add.reduceat(~second, start) if len(start) else size
    crossed = keys[2][start] != keys[3][start]
    many = np.where(crossed, (left > 0) & (left < size), size > 1)
    if not many.any():
        return None
    start, size, left, crossed = start[many], size[many], left[many], crossed[many]
    unit = units(own.column("embedding").combine_chunks(), dim)
    a_all, b_all, g_all = [], [], []
    for g, part, others in _pairs(start, size, left, crossed):
        x, y = np.nonzero(unit[part] @ unit[others].T >= least)
        a, b = x + part.start, y + others.start
        ok = a < b
        a_all.append(a[ok])
        b_all.append(b[ok])
        g_all.append(np.full(int(ok.sum()), g))
    a, b, g = map(np.concatenate, (a_all, b_all, g_all))
    if not len(a):
        return None
    # codes only of rows that have a link
    seen = np.unique(np.concatenate([a, b]))
    codes = [buckets(unit[seen], t, corners) for t in range(table + 1)]
    here = np.zeros(own.num_rows, np.int64)
    here[seen] = np.arange(len(seen))
    bucket, n = keys[1][start], own.column("n").to_numpy()
    links, root = np.zeros(own.num_rows, np.int64), np.arange(own.num_rows)
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        root = _roots(x, y, root)
        ok = _first_meeting(codes, here[x], here[y], bucket[g[at : at + PAIRS]])
        np.add.at(links, x[ok], n[y[ok]])
        np.add.at(links, y[ok], n[x[ok]])
    classes = own.column("class").to_numpy()
    return pa.RecordBatch.from_arrays([pa.array(classes[seen]), pa.array(links[seen]), pa.array(classes[root[seen]])], names=["class", "links", "root"])


def _usable(e: Column) -> Column:
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def _keys(label: Column, e: Column) -> list[Column]:
    """128 bits that tell the vectors of all labels apart."""
    return [F.xxhash64(F.lit(seed), label, e).alias(name) for seed, name in ((1, "k1"), (7919, "k2"))]


def near_duplicates(vectors: DataFrame, least: float = LEAST, tables: int = TABLES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label; others are not read).

    Rows link when their labels are equal and not null, their vectors have as many components, and their cosine is at
    least ``least``.  A vector that is null, empty, zero, or holds a null or a component that is not finite links with nothing.
    Equal rows link with each other like any others, and each counts.  A row without an id takes part in links; the
    component is the smallest id there is in it, null if there is none, and ``kept`` is null-safe equality.  No link
    below ``least`` is ever made; above it, those of vectors that share a bucket, main or probe, in one of the tables.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding").withColumn("usable", _usable(F.col("embedding")) & F.col("label").isNotNull())
    kinds = rows.where("usable").groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    # ids are made once, as the file is written
    classes = cut(kinds.select(F.monotonically_increasing_id().alias("class"), "label", F.size("embedding").alias("dim"), "embedding", "n", "least", *_keys(F.col("label"), F.col("embedding"))))
    by_dim = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    corners_of = {d: corners_for(n, d) for d, n in by_dim.items()}
    found = [_table_links(spark, classes, t, corners_of, least) for t in range(tables)]
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    counts = links.groupBy("class").agg(F.sum("links").alias("links"))
    joined = connected_components(links.where("class != root").select(F.col("class").alias("u"), F.col("root").alias("v")))
    named = classes.select("class", "least", "n", "k1", "k2").join(counts, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "class")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = named.join(smallest, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    for f in (classes, *found):
        forget(f)
    label, e = F.when(F.col("usable"), F.col("label")), F.when(F.col("usable"), F.col("embedding"))
    ids = rows.select("vec_id", "usable", *_keys(label, e))
    used = ids.where("usable").join(whole, ["k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = ids.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return used.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _table_links(spark: SparkSession, classes: DataFrame, table: int, corners_of: dict[int, int], least: float) -> DataFrame:
    """(class, links, root) from the buckets of one table, written: the shuffles of one table are gone before the next."""
    label = classes.schema["label"].dataType.simpleString()
    keys = ["label", "dim", "bucket"]
    narrow = classes.select("label", "dim", "embedding").mapInArrow(_place(table, corners_of, False), f"label {label}, dim int, bucket long")
    block = F.greatest(F.lit(64), F.expr(f"{BLOCK_BYTES} div (8 * dim)"))
    large = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).where("blocks > 1").select(*keys, "blocks")
    large = cut(large)
    sizes = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    embedding = classes.schema["embedding"].dataType.simpleString()
    placed = classes.select("label", "dim", "class", "n", "embedding").mapInArrow(_place(table, corners_of, True), f"label {label}, dim int, bucket long, class long, n long, embedding {embedding}")
    sized = placed.join(sizes, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    # a member of block b meets its own block and, on either side, every other
    each = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "second": F.col("own") > F.col("other")})
    order = [*keys, "i", "j"]
    dealt = spread.select(*order, "second", "class", "n", "embedding").repartition(shuffle_parts(spark), *order).sortWithinPartitions(*order, "second")
    out = cut(dealt.mapInArrow(_linked(table, corners_of, least), "class long, links long, root long"))
    forget(large)
    return out


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label by brute force, and the closure of their links.
_SQL = """
with recursive usable as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as u, b.vec_id as v from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
    where list_cosine_similarity(a.v, b.v) >= 0.98
), reached as (
    select vec_id as node, vec_id as other from embeddings
    union
    select r.node, l.v from reached r join links l on r.other = l.u
), component as (
    select node, min(other) as component_id from reached group by node
), counted as (
    select u, count(*) as n_links from links group by u
)
select e.vec_id, coalesce(k.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join component c on c.node = e.vec_id left join counted k on k.u = e.vec_id
"""

QUERIES = {"op12_cross_polytope": op12_cross_polytope}
ORACLES = {"op12_cross_polytope": _SQL}
