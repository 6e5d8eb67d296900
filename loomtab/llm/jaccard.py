"""N-gram Jaccard join: all links of a similarity threshold, and their components.

Texts with equal shingle sets form a class.  Classes meet in *tiles*, one for each shingle of their prefixes: two
sets of the wanted similarity share a shingle of their first n - ceil(t n) + 1 in any common order.  Tiles are parted by
size band; a member is a guest in the tiles of the next band.  They are compared by size, by position, and by parity bitmaps as wide as their size band asks: the bits in which two
bitmaps differ bound the sets' difference from below, hence their overlap from above.  What is left is intersected
exactly.  Two early rounds over tiles of one smallest hash join most near copies into components, and the full round
looks at pairs of different components only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, forget, prepare, rows_with, shuffle_parts, slices, text_bytes, whole_groups
from .words import mix, shingles

U = np.uint64
#: Documents sampled to see which shingles are frequent, and how often one must occur there.  It orders shingles,
#: so that prefixes hold rare ones; any order gives the same links, so at most ``ORDER_MOST`` are kept.
ORDER_SAMPLE, ORDER_COUNT, ORDER_MOST = 5000, 3, 500_000
#: Members, and shingles in all, of a tile of the early rounds; members of a tile; a larger list is compared block by block.
FIRST_TILE, FIRST_SHINGLES, TILE = 1024, 200_000, 4096
#: Salts of the hashes whose smallest value names a class's tile in the early rounds.
SALTS = (U(0), U(0x51ED2701))
#: Pairs looked at together, and bytes of their bitmaps.
_PAIRS, _BITMAP_BYTES = 1 << 17, 2 << 20


def _prints(values: np.ndarray, first: np.ndarray):
    """Two order-free 64-bit fingerprints of each set."""
    out = []
    for salt in (U(0x51ED270B), U(0xA2F7C35D)):
        total = np.zeros(len(values) + 1, U)
        np.cumsum(mix(values ^ salt), out=total[1:])
        out.append(total[first[1:]] - total[first[:-1]])
    return out


def _ordered(values: np.ndarray, first: np.ndarray, frequent: np.ndarray):
    """Each set with its frequent shingles last, else by hash: (values, position in its set, set)."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(values), bool)
    if len(frequent) and len(values):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        late = frequent[at] == values
    order = np.lexsort((values, late, doc))
    values = values[order]
    return values, np.arange(len(values)) - first[:-1][doc], doc


def size_band(n: Column, percent: int) -> Column:
    """The band of a set's size: sizes that may link lie in one band or in neighbouring ones."""
    # a hair wider than the threshold, so that rounding of logarithms can't part a pair by two bands
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) + 1e-9)).cast("int") if percent < 100 else n.cast("int")


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    """Width of a set's bitmap by its size band: the power of two from twice its size on, 64 to 65,536."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), 64, 1 << 16)


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap as uint64 words: bit h mod ``bits`` counts the elements that fall there, modulo 2."""
    at = (mix(values) & U(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U)


def _fold(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width; parities add up."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


def _follow(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of equal group, in portions; groups are runs."""
    n = len(group)
    if not n:
        return
    ends = np.searchsorted(group, group, "right")
    after = ends - np.arange(n) - 1
    total = np.cumsum(after)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
        counts = after[at:to]
        i = np.repeat(np.arange(at, to), counts)
        if len(i):
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        at = to


def surviving_pairs(group: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray, block: np.ndarray, off: np.ndarray, guest: np.ndarray, bits: list[bytes] | None, percent: int):
    """Pairs of a tile that may link, in portions (i, j).

    ``off``: in a tile of two blocks, only pairs across them; ``guest``: rows of a smaller size band, compared with those
    of the tile's own only.  Compared are pairs of different components.  Without ``bits`` sizes and positions alone
    decide.
    """
    width = bitmap_bits(n)
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def words(w: int):
        if w not in by:
            row = np.full(len(n), -1)
            own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            parts = []
            if len(own):
                parts.append(np.frombuffer(b"".join(bits[i] for i in own), U).reshape(len(own), -1))
            if len(wide):
                parts.append(_fold(np.frombuffer(b"".join(bits[i] for i in wide), U).reshape(len(wide), -1)))
            row[own], row[wide] = np.arange(len(own)), len(own) + np.arange(len(wide))
            by[w] = row, np.concatenate(parts)
        return by[w]

    for i, j in _follow(group):
        a, b = n[i], n[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        ok = (comp[i] != comp[j]) & (100 * low >= percent * high) & ~(off[i] & (block[i] == block[j])) & ~(guest[i] & guest[j])
        i, j = i[ok], j[ok]
        both = n[i] + n[j]
        need = -(-percent * both // (100 + percent))
        ok = 1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= need
        i, j, both, need = i[ok], j[ok], both[ok], need[ok]
        if bits is None:
            yield i, j
            continue
        w = np.minimum(width[i], width[j])
        for each in np.unique(w):
            row, table = words(int(each))
            own = np.flatnonzero(w == each)
            step = max(16, _BITMAP_BYTES * 8 // int(each))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                differ = np.bitwise_count(table[row[i[part]]] ^ table[row[j[part]]]).sum(1, dtype=np.int64)
                part = part[(both[part] - differ) // 2 >= need[part]]
                yield i[part], j[part]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def frequent_shingles(df: DataFrame, size: int) -> np.ndarray:
    """The commonest shingles of ``ORDER_COUNT`` or more documents of a bounded sample."""
    rows = df.count()
    share = min(1.0, ORDER_SAMPLE / max(rows, 1))
    sample = df.select("text").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, _ = shingles(*text_bytes(part.column(0)), size)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= ORDER_COUNT).persist()
    least, total = ORDER_COUNT, 0
    for r in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():  # at most ORDER_SAMPLE rows
        total += r.n
        if total > ORDER_MOST:
            least = r["count"] + 1
            break
    kept = counts.where(F.col("count") >= least).select("h").toArrow()
    counts.unpersist()
    return np.sort(kept["h"].to_numpy().view(U))


def set_classes(df: DataFrame, size: int) -> DataFrame:
    """(id, n, p1, p2, k0, k1) of every row: size and fingerprints of its set, and its smallest hash by each salt."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, first = shingles(*text_bytes(part.column(1)), size)
                p1, p2 = _prints(values, first)
                n = np.diff(first)
                keys = []
                for salt in SALTS:
                    least = np.zeros(len(n), U)
                    least[n > 0] = np.minimum.reduceat(mix(values ^ salt), first[:-1][n > 0]) if len(values) else 0
                    keys.append(least)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *(pa.array(x.view(np.int64)) for x in (p1, p2, *keys))], names=["id", "n", "p1", "p2", "k0", "k1"])

    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, n long, p1 long, p2 long, k0 long, k1 long")


def prefix_rows(df: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """(shingle, p1, p2, n, pos): the prefix of every class that a task meets, once each."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, first = shingles(*text_bytes(part.column(1)), size)
                p1, p2 = _prints(values, first)
                n = np.diff(first)
                fresh = np.zeros(len(n), bool)
                for i, p in enumerate(p1.tolist()):
                    if n[i] and p not in seen:
                        seen.add(p)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()  # a class may come again; tiles meet it once all the same
                values, pos, doc = _ordered(values, first, frequent.value)
                take = np.flatnonzero(fresh[doc] & (pos < (n + -(-n * percent // 100) * -1 + 1)[doc]))
                d = doc[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values[take].view(np.int64)), pa.array(p1[d].view(np.int64)), pa.array(p2[d].view(np.int64)), pa.array((n[d] << 32) | pos[take])],
                    names=["shingle", "p1", "p2", "place"],
                )

    return df.mapInArrow(run, "shingle long, p1 long, p2 long, place long")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(wanted's columns, bits, set): sets of the rows whose id and fingerprint are wanted; each once per row of ``wanted``."""
    names = wanted.columns
    joined = rows_with(docs, wanted, "id").select(*names, "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                values, first = shingles(*text_bytes(part.column(len(names))), size)
                p1, _ = _prints(values, first)
                ok = np.flatnonzero(p1.view(np.int64) == part.column(names.index("p1")).to_numpy())
                n = np.diff(first)
                width = bitmap_bits(n)
                sets = [values[first[i] : first[i + 1]] for i in ok]
                bits = [bitmap(s, int(width[i])).tobytes() for s, i in zip(sets, ok, strict=True)]
                kept = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(names))), pa.array(bits, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "bits", "set"])

    schema = ", ".join(f"{n} {t}" for n, t in wanted.dtypes)
    return joined.mapInArrow(run, f"{schema}, bits binary, `set` binary")


def _named(reps: DataFrame, comps: DataFrame) -> DataFrame:
    """The classes with their component; one without links is its own."""
    named = reps.join(comps.select(F.col("node").alias("id"), "component"), "id", "left")
    return named.select(*[c for c in reps.columns], F.coalesce("component", "id").alias("comp"))


def _early_round(docs: DataFrame, named: DataFrame, key: str, size: int, percent: int) -> DataFrame:
    """(u, v): components that exact links of one tile join, each with the smallest it is joined to.

    ``named`` has the classes with their component so far.  A large tile is dealt into parts: what they miss, the
    full round finds.
    """
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / FIRST_TILE), F.ceil(F.sum("n") / FIRST_SHINGLES)).cast("int")
    counts = named.groupBy(key).agg(parts.alias("parts"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select(key, "parts")
    parts = F.pmod(F.xxhash64(F.lit(key), "id"), F.col("parts")).cast("int")
    members = rows_with(named, counts, key).select(F.col(key).alias("lead"), parts.alias("sub"), "id", "comp", "p1")
    texts = rows_with(docs, members, "id").select("lead", "sub", "id", "comp", "p1", "text")
    tiles = texts.repartition(shuffle_parts(docs.sparkSession), "lead", "sub").sortWithinPartitions("lead", "sub", "id")

    def run(batches):
        for table in whole_groups(batches, 2, 200):
            values, first = shingles(*text_bytes(table["text"].combine_chunks()), size)
            n = np.diff(first)
            lead, sub, ids, comp, p1 = (table[c].to_numpy() for c in ("lead", "sub", "id", "comp", "p1"))
            group = np.cumsum(np.concatenate([[0], (lead[1:] != lead[:-1]) | (sub[1:] != sub[:-1])]))
            sets = [values[first[i] : first[i + 1]] for i in range(len(n))]
            width = bitmap_bits(n)
            bits = [bitmap(x, int(w)).tobytes() for x, w in zip(sets, width.tolist(), strict=True)]
            zero = np.zeros(len(n), np.int64)
            # a row that repeats an id with another text is not the class that was asked for
            own = _prints(values, first)[0].view(np.int64) == p1
            labels, node = np.unique(comp, return_inverse=True)
            u = _Union(int(node.max()) + 1)
            for i, j in surviving_pairs(group, n, zero, comp, zero, zero > 0, zero > 0, bits, percent):
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if own[a] and own[b] and u.find(node[a]) != u.find(node[b]) and linked(sets[a], sets[b], percent):
                        u.join(node[a], node[b])
            # labels ascend with their numbers, so a root is the smallest of its component
            root = labels[[u.find(x) for x in range(len(labels))]]
            moved = np.flatnonzero(root != labels)
            yield pa.RecordBatch.from_arrays([pa.array(labels[moved]), pa.array(root[moved])], names=["u", "v"])

    return tiles.mapInArrow(run, "u long, v long")


def _tiled(listed: DataFrame, percent: int) -> DataFrame:
    """Rows of the tiles (shingle, band, lo, hi), from list members with ``members`` and ``top``, the list's largest band.

    A member stands in the tiles of its size band and as a guest in those of the next, so that sets of sizes near enough
    meet.  A group over TILE is dealt to blocks, and a tile holds two of them.  Blocks of the group's commonest component
    meet those of the others only: near copies of one passage, already joined, aren't multiplied by each other.
    """
    bands = F.when(F.col("size_band") < F.col("top"), F.array("size_band", F.col("size_band") + 1)).otherwise(F.array("size_band"))
    rows = listed.withColumn("band", F.explode(bands)).withColumn("guest", F.col("band") > F.col("size_band"))
    names = ["shingle", "band", "lo", "hi", "id", "p1", "comp", "place", "block", "guest"]
    small = rows.where(F.col("members") <= TILE).select("*", *[F.lit(0).alias(c) for c in ("lo", "hi", "block")]).select(*names)
    large = rows.where(F.col("members") > TILE)
    kinds = large.groupBy("shingle", "band", "comp").agg(F.count(F.lit(1)).alias("n"))
    groups = kinds.groupBy("shingle", "band").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
    groups = groups.where("all > most").select("shingle", "band", "main", F.ceil(F.col("most") / TILE).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("rest"))
    dealt = rows_with(large, groups, ["shingle", "band"])
    main = F.col("comp") == F.col("main")
    block = F.when(main, F.pmod(F.xxhash64("id", "p1"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("id", "p1"), F.col("rest"))).cast("int")
    dealt = dealt.withColumn("block", block)
    with_rest = F.transform(F.sequence(F.col("mains"), F.col("mains") + F.col("rest") - 1), lambda b: F.struct(F.least("block", b).alias("lo"), F.greatest("block", b).alias("hi")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: F.struct(b.alias("lo"), F.col("block").alias("hi")))
    tiles = F.when(main, with_rest).otherwise(F.concat(with_main, with_rest))
    large = dealt.withColumn("tile", F.explode(tiles)).select("*", "tile.lo", "tile.hi").select(*names)
    return small.unionByName(large)


def _full_round(docs: DataFrame, reps: DataFrame, comps: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """Links (u, v) between classes of different components, over the tiles of all prefix shingles, written."""
    parts = shuffle_parts(docs.sparkSession)
    prefixes = cut(prefix_rows(docs, size, percent, frequent))
    # pre-aggregated, so that a shingle of a third of all texts is a row for each task
    shared = prefixes.groupBy("shingle").agg(F.min("p1").alias("least"), F.max("p1").alias("most")).where("least <> most").select("shingle")
    # a class met by several tasks stands in a list several times
    lists = prefixes.join(shared, "shingle").distinct()
    placed = cut(lists.join(_named(reps, comps).select("id", "p1", "p2", "comp"), ["p1", "p2"]).withColumn("size_band", size_band(F.shiftright("place", 32), percent)))
    forget(prefixes)
    mixed = placed.groupBy("shingle").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("members"), F.max("size_band").alias("top")).where("least <> most").drop("least", "most")
    listed = placed.join(mixed, "shingle").select("shingle", "id", "p1", "comp", "place", "members", "size_band", "top")
    short = listed.where(F.col("members") <= TILE).repartition(parts, "shingle").sortWithinPartitions("shingle")

    def pair_up(batches):
        """Members of lists up to a tile that sizes and positions allow a partner."""
        for table in whole_groups(batches, 1, 10_000):
            shingle, comp, place = (table[c].to_numpy() for c in ("shingle", "comp", "place"))
            group = np.cumsum(np.concatenate([[0], shingle[1:] != shingle[:-1]]))
            zero = np.zeros(len(group), np.int64)
            use = zero > 0
            for i, j in surviving_pairs(group, place >> 32, place & 0xFFFFFFFF, comp, zero, zero > 0, zero > 0, None, percent):
                use[i] = True
                use[j] = True
            yield from table.filter(pa.array(use)).combine_chunks().to_batches()

    mixed = cut(short.mapInArrow(pair_up, short.schema).unionByName(listed.where(F.col("members") > TILE)))
    forget(placed)
    bits = cut(_sets_of(docs, mixed.select("id", "p1").distinct(), size).select("id", "p1", "bits"))
    tiles = _tiled(mixed, percent).join(bits, ["id", "p1"])
    tiles = tiles.select("shingle", "band", "lo", "hi", "id", "comp", "place", "block", "guest", "bits").repartition(parts, "shingle", "band", "lo", "hi").sortWithinPartitions("shingle", "band", "lo", "hi", "id")

    def run(batches):
        for table in whole_groups(batches, 4, 10_000):
            ids, comp, place, block = (table[c].to_numpy() for c in ("id", "comp", "place", "block"))
            guest = table["guest"].to_numpy(zero_copy_only=False)
            keys = [table[c].to_numpy() for c in ("shingle", "band", "lo", "hi")]
            group = np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
            found = [np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])], 1) for i, j in surviving_pairs(group, place >> 32, place & 0xFFFFFFFF, comp, block, keys[2] != keys[3], guest, table["bits"].to_pylist(), percent)]
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    pairs = cut(tiles.mapInArrow(run, "u long, v long").distinct())
    forget(mixed)
    forget(bits)
    needed = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    sets = cut(_sets_of(docs, needed.join(reps.select("id", "p1"), "id").select("id", "p1"), size).select("id", "set"))
    with_u = pairs.join(sets.select(F.col("id").alias("u"), F.col("set").alias("set_u")), "u")
    both = with_u.join(sets.select(F.col("id").alias("v"), F.col("set").alias("set_v")), "v").select("u", "v", "set_u", "set_v")

    def verify(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(x, U), np.frombuffer(y, U), percent) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    links = cut(both.mapInArrow(verify, "u long, v long"))
    forget(pairs)
    forget(sets)
    return links


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    Two rows link when 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the smallest
    id that links reach.  Rows without a word have no set, link with nothing and are their own component; rows
    with a null id have a null component.  Equal sets link; a repeated id with another text counts by its own set.
    """
    spark = prepare(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size))
    slim = cut(set_classes(docs, size))
    reps = cut(slim.where("n > 0 and id is not null").groupBy("p1", "p2", "n", "k0", "k1").agg(F.min("id").alias("id")))
    # rows that repeat an id with another set are one node of the graph: they link through their id
    links = cut(_early_round(docs, reps.withColumn("comp", F.col("id")), "k0", size, percent))
    # a class stands in one tile of the first round, so what it is joined to there is its component so far
    named = _named(reps, links.select(F.col("u").alias("node"), F.col("v").alias("component")))
    links = cut(links.unionByName(_early_round(docs, named, "k1", size, percent)))
    links = links.unionByName(_full_round(docs, reps, connected_components(links), size, percent, frequent))
    final = connected_components(links)
    root = reps.join(final.select(F.col("node").alias("id"), "component"), "id", "left").select("p1", "p2", F.coalesce("component", "id").alias("component"))
    out = slim.join(root, ["p1", "p2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 85 % Jaccard similarity of 4-word shingles."""
    return jaccard_components(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_jaccard_join": op5_jaccard_join}
ORACLES = {
    "op5_jaccard_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents
),
s as (
  select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as i from w where len(ws) > 0)
),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as (
  select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)
),
reach as (
  select doc_id as u, doc_id as v from n
  union select r.u, l.v from reach r join link l on r.v = l.u
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m.c, d.doc_id) as component_id
from documents d left join n using (doc_id) left join (select u, min(v) as c from reach group by u) m on m.u = d.doc_id
""",
}
