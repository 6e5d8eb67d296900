"""Long repeated byte strings by run-length indexes of content-chosen shards.

A string of ``length`` bytes names one of its positions by content alone: the rightmost smallest gram hash in it,
its *anchor*.  Equal strings have equal anchors at equal places, so the stretches around the anchors of one hash
hold all that can repeat, and only anchors met twice or more are looked at.  Equal stretches are one *kind*; a kind met
twice repeats whole.  What an anchor's different kinds share is found by an index: the kinds of whole anchors are dealt to
shards, whose text holds each once.  Its Burrows-Wheeler transform is kept as runs, with the match to the neighbouring row sampled at both ends of each run.
In text order the match shrinks by one from byte to byte until the next sample, so the matching statistics of all
places stream off the samples; where they reach ``length``, a repeated string starts.  What is found for a kind holds
for all its stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import BROADCAST_IDS, column, cut, forget, nullable, prepare, rows_with, shuffle_parts, slices, text_bytes, whole_groups
from .words import gram_hash, mix, prefix_hash, span_hash

U = np.uint64
GRAM = 32
_POS_BITS = 28
#: Bytes of a text that are searched for anchors at once (positions must fit their bits).
_CHUNK = 1 << 21
#: Kinds of one key that may stand in a shard; a larger group is split by finer keys.  Parts of each split.
GROUP_LIMIT, SPLIT = 500, 8
#: Kinds of a shard, about; anchors, or kinds with their places, that are sent to every executor at most (some 50 bytes each).
SHARD_ROWS, BROADCAST_KINDS = 500, 1_000_000
_SEPARATOR = 0xFF  # no byte of UTF-8


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int):
    none = np.zeros(0, np.int64)
    n = len(data)
    starts = n - length + 1
    if starts <= 0:
        return none, none, none, none, none.view(U)
    gram = min(GRAM, length)
    width = length - gram + 1
    at = np.arange(n - gram + 1)
    g = gram_hash(prefix_hash(data), at, at + gram)
    key = (g >> U(_POS_BITS) << U(_POS_BITS)) | (U(n) - at.astype(U))
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:starts], before[width - 1 : width - 1 + starts])
    where = n - (least & U((1 << _POS_BITS) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.flatnonzero(np.arange(starts) + length <= offsets[1:][doc])
    where, doc = where[inside], doc[inside]
    if not len(inside):
        return none, none, none, none, none.view(U)
    new = np.concatenate([[True], (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(where)) - 1
    p = where[head]
    return doc[head], p, inside[head], inside[tail] + length, g[p]


def _repeats_at(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Whether the bytes lo to hi of each row are those that stand ``step`` further on."""
    ok = np.zeros(len(lo), bool)
    for d in np.unique(step).tolist():
        rows = np.flatnonzero(step == d)
        if len(rows) < 64:
            ok[rows] = [np.array_equal(data[a:b], data[a + d : b + d]) for a, b in zip(lo[rows].tolist(), hi[rows].tolist(), strict=True)]
            continue
        unlike = np.zeros(len(data) - d + 1, np.int32)
        np.cumsum(data[d:] != data[:-d], out=unlike[1:])
        ok[rows] = unlike[hi[rows]] == unlike[lo[rows]]
    return ok


def _series(data: np.ndarray, doc: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, g: np.ndarray):
    """(first anchor of each series, anchors in it, way from its first to its last).

    A text with a period has an anchor in every period, and all of them have equal stretches at equal steps.
    """
    n = len(p)
    if n < 2:
        return np.arange(n), np.ones(n, np.int64), np.zeros(n, np.int64)
    step = np.diff(p)
    like = (doc[1:] == doc[:-1]) & (g[1:] == g[:-1]) & (np.diff(lo) == step) & (np.diff(hi) == step)
    at = np.flatnonzero(like)
    like[at] = _repeats_at(data, lo[at], hi[at], step[at])
    # a series goes on where the stretch is that of the anchor before and the step is its last one
    follows = np.zeros(n, bool)
    follows[1:] = like
    same_step = np.zeros(n, bool)
    same_step[2:] = step[1:] == step[:-1]
    goes_on = follows & (same_step | ~np.append(False, follows[:-1]))
    head = np.flatnonzero(~goes_on)
    count = np.diff(np.append(head, n))
    return head, count, p[head + count - 1] - p[head]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, anchor position, first byte, end byte, gram hash, stretch hash, count, way) of every anchor of a batch.

    The stretch runs from the first to the last string of ``length`` bytes that has this anchor.  Anchors of equal
    stretches that follow each other in equal steps are one row, that of the first: there are ``count`` of them, and the last
    is ``way`` further on.  A step is shorter than a string, so the bytes they cover have no gap.  A very long text is
    searched in overlapping chunks; each string lies in one of them.
    """
    found = []
    for a in range(0, max(len(data), 1), _CHUNK):
        b = min(len(data), a + _CHUNK + length - 1)
        part = data[a:b]
        doc, p, lo, hi, g = _anchors_of(part, np.clip(offsets, a, b) - a, length)
        head, count, way = _series(part, doc, p, lo, hi, g)
        doc, p, lo, hi, g = (x[head] for x in (doc, p, lo, hi, g))
        found.append((doc, p + a, lo + a, hi + a, g, mix(span_hash(part, lo, hi) + (p - lo).astype(U)), count, way))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- the run-length index -----------------------------------------------------------------------------------


#: Four-byte grams of which the smallest names a sampled place; with them 15 bytes decide it, and 16 are compared first.
_WINDOW = 12


def _groups(ranked: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of the first of each run of equal values, whether the run has several) of sorted values."""
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    return slot[np.maximum.accumulate(np.where(head, np.arange(len(slot)), 0))], ~(head & np.append(head[1:], True))


def _samples(key: np.ndarray) -> np.ndarray:
    """For every place, that of the smallest of its next grams: the same for two places that agree in 15 bytes."""
    n = len(key)
    if n < _WINDOW:
        return np.arange(n)
    mask = (U(1) << U(32)) - U(1)
    grams = (key >> U(32)) * U(0x9E3779B97F4A7C15) & ~mask | np.arange(n, dtype=U)
    blocks = np.concatenate([grams, np.full(-n % _WINDOW, ~U(0))]).reshape(-1, _WINDOW)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    own = n - _WINDOW + 1
    least = np.minimum(after[:own], before[_WINDOW - 1 : _WINDOW - 1 + own])
    return np.concatenate([(least & mask).astype(np.int64), np.arange(own, n)])


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all suffixes in their order, the first 8 bytes from each place).

    Sorted are 16 bytes of each suffix, then what follows from content-chosen sampled places on, by prefix doubling over
    these alone: two suffixes that agree in 16 bytes reach such a place after equally many.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for j in range(8):
        key = key << U(8) | padded[j : j + n]
    order = np.argsort(key)
    slot = np.arange(n)
    group, open_ = _groups(key[order], slot)
    rank = np.zeros(n, np.int64)
    rank[order] = group

    def refine(follow) -> None:
        """Sort the open groups by ``follow`` of their places."""
        nonlocal slot, group, open_
        slot, group = slot[open_], group[open_]
        pos = order[slot]
        both = group.astype(U) << U(32) | follow(pos).astype(U)
        by = np.argsort(both)
        pos = pos[by]
        order[slot] = pos
        group, open_ = _groups(both[by], slot)
        rank[pos] = group

    # of two that end within 8 bytes, the shorter is first
    refine(lambda pos: np.where(pos + 8 < n, rank[np.minimum(pos + 8, n - 1)] + n + 1, n - pos))
    if not open_.any():
        return order, key
    sample = _samples(key)
    chosen = np.zeros(n, bool)
    chosen[sample] = True
    places = np.flatnonzero(chosen)
    number = np.cumsum(chosen) - 1
    then = number[sample[np.minimum(places + 1, n - 1)]]
    level = rank[places]
    while True:
        both = level.astype(U) << U(32) | level[then].astype(U)
        by = np.argsort(both)
        both = both[by]
        level[by] = np.cumsum(np.concatenate([[0], both[1:] != both[:-1]]))
        if level[by[-1]] == len(places) - 1:
            break
        then = then[then]
    refine(lambda pos: level[number[sample[pos]]])
    return order, key


def _common(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the match between the suffixes at a and at b."""
    n = len(key)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    far = np.maximum(a, b)
    while len(live):
        at = out[live]
        x = key[a[live] + at] ^ key[b[live] + at]
        same = np.zeros(len(live), np.int64)
        for j in range(8):
            same += x >> U(56 - 8 * j) == 0
        out[live] += same
        live = live[(same == 8) & (far[live] + at + 8 < n)]
    return np.minimum(out, n - far)  # behind the end, nothing matches


@dataclass(frozen=True)
class RunLengthIndex:
    """Runs of the transform, and for both ends of each run its text position and the match with the next row outside."""

    size: int
    symbols: np.ndarray
    lengths: np.ndarray
    heads: np.ndarray
    head_matches: np.ndarray
    tails: np.ndarray
    tail_matches: np.ndarray

    def matching_statistics(self) -> np.ndarray:
        """For every place of the text, the longest string from there that also starts elsewhere."""
        return np.maximum(self._stream(self.heads, self.head_matches), self._stream(self.tails, self.tail_matches))

    def _stream(self, places: np.ndarray, matches: np.ndarray) -> np.ndarray:
        at, value = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        at[places], value[places] = places, matches
        np.maximum.accumulate(at, out=at)
        return value[at] - (np.arange(self.size) - at)


def run_length_index(text: np.ndarray) -> RunLengthIndex:
    """The index of a text of at least one byte and less than 2**31."""
    order, key = suffix_order(text)
    symbol = text[order - 1].astype(np.int16)
    symbol[order == 0] = -1  # before the first byte stands a symbol of its own, so the first place is sampled
    change = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.append(change, len(text)) - 1
    matches = np.concatenate([[0], _common(key, order[change - 1], order[change]), [0]])
    return RunLengthIndex(len(text), symbol[first], last - first + 1, order[first], matches[:-1], order[last], matches[1:])


def repeated_starts(blobs: list[bytes], length: int):
    """(blob, offset) of every string of ``length`` bytes in the blobs that also starts elsewhere in them."""
    text = np.frombuffer(bytes([_SEPARATOR]).join([*blobs, b""]), np.uint8)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    found = run_length_index(text).matching_statistics()
    count = np.maximum(size - length + 1, 0)
    blob = np.repeat(np.arange(len(blobs)), count)
    offset = np.arange(len(blob)) - np.repeat(np.cumsum(count) - count, count)
    ok = found[(np.cumsum(size + 1) - size - 1)[blob] + offset] >= length
    return blob[ok], offset[ok]


# ---- the job ------------------------------------------------------------------------------------------------


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """(uid, anchor, stretch, pos, left, right, count, way) of every anchor, or series of anchors, in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                data, offsets = text_bytes(part.column(1))
                doc, p, lo, hi, g, s, count, way = anchors(data, offsets, length)
                uid = part.column(0).take(pa.array(doc))
                arrays = [uid, pa.array(g.view(np.int64)), pa.array(s.view(np.int64)), pa.array(p - offsets[doc]), pa.array((p - lo).astype(np.int32)), pa.array((hi - p).astype(np.int32)), pa.array(count), pa.array(way)]
                yield pa.RecordBatch.from_arrays(arrays, names=["uid", "anchor", "stretch", "pos", "left", "right", "count", "way"])

    return docs.mapInArrow(run, "uid binary, anchor long, stretch long, pos long, left int, right int, count long, way long")


_UNIT = "key long, sub long, twice boolean, lead int, bytes binary"


def _units(docs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(key, sub, twice, lead, bytes): the bytes of one stretch of each kind, looked up in a document that has it."""
    place = F.struct("anchor", "stretch", "twice", "pos", "left", "right")
    by_doc = kinds.groupBy("uid").agg(F.collect_list(place).alias("places"))  # at most a document's anchors
    if kinds.count() <= BROADCAST_KINDS:
        by_doc = F.broadcast(by_doc)
    joined = docs.join(by_doc, "uid").select("places", "text", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        served: set[bytes] = set()
        for batch in batches:
            # a row that stands in the table several times serves its kinds once a task; all of these are met twice
            uids = column(batch, "uid").to_pylist()
            new = [not (u in served or served.add(u)) for u in uids]
            if len(served) > 100_000:
                served.clear()
            for part in slices(batch.filter(pa.array(new, pa.bool_())), "text", 1 << 19):
                data, offsets = text_bytes(column(part, "text"))
                blob = data.tobytes()
                places = part.column(0)
                flat = places.flatten()
                anchor, stretch, twice, pos, left, right = (flat.field(i) for i in range(6))
                row = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                a = offsets[row] + pos.to_numpy() - left.to_numpy()
                b = offsets[row] + pos.to_numpy() + right.to_numpy()
                lead = pa.array(-left.to_numpy())
                for k in range(0, len(a), 5000):
                    piece = pa.array([blob[x:y] for x, y in zip(a[k : k + 5000].tolist(), b[k : k + 5000].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(x[k : k + 5000] for x in (anchor, stretch, twice, lead)), piece], names=["key", "sub", "twice", "lead", "bytes"])

    return joined.mapInArrow(run, _UNIT)


def _indexed(units: DataFrame, length: int) -> DataFrame:
    """(key, sub, first, last): repeated bytes of each unit met once, from its anchor on, by the index of its shard."""
    dealt = units.repartition(shuffle_parts(units.sparkSession), "key").sortWithinPartitions("key", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1, SHARD_ROWS):
            key, sub = table["key"].to_numpy(), table["sub"].to_numpy()
            table = table.filter(pa.array(np.concatenate([[True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])))
            key, sub, lead = (table[c].to_numpy() for c in ("key", "sub", "lead"))
            blob, offset = repeated_starts(table["bytes"].to_pylist(), length)
            ok = ~table["twice"].to_numpy(zero_copy_only=False)[blob]  # a unit met twice is known to repeat whole
            blob, offset = blob[ok], offset[ok]
            head = np.flatnonzero(np.concatenate([[True], (blob[1:] != blob[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(blob) else np.zeros(0, np.int64)
            tail = np.append(head[1:], len(blob)) - 1 if len(blob) else head
            row = blob[head]
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(sub[row]), pa.array(lead[row] + offset[head]), pa.array(lead[row] + offset[tail] + length)], names=["key", "sub", "first", "last"])

    return dealt.mapInArrow(run, "key long, sub long, first long, last long")


def _split(units: DataFrame, length: int, width: int) -> DataFrame:
    """(key2, sub2) and the unit's own columns: each unit cut into the strings whose anchor lies in one of ranges of ``width``.

    All strings of a range hold the bytes between its latest start and its earliest end, so equal ones agree in them;
    their hash is the finer key.  In a range of one place these bytes are the whole string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bytes", 1 << 18):
                data, offsets = text_bytes(column(part, "bytes"))
                left = -column(part, "lead").to_numpy().astype(np.int64)
                least = np.maximum(length - (np.diff(offsets) - left), 0)  # an anchor's place in its strings: from least to left
                from_, to = least // width, left // width
                count = to - from_ + 1
                row = np.repeat(np.arange(len(left)), count)
                part_no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + from_[row]
                a = part_no * width
                high, low = np.minimum(left[row], a + width - 1), np.maximum(least[row], a)
                zero = offsets[row] + left[row]  # the anchor
                core = span_hash(data, zero - a, zero - (a + width - 1) + length)
                lo, hi = zero - high, zero - low + length
                key2 = mix(core ^ mix(column(part, "key").to_numpy().view(U)[row] + part_no.astype(U)))
                sub2 = mix(span_hash(data, lo, hi) + high.astype(U))
                blob = data.tobytes()
                take = pa.array(row)
                own = [column(part, c).take(take) for c in ("key", "sub", "twice")]
                bytes_ = pa.array([blob[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key2.view(np.int64)), pa.array(sub2.view(np.int64)), *own, pa.array((-high).astype(np.int32)), bytes_], names=["key2", "sub2", "key", "sub", "twice", "lead", "bytes"])

    return units.mapInArrow(run, "key2 long, sub2 long, key long, sub long, twice boolean, lead int, bytes binary")


def _found(units: DataFrame, length: int, width: int, made: list[DataFrame]) -> DataFrame:
    """(key, sub, first, last) of all units, which come from files; ``width``: the places an anchor may have under one key.

    The files that the result is read from are added to ``made``.
    """
    made.append(units)
    large = units.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > GROUP_LIMIT).select("key")
    twice = units.where("twice").select("key", "sub", F.col("lead").cast("long").alias("first"), (F.col("lead") + F.octet_length("bytes")).cast("long").alias("last"))
    if width == 1 or large.isEmpty():
        return _indexed(units, length).unionByName(twice)
    large, finer = cut(large), -(-width // SPLIT)
    parts = cut(_split(rows_with(units, large, "key").select(*units.columns), length, finer))
    # units that agree in a range are one unit there
    made += [large, parts]
    merged = parts.groupBy("key2", "sub2").agg((F.max("twice") | (F.count(F.lit(1)) > 1)).alias("twice"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    inner = _found(cut(merged.select(F.col("key2").alias("key"), F.col("sub2").alias("sub"), "twice", "lead", "bytes")), length, finer, made)
    back = parts.select("key2", "sub2", "key", "sub").join(inner.select(F.col("key").alias("key2"), F.col("sub").alias("sub2"), "first", "last"), ["key2", "sub2"]).select("key", "sub", "first", "last")
    return _indexed(units.join(large, "key", "left_anti").select(*units.columns), length).unionByName(back).unionByName(twice)


def _small(table: DataFrame) -> DataFrame:
    """A table from files, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_KINDS else table


def repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(uid, spans): for each text with bytes to remove, its maximal [first, last) runs, ascending, written.

    ``docs`` has columns uid and text; rows of one uid have one text.
    """
    seen = cut(_stretches(docs, length))
    # counted before any anchor's rows meet: an anchor of a third of all texts is one row for each task here
    by_anchor = seen.groupBy("anchor").agg(F.sum("count").alias("n"), F.min("stretch").alias("least"), F.max("stretch").alias("most"))
    by_anchor = cut(by_anchor.where("n > 1").select("anchor", (F.col("least") < F.col("most")).alias("several")))
    met = seen.join(_small(by_anchor), "anchor").groupBy("anchor", "stretch", "several")
    kinds = cut(met.agg((F.sum("count") > 1).alias("twice"), F.min(F.struct("uid", "pos", "left", "right")).alias("at")).select("anchor", "stretch", "several", "twice", "at.*"))
    made = [by_anchor, kinds]
    marks = _found(cut(_units(docs, kinds.where("several"))), length, length - min(GRAM, length) + 1, made)
    # the only kind of an anchor: all its stretches are equal
    alone = kinds.where("not several").select(F.col("anchor").alias("key"), F.col("stretch").alias("sub"), (-F.col("left")).cast("long").alias("first"), F.col("right").cast("long").alias("last"))
    marks = marks.unionByName(alone)
    # at most a stretch's strings
    per_kind = cut(marks.groupBy(F.col("key").alias("anchor"), F.col("sub").alias("stretch")).agg(F.collect_set(F.struct("first", "last")).alias("marks")))
    for f in made:
        forget(f)
    hits = seen.select("uid", "anchor", "stretch", "pos", "way").join(_small(per_kind), ["anchor", "stretch"])
    placed = hits.select("uid", F.transform("marks", lambda m: F.struct((F.col("pos") + m["first"]).alias("first"), (F.col("pos") + F.col("way") + m["last"]).alias("last"))).alias("spans"))
    # a few for each stretch of over 300 bytes of the document
    by_doc = placed.groupBy("uid").agg(F.flatten(F.collect_set("spans")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            spans = column(batch, "spans")
            first, last = (spans.flatten().field(i).to_numpy() for i in range(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            order = np.lexsort((first, row))
            first, row = first[order], row[order]
            reach = np.maximum.accumulate(last[order] + (row << 40))
            head = np.flatnonzero(np.concatenate([[True], first[1:] + (row[1:] << 40) > reach[:-1]]))
            end = reach[np.append(head[1:], len(reach)) - 1] - (row[head] << 40)
            offsets = pa.array(np.searchsorted(row[head], np.arange(batch.num_rows + 1)).astype(np.int32))
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first[head]), pa.array(end)], names=["first", "last"]))
            yield pa.RecordBatch.from_arrays([column(batch, "uid"), runs], names=["uid", "spans"])

    spans = cut(by_doc.mapInArrow(merge, "uid binary, spans array<struct<first: long, last: long>>"))
    for f in (seen, per_kind):
        forget(f)
    return spans


def _cut_out(data: bytes, spans) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if not spans:
        return data, 0, 0
    stops = [0, *(x for s in spans for x in (s["first"], s["last"])), len(data)]
    left = b"".join(data[a:b] for a, b in zip(stops[::2], stops[1::2], strict=True))
    return left, len(data) - len(left), len(spans)


def _marked(df: DataFrame, length: int) -> DataFrame:
    """Columns of ``df`` (with id and text) and the spans of every row."""
    keyed = df.withColumn("text", F.coalesce("text", F.lit("")))
    uid = F.unhex(F.md5(F.concat(F.col("text").cast("binary"), F.lit(b"\0"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))))
    keyed = keyed.withColumn("uid", uid)
    spans = repeated_spans(keyed.select("uid", "text"), length)
    rows, items = spans.agg(F.count(F.lit(1)), F.sum(F.size("spans"))).first()
    if rows <= BROADCAST_IDS and (items or 0) <= BROADCAST_KINDS:
        spans = F.broadcast(spans)
    return keyed.join(spans, "uid", "left").drop("uid")


def repeat_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, text) of every row.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or
    another, overlaps included; strings never cross texts.  A null text counts as empty; repeated rows are copies
    of each other.  ``text`` is what is left, without characters of which a byte was removed.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    marked = _marked(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), length).select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary()).to_pylist()
            out = [(len(t), *_cut_out(t, s)) for t, s in zip(texts, column(batch, "spans").to_pylist(), strict=True)]
            arrays = [batch.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in (0, 2, 3)), pa.array([hashlib.sha256(o[1]).hexdigest() for o in out], pa.string())]
            left = pa.array([o[1].decode(errors="ignore") for o in out], pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, left], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return marked.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """All rows with all columns; in ``text`` the repeated bytes are gone.

    Characters of which a byte was removed go whole.  Null texts stay null.
    """
    prepare(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{text}`").isNull().alias("none"))
    marked = _marked(packed, length).select("row", "none", "text", "spans")
    schema = marked.select("row", "text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, none = column(batch, "text").cast(pa.binary()).to_pylist(), column(batch, "none").to_pylist()
            left = [None if gone else _cut_out(t, s)[0].decode(errors="ignore") for t, s, gone in zip(texts, column(batch, "spans").to_pylist(), none, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["row", "text"])

    out = marked.mapInArrow(run, nullable(schema))
    return out.select(*[F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def op6_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 400-byte strings: counts, a digest and the text that is left."""
    return repeat_report(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_run_length_repeats": op6_run_length_repeats}
ORACLES: dict[str, str] = {}
