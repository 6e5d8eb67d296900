"""Best-fit packing of token sequences with certified partitions.

Pieces are dealt to partitions of bounded size; each packs its own by best-fit decreasing and computes a lower
bound on its sequences from dual feasible functions.  A partition that meets its bound is certified; it keeps all but
its roomiest sequence.  The others close their fullest sequences.  The pieces of what is left open are dealt anew among
all partitions and packed again, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import vocabulary, worker_cache
from .runtime import cut, nullable, prepare, slices

#: Tokens of a sequence; pieces of one partition (the deal is by hash, so about); rounds of exchange.
CAPACITY, PART_ROWS, ROUNDS = 4096, 100_000, 3


def dual_feasible_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """A number of bins that no packing can be below.

    The largest over two families of dual feasible functions: with threshold e, lengths over capacity - e count as
    full and those under e as nothing; with k, a length counts floor((k + 1) x) / k, or itself where (k + 1) x is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    many, bulk = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    e = np.arange(0, capacity // 2 + 1)
    full = many[-1] - many[np.minimum(capacity - e + 1, capacity + 1)]
    middle = bulk[np.minimum(capacity - e + 1, capacity + 1)] - bulk[e]
    best = max(best, int((full + -(-middle // capacity)).max()))
    for k in range(1, 65):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the given order: the fullest bin that still has room, else a new one."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms, used = 0, 0  # bit r of rooms: some bin has room r
    for i, n in enumerate(lengths.tolist()):
        fitting = rooms >> n
        if n and fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            own = by_room[room]
            b = own.pop()
            if not own:
                rooms ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            own = by_room.setdefault(left, [])
            own.append(b)
            rooms |= 1 << left
    return bins, offsets


def token_pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): a row per piece of at most ``capacity`` tokens.

    A document's tokens are those of its text and ``end_id``; null counts as empty, so every row has a piece.
    Only documents over ``capacity`` tokens are cut.
    """
    prepare(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = dict(slim.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(vocabulary(path, "word_bpe_49k.json"), spaced=False)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                flat, at = cache(part.column(1))
                raw = np.insert(flat, at[1:], end_id).astype("<u4")
                size = np.diff(at) + 1
                base = np.cumsum(size) - size
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                blob = memoryview(raw.tobytes())
                crc = [zlib.crc32(blob[4 * a : 4 * (a + n)]) for a, n in zip((base[row] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return slim.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def underfull(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Per bin, whether it goes back: the roomiest bins, as few as hold nine tenths of all room; a full one never does."""
    room = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
    order = np.argsort(-room, kind="stable")
    total = np.cumsum(room[order])
    back = np.zeros(len(room), bool)
    back[order[: int(np.searchsorted(total, 0.9 * total[-1])) + 1]] = True
    return back & (room > 0)


def _pack_round(rows: DataFrame, turn: int, part_rows: int, capacity: int) -> DataFrame:
    """Deal (row, length) to partitions and pack each: adds sequence_id, offset and ``back``.

    ``back`` marks the rows of sequences that go back: the underfull ones of a partition over its bound, one of another; ``closed`` and ``opened``, on one
    row of each partition, count the sequences that stay and those that go back.
    """
    parts = max(1, -(-rows.count() // part_rows))
    # the rows come from files, so their running numbers are the same when a task runs again; equal rows fall apart
    dealt = rows.select("row", "length", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts)).alias("part"), F.monotonically_increasing_id().alias("number"))

    def pack(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((table["number"].to_numpy(), -lengths))
        table, lengths = table.take(pa.array(order)), lengths[order]
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        back = underfull(bins, lengths, capacity)
        if used <= dual_feasible_bound(lengths, capacity):
            # certified: alone it can't do better, and only its roomiest sequence may meet those of others
            back &= (np.arange(used) == np.argmin(np.bincount(bins, weights=lengths))) & (parts > 1)
        first = np.arange(len(bins)) == 0
        number = (np.int64(turn) << 56) + (table["part"].to_numpy() << 24) + bins
        added = {"sequence_id": number, "offset": offsets, "back": back[bins], "closed": first * int((~back).sum()), "opened": first * int(back.sum())}
        table = table.select(["row", "length"])
        for name, values in added.items():
            table = table.append_column(name, pa.array(values))
        return table

    schema = nullable(rows.select("row", "length", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset")], F.lit(True).alias("back"), *[F.lit(0).cast("long").alias(c) for c in ("closed", "opened")]).schema)
    return cut(dealt.groupBy("part").applyInArrow(pack, schema))


def pack_pieces(items: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Offsets of a sequence are gapless from 0.  Repeated rows are packed each; an empty table stays empty.  Only
    ``sequence_id`` and ``offset`` may not be columns already; ``length`` must not be null.
    """
    prepare(items.sparkSession)
    names = items.columns
    if {"sequence_id", "offset"} & set(names):
        raise ValueError("columns sequence_id and offset must be new")
    rows = cut(items.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("length").cast("long").alias("length")))
    packed = _pack_round(rows, 0, part_rows, capacity)
    final = []
    for turn in range(1, rounds + 1):
        opened = packed.agg(F.sum("opened")).first()[0]
        if not opened:
            break
        # what lies in underfull sequences meets anew; full ones are closed
        again = _pack_round(packed.where("back").select("row", "length"), turn, part_rows, capacity)
        used = again.agg(F.sum(F.col("closed") + F.col("opened"))).first()[0]
        if used >= opened:
            break
        final.append(packed.where("not back"))
        packed = again
    for f in final:
        packed = packed.unionByName(f)
    return packed.select(*[F.col("row").getField(n).alias(n) for n in names], "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return pack_pieces(token_pieces(docs))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLES: dict[str, str] = {}
