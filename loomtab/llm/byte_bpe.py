"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each leaf holds the rank of the pair that starts at a live byte position, each inner node the leftmost
minimum below it.  The root names the next merge; a merge rewrites three leaves (the merged position, its
live left neighbour, the position that vanished) in logarithmically many nodes.  Short words run in lanes,
one numpy row per word; a word over ``LANE`` bytes runs alone, with the same tree in a compact array.
"""

from __future__ import annotations

from array import array
import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceCache, vocabulary
from .runtime import column, nullable, prepare, slices

LANE = 128
_FREE = np.int64(1) << np.int64(60)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBPE:
    """Merges by rank: the ids of a word are those of its bytes after all merges, lowest rank and leftmost first.

    A word that is itself a token is that token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _FREE where a side is missing (-1) or the pair makes no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], _FREE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(words)
        lanes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is not None:
                out[i] = [known]
            elif not w:
                out[i] = []
            elif len(w) > LANE:
                out[i] = self.encode_long(w)
            else:
                lanes.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in lanes.items():
            for k in range(0, len(members), 8192):
                part = members[k : k + 8192]
                for i, ids in zip(part, self._lanes([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _lanes(self, words: list[bytes], width: int) -> list[list[int]]:
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte[raw], -1)
        after = np.minimum(np.tile(np.arange(1, width + 2), (n, 1)), size[:, None])
        after = np.where(after >= size[:, None], width, after)
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _FREE, np.int64)
        pos = np.arange(width)
        rank = self._rank(ids[:, :width], np.take_along_axis(ids, after[:, :width], 1))
        tree[:, width:] = np.where(rank < _FREE, rank * width + pos, _FREE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = np.flatnonzero(tree[:, 1] < _FREE)
        while len(live):
            root = tree[live, 1]
            p = root % width
            gone = after[live, p]
            right = after[live, gone]
            left = before[live, p]
            token = root // width
            ids[live, p] = token
            ids[live, gone] = -1
            after[live, p] = right
            before[live, right] = p
            has = left >= 0
            left_id = np.where(has, ids[live, left], -1)
            leaf = np.stack([p, gone, np.where(has, left, p)])
            new_p = self._rank(token, ids[live, right])
            new_l = self._rank(left_id, token)
            value_p = np.where(new_p < _FREE, new_p * width + p, _FREE)
            value_l = np.where(has, np.where(new_l < _FREE, new_l * width + left, _FREE), value_p)
            node = leaf + width
            tree[live, node[0]] = value_p
            tree[live, node[1]] = _FREE
            tree[live, node[2]] = value_l
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
            live = live[tree[live, 1] < _FREE]
        flat = ids[:, :width]
        kept = flat >= 0
        values, ends = flat[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [values[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_long(self, word: bytes) -> list[int]:
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        free, pairs = int(_FREE), self.pairs
        # compact arrays: some 30 bytes for each byte of the word
        first = self.byte[np.frombuffer(word, np.uint8)]
        leaves = np.full(2 * width, _FREE, np.int64)
        rank = self._rank(first[:-1], first[1:])
        leaves[width : width + n - 1] = np.where(rank < _FREE, rank * width + np.arange(n - 1), _FREE)
        level = width
        while level > 1:
            np.minimum(leaves[level : 2 * level : 2], leaves[level + 1 : 2 * level : 2], out=leaves[level // 2 : level])
            level //= 2
        tree = array("q")
        tree.frombytes(memoryview(leaves).cast("B"))
        del leaves, rank
        ids, after, before = array("i", first.astype(np.int32).tobytes()), array("i", np.minimum(np.arange(1, n + 2, dtype=np.int32), n).tobytes()), array("i", np.arange(-1, n, dtype=np.int32).tobytes())
        ids.append(-1)

        def put(p: int, value: int) -> None:
            node = width + p
            tree[node] = value
            node >>= 1
            while node:
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    return
                tree[node] = value
                node >>= 1

        while tree[1] < free:
            token, p = divmod(tree[1], width)
            gone = after[p]
            right, left = after[gone], before[p]
            ids[p], ids[gone], after[p] = token, -1, right
            if right < n:
                before[right] = p
            put(gone, free)
            rank = pairs.get(token << 32 | ids[right]) if right < n else None
            put(p, free if rank is None else rank * width + p)
            if left >= 0:
                rank = pairs.get(ids[left] << 32 | token)
                put(left, free if rank is None else rank * width + left)
        return [x for x in ids if x >= 0]


class _Coder:
    """A worker's encoder of pieces: distinct pre-tokens are merged once per call."""

    def __init__(self, path: str | None, pattern: str | None):
        import public_tokenizers
        import regex

        self.bpe = SegmentTreeBPE(load_ranks(vocabulary(path, "byte_bpe_50k.tiktoken")))
        self.find = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.known: dict[str, list[int]] = {}
        self.cache = PieceCache(self.encode, spaced=True)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        split = [self.find(p) for p in pieces]
        if len(self.known) > 300_000:
            self.known = {}
        fresh = list({w for words in split for w in words if w not in self.known})
        self.known.update(zip(fresh, self.bpe.encode_words([w.encode() for w in fresh]), strict=True))
        known = self.known
        return [known[w[0]] if len(w) == 1 else [i for x in w for i in known[x]] for w in split]


_coders: dict[tuple, _Coder] = {}


def _coder(path: str | None, pattern: str | None) -> _Coder:
    if (path, pattern) not in _coders:
        _coders.clear()
        _coders[path, pattern] = _Coder(path, pattern)
    return _coders[path, pattern]


def bpe_encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Replace column ``text`` by binary ``ids``: its token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (an empty binary).  Other columns, rows and repeats stay as they are; an
    empty table stays empty.  ``ids`` must not name another column.  ``path`` is a rank file.
    """
    if ids in df.columns and ids != text:
        raise ValueError(f"column {ids} exists")
    prepare(df.sparkSession)
    keep = [c for c in df.columns if c != text]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))
    names = [*keep, ids]
    schema = df.select(*[F.col(f"`{c}`") for c in keep], F.lit(b"").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                flat, at = coder.cache(column(part, text))
                blob = flat.astype("<u4").tobytes()
                out = pa.array([blob[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), out], names=names)

    return df.mapInArrow(run, nullable(schema))


def bpe_decode(df: DataFrame, ids: str = "ids", out: str = "bytes", path: str | None = None) -> DataFrame:
    """Add binary ``out``: the bytes of the tokens in ``ids``.  Null ids give empty bytes; an id without a token is an error."""
    prepare(df.sparkSession)
    names = [*df.columns, out]
    schema = df.withColumn(out, F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {v: k for k, v in load_ranks(vocabulary(path, "byte_bpe_50k.tiktoken")).items()}
        look = table.__getitem__
        for batch in batches:
            for part in slices(batch, ids):
                got = [b"".join(map(look, np.frombuffer(x or b"", "<u4").tolist())) for x in column(part, ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=names)

    return df.mapInArrow(run, nullable(schema))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: digests of both."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_decode(bpe_encode(docs))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
ORACLES: dict[str, str] = {}
