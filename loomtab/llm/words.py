"""Vectorised words, lines and shingles over an Arrow text buffer: no Python string is made."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15
_Q = U(0xC2B2AE3D27D4EB4F)

_powers, _inverses = np.ones(1, U), np.ones(1, U)

#: Bytes 0x20 and 0x09 to 0x0D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


_BLOCKS = 1 << 19


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, alike wherever they stand and of whatever batch.

    Each 8 bytes go through ``mix`` together with their place in the span before they are added up, so no pattern of
    the text cancels out as it does in a polynomial of bytes.  Spans are taken in portions of bounded memory.
    """
    padded = np.zeros(-(-len(data) // 8) * 8 + 8, np.uint8)
    padded[: len(data)] = data
    table = padded.view("<u8")
    out = np.zeros(len(starts), U)
    size = ends - starts
    count = -(-size // 8)
    upto = np.cumsum(count)
    at = 0
    while at < len(starts):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + _BLOCKS, "right")))
        out[at:to] = _hash_portion(table, starts[at:to], size[at:to], count[at:to])
        at = to
    return out


def _hash_portion(table: np.ndarray, starts: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    ends = np.cumsum(count)
    total = int(ends[-1])
    step = np.arange(total) - np.repeat(ends - count, count)
    at = np.repeat(starts, count) + 8 * step
    shift = (at & 7).astype(U) << U(3)
    at >>= 3
    block = (table[at] >> shift) | (table[np.minimum(at + 1, len(table) - 1)] << U(1) << (U(63) - shift))
    # the last block of a span may be short
    short = np.flatnonzero(size & 7)
    tail = ends[short] - 1
    block[tail] &= (U(1) << ((size[short] & 7).astype(U) << U(3))) - U(1)
    sums = np.zeros(total + 1, U)
    np.cumsum(mix(block ^ mix((step + 1).astype(U) * _Q)), out=sums[1:])
    return mix(sums[ends] - sums[ends - count] + size.astype(U) * _Q)


def powers(n: int) -> np.ndarray:
    """P**0 to P**n modulo 2**64."""
    global _powers
    if len(_powers) <= n:
        full = np.full(max(n + 1, 1 << 16), _P, U)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def inverse(n: int) -> np.ndarray:
    """P**0 to P**-n modulo 2**64 (P is odd)."""
    global _inverses
    if len(_inverses) <= n:
        full = np.full(max(n + 1, 1 << 16), pow(_P, -1, 1 << 64), U)
        full[0] = 1
        _inverses = np.multiply.accumulate(full)
    return _inverses


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] = sum over j < i of (data[j] + 1) * P**j."""
    out = np.zeros(len(data) + 1, U)
    if len(data):
        np.cumsum((data.astype(U) + U(1)) * powers(len(data))[: len(data)], out=out[1:])
    return out


def gram_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of short spans (some tens of bytes) from a prefix hash, alike wherever they stand.

    A polynomial modulo 2**64: of long spans, regular patterns share values, so only ``span_hash`` tells those apart.
    """
    # brought to one exponent by an inverse power, so that position doesn't count
    return mix((h[ends] - h[starts]) * inverse(len(h) - 1)[starts] + (ends - starts).astype(U) * _Q)


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first): words of document i are first[i] to first[i + 1]; no word crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, document) of the lines that \\n separates."""
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cuts + 1])
    ends = np.concatenate([cuts, offsets[1:]])
    starts.sort()
    ends.sort()
    doc = np.repeat(np.arange(len(offsets) - 1), np.bincount(np.searchsorted(offsets, cuts, "right") - 1, minlength=len(offsets) - 1) + 1) if len(offsets) > 1 else np.zeros(0, np.int64)
    return starts, ends, doc


def windows(hashes: np.ndarray, first: np.ndarray, size: int):
    """(hash, start word, document) of each run of ``size`` words within a document."""
    n = len(hashes) - size + 1
    docs = len(first) - 1
    if n <= 0 or docs <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(docs), np.diff(first))
    ok = doc[:n] == doc[size - 1 :]
    total = hashes[:n].copy()
    for i in range(1, size):
        total = (total ^ total >> U(29)) * _Q + hashes[i : i + n]
    at = np.flatnonzero(ok)
    return mix(total[at] + U(size)), at, doc[at]


def shingles(data: np.ndarray, offsets: np.ndarray, size: int):
    """Distinct shingle hashes of each document, ascending: (values, first).

    A-Z count as a-z.  A document with fewer words than ``size`` has its whole sequence as one shingle; without
    a word it has none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hash(data, starts, ends)
    found, _, doc = windows(hashes, first, size)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), U)
        for i in range(size - 1):
            has = counts[short] > i
            extra[has] = (extra[has] ^ extra[has] >> U(29)) * _Q + hashes[first[short[has]] + i]
        found = np.concatenate([found, mix(extra + U(1 << 40) + counts[short].astype(U))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(offsets)))
