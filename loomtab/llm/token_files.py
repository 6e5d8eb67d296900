"""Token-id files: blocks of ids in a context-mixing entropy code.

A block holds whole documents, or a piece of one longer than a block, and is coded on its own: all models start anew
and checksums cover the ids and the code.  Per id, the orders vote on the id that last followed the two ids before
it: the success so far of order 2 in this context, of order 1 (does it expect the same?), and of order 0 (how often the
block's table says that the id comes) are mixed in the logistic domain by weights fitted to the block.  Failing that, they vote
alike on the id that order 1 offers; failing that, order 0 is all that is left to tell, and the id lies in its interval of the
block's frequencies, which stand at its head.  What a context knows follows from the ids alone, so the encoder finds it for whole
blocks by a sort; weights and success rates, fitted to every id of the block, stand at the head too.  The decoder computes in
integers, so a file decodes alike on any machine, and its blocks run in lanes: one numpy operation decodes a step of all blocks at
hand.  All intervals go into asymmetric numeral systems, which are filled from the end: one of the votes, and one of the literal
ids, whose intervals depend on no context.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import vocabulary, worker_cache
from .runtime import cut, prepare, shuffle_parts, slices

#: Ids of a block at most; blocks coded together.
BLOCK, LANES = 4096, 2048
#: Atoms of texts that a worker holds with their ids.
ATOMS = 400_000
MAGIC = b"LMT4"
#: Blocks whose models are computed together in the encoder: their arrays fit a core's cache.
_GROUP = 16
#: Slots of an id before, and of two, in a block; ids of a block are known by their place in its table.
_SLOTS1, _SLOTS2, _SYMBOLS = 1024, 1024, 4096
#: Intervals are 32,768ths; of order 0 an id of a block has a 4096th at least, by which the decoder looks ids up.
_BITS, _BITS0 = 15, 12
#: A vote of all three orders at most, in 4096ths of a logit; its probability for each 128th, in 32,768ths.
_WEIGHT, _VOTE = 1024, 3 * 1024 * 127
_SQUASH = np.clip(np.rint((1 << _BITS) / (1 + np.exp(-np.arange(-(_VOTE >> 5) - 1, (_VOTE >> 5) + 2) / 128))), 32, (1 << _BITS) - 32).astype(np.int32)
_ZERO = (_VOTE >> 5) + 1
#: The first place is that of a vote on no id.  Of order 1's id: less, so that something is left for the others.
_SQUASH[0] = 0
_GUESS = np.minimum(_SQUASH, (1 << _BITS) - 1024)
_NEVER = -(1 << 28)
#: What a context knows: 0 nothing, 1 an id, then whether its last (2, 3) or its last two guesses (4 to 7) were right.
_NEXT = np.array([1, 1, 2, 3, 4, 5, 6, 7, 4, 5, 6, 7, 4, 5, 6, 7], np.int32)
#: Counts from which an id of the table is more habitual by one.  What no id is: the last place, but as habitual as can be.
_HABIT = np.array([2, 4, 8, 16, 32, 64, 128])
_NOTHING = (7 << 12 | 4095) << 3


class BlockError(ValueError):
    """A block that is not whole."""


def _active(lens: np.ndarray) -> list[int]:
    """The lanes still running at each step; the longest come first."""
    return (len(lens) - np.searchsorted(lens[::-1], np.arange(int(lens[0]) if len(lens) else 0), "right")).tolist()


def _order0(counts: np.ndarray, many: np.ndarray | None = None, bits: int = _BITS0) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each id's interval, in 4096ths; at most 4096 ids were counted, so none is empty.

    With ``many`` the counts are those of several blocks, one after the other, with so many ids each.
    """
    many = np.array([len(counts)]) if many is None else many
    first, total = np.cumsum(many) - many, np.append(0, np.cumsum(counts))
    before, after = total[first], total[first + many]
    ends = (total[1:] - np.repeat(before, many) << bits) // np.repeat(np.maximum(after - before, 1), many)
    start = np.append(0, ends)[:-1]
    start[first[many > 0]] = 0
    return start, ends - start


def _numbers_out(values: np.ndarray) -> bytes:
    """Numbers under 2^21, seven bits a byte, the last byte of each without the high bit."""
    return _numbers_of(values)[0]


def _numbers_of(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes of all numbers, bytes of each)."""
    two, three = np.flatnonzero(values > 0x7F), np.flatnonzero(values > 0x3FFF)
    size = np.ones(len(values), np.int64)
    size[two] = 2
    size[three] = 3
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = values & 127
    out[at[two]] |= 128
    out[at[two] + 1] = values[two] >> 7 & 127
    out[at[three] + 1] |= 128
    out[at[three] + 2] = values[three] >> 14
    return out.tobytes(), size


def _numbers_in(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).astype(np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127) << 7 * place, first) if len(first) else data


# ---- what is known of a block before its ids are coded --------------------------------------------------------


def _stretch(hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Logits in 16ths of the share of hits."""
    return np.clip(np.rint(16 * np.log((hits + 0.4) / (seen - hits + 0.4))), -127, 127).astype(np.int8)


def _followed(slot: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """Of every id, 8 times the id that last followed its context and what the context knew; ``slot``: block and context."""
    n = len(sym)
    key = slot << 20 | np.arange(n)
    key.sort()
    at = key & ((1 << 20) - 1)
    key >>= 20
    now = sym[at]
    again = np.zeros(n + 2, bool)  # two places more, so that the first have neighbours
    again[3:] = key[1:] == key[:-1]
    hit = np.zeros(n + 2, np.int32)
    hit[3:] = now[1:] == now[:-1]
    once, twice, more = again[2:], again[2:] & again[1:-1], again[2:] & again[1:-1] & again[:-2]
    state = np.where(more, 4 + 2 * hit[:-2] + hit[1:-1], np.where(twice, 2 + hit[1:-1], once))
    out = np.zeros(n, np.int32)
    before = np.zeros(n, np.int32)
    before[1:] = now[:-1]
    out[at] = np.where(once, before << 3 | state, _SYMBOLS << 3)
    return out


def _rates(cells: np.ndarray, axis: int) -> np.ndarray:
    """Each block's logits by one of the three things that its cells (lanes, three ways, miss or hit) tell apart."""
    by = cells.sum(tuple({1, 2, 3} - {axis}))
    return _stretch(by[:, :, 1], by.sum(2))


def _weights(cells: np.ndarray, rates: list[np.ndarray], start: list[float]) -> np.ndarray:
    """The weights of three logits in each block, in 256ths: logistic regression by Newton's method.

    Places whose logits are the same are one cell with their number, so that all places of the block count.
    """
    lanes = len(cells)
    seen = cells.sum(4)
    found = np.nonzero(seen)
    lane, n, hits = found[0], seen[found], cells[..., 1][found]
    x = [k[lane, at] / 16 for k, at in zip(rates, found[1:], strict=True)]
    w = np.tile(start, (lanes, 1))
    total = lambda v: np.bincount(lane, v, lanes)
    for _ in range(4):
        dot = x[0] * w[:, 0].take(lane) + x[1] * w[:, 1].take(lane) + x[2] * w[:, 2].take(lane)
        p = _SQUASH.take(np.rint(dot * 128).astype(np.int64) + _ZERO, mode="clip") / (1 << _BITS)
        error, much = hits - n * p, n * p * (1 - p)
        slope = np.stack([total(v * error) for v in x], 1) - 2 * (w - start)
        curve = np.zeros((lanes, 3, 3))
        for i in range(3):
            part = x[i] * much
            for j in range(i + 1):
                curve[:, i, j] = curve[:, j, i] = total(part * x[j])
        w = np.clip(w + np.linalg.solve(curve + 2 * np.eye(3), slope[:, :, None])[:, :, 0], -4, 4)
    return np.rint(256 * w).astype("<i2")


def _tables(weights: np.ndarray, rates: list[np.ndarray]) -> list[np.ndarray]:
    """Each order's part in both votes by what it knows; the second is on no id if order 1 has none, or the same as order 2."""
    t2, t1, t0, u2, u1, u0 = (weights[:, i, None].astype(np.int32) * k.astype(np.int32) for i, k in enumerate(rates))
    t2[:, 0] = _NEVER
    u1 = np.repeat(u1, 2, 1)
    u1[:, :2] = u1[:, 1::2] = _NEVER
    return [t.ravel() for t in (t2, t1, t0, u2, u1, u0)]


def _intervals(p: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The second interval's size: an id is order 2's in the first ``p`` 32,768ths, order 1's in those, else another."""
    return (((1 << _BITS) - p) * guess + 32767) >> _BITS


@dataclass
class _Modelled:
    """Blocks by their models: heads; intervals of all votes in order; literal ids of each block, and their intervals."""

    heads: list[bytes]
    start: np.ndarray
    size: np.ndarray
    literals: np.ndarray
    start0: np.ndarray
    size0: np.ndarray


def _model(blocks: list[np.ndarray]) -> _Modelled:
    """All contexts of some blocks at once: sorted by context, what it knew stands in the neighbouring rows."""
    lanes = len(blocks)
    lens = np.array([len(b) for b in blocks], np.int64)
    ids = np.concatenate(blocks).astype(np.int64)
    lane = np.repeat(np.arange(lanes), lens)
    begin = (np.cumsum(lens) - lens)[lens > 0]
    # each id's place in its block's table
    value = lane << 16 | ids
    there = np.zeros(lanes << 16, bool)
    there[value] = True
    distinct = np.flatnonzero(there)
    many = np.bincount(distinct >> 16, minlength=lanes)
    held = np.cumsum(many) - many
    rank = np.zeros(lanes << 16, np.int32)
    rank[distinct] = np.arange(len(distinct)) - np.repeat(held, many)
    sym = rank.take(value)
    a, b = np.zeros(len(sym), np.int64), np.zeros(len(sym), np.int64)
    a[1:] = sym[:-1]
    a[begin] = 0
    b[1:] = a[:-1]
    b[begin] = 0
    e2 = _followed(lane * _SLOTS2 | (a + 421 * b & (_SLOTS2 - 1)), sym)
    e1 = _followed(lane * _SLOTS1 | a & (_SLOTS1 - 1), sym)
    s2, s1, c2, c1 = e2 & 7, e1 & 7, e2 >> 3, e1 >> 3
    hit, same = sym == c2, c1 == c2
    hit1 = (sym == c1) & ~hit
    missed = np.flatnonzero(~(hit | hit1))
    place = np.repeat(held, lens)
    literal = (place + sym).take(missed)
    counts = np.bincount(literal, minlength=len(distinct))
    habit = np.searchsorted(_HABIT, counts, "right")
    h2, h1 = (habit.take(place + (c & (_SYMBOLS - 1)), mode="clip") for c in (c2, c1))
    n2, n1 = lane << 3 | s2, lane << 4 | s1 << 1 | same
    # every place at which a vote is on an id, by what the three orders know and by the outcome
    asked, asked1 = np.flatnonzero(s2 > 0), np.flatnonzero((s1 > 0) & ~same & ~hit)
    vote = ((n2 << 4 | s1 << 1 | same) << 3 | h2) << 1 | hit
    vote1 = ((n2 << 3 | s1) << 3 | h1) << 1 | hit1
    cells = np.bincount(vote.take(asked), minlength=lanes << 11).reshape(lanes, 8, 16, 8, 2)
    cells1 = np.bincount(vote1.take(asked1), minlength=lanes << 10).reshape(lanes, 8, 8, 8, 2)
    first, second = ([_rates(x, i) for i in (1, 2, 3)] for x in (cells, cells1))
    weights = np.concatenate([_weights(cells, first, [0.6, 0.4, 0.3]), _weights(cells1, second, [0.3, 0.7, 0.3])], 1)
    rates = [*first, *second]
    t2, t1, t0, u2, u1, u0 = _tables(weights, rates)
    p = _SQUASH.take((t2.take(n2) + t1.take(n1) + t0.take(lane << 3 | h2) >> 5) + _ZERO, mode="clip")
    guess = _GUESS.take((u2.take(n2) + u1.take(n1) + u0.take(lane << 3 | h1) >> 5) + _ZERO, mode="clip")
    both = p + _intervals(p, guess)
    start = np.where(hit, 0, np.where(hit1, p, both))
    size = np.where(hit, p, np.where(hit1, both, 1 << _BITS) - start)
    # heads: what the models need, then the table
    values = distinct & 0xFFFF
    gaps = np.diff(values, prepend=0)
    edge = held[many > 0]
    gaps[edge] = values[edge]
    ends = np.cumsum(many).tolist()
    raws = []
    for numbers in (gaps, counts):
        raw, width = _numbers_of(numbers)
        to = np.append(0, np.cumsum(width))
        raws.append([raw[to[e - n] : to[e]] for e, n in zip(ends, many.tolist(), strict=True)])
    heads = [zlib.compress(b"".join(x[i].tobytes() for x in (weights, *rates)) + raws[0][i] + raws[1][i], 1) for i in range(lanes)]
    start0, size0 = _order0(counts, many, _BITS)
    return _Modelled(heads, start.astype(np.uint16), size.astype(np.uint16), np.bincount(lane.take(missed), minlength=lanes), start0.take(literal).astype(np.uint16), size0.take(literal).astype(np.uint16))


#: Logits of the two votes by what orders 2, 1 and 0 know; bytes of a block's weights and logits, which stand before its table.
_WAYS = (8, 16, 8, 8, 8, 8)
_KNOWN = 12 + sum(_WAYS)


def _fold(lens: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[int], list[bytes]]:
    """(state, words) of each lane's intervals, which lie lane by lane: an asymmetric numeral system, filled from the end."""
    lanes = len(lens)
    order = np.argsort(-lens, kind="stable")
    longest = lens[order]
    steps = int(longest[0]) if lanes else 0
    first = np.cumsum(lens) - lens
    rect = np.zeros((2, steps, lanes), np.uint16)
    for i in range(0, lanes, 64):
        part = np.zeros((2, min(64, lanes - i), steps), np.uint16)
        for j, (x, n) in enumerate(zip(first[order[i : i + 64]].tolist(), longest[i : i + 64].tolist(), strict=True)):
            part[0, j, :n], part[1, j, :n] = start[x : x + n], size[x : x + n]
        rect[:, :, i : i + 64] = part.transpose(0, 2, 1)
    room = steps + 2
    out, at = np.zeros(lanes * room, "<u2"), np.arange(1, lanes + 1) * room - 1
    state = np.full(lanes, 1 << 16, np.int64)
    for t, k in zip(range(steps - 1, -1, -1), reversed(_active(longest)), strict=True):
        x, width, where = state[:k], rect[1, t, :k].astype(np.int64), at[:k]
        full = x >= width << (32 - _BITS)
        out[where] = x  # its last 16 bits; where the state is not full, the next word overwrites this one
        where -= full
        x = np.where(full, x >> 16, x)
        part = (x / width).astype(np.int64)  # exact: 32 by 16 bits
        np.subtract(1 << _BITS, width, out=width)
        width *= part
        x += width
        np.add(x, rect[0, t, :k], out=state[:k])
    states, words = np.zeros(lanes, np.int64), [b""] * lanes
    for i, (lane, x, y) in enumerate(zip(order.tolist(), state.tolist(), at.tolist(), strict=True)):
        states[lane], words[lane] = x, out[y + 1 : (i + 1) * room].tobytes()
    return states.tolist(), words


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block: sizes of its head and words, states of the votes and the literal ids, head, words of both."""
    found = [_model(blocks[k : k + _GROUP]) for k in range(0, len(blocks), _GROUP)]
    joined = lambda name: np.concatenate([getattr(m, name) for m in found])
    states, words = _fold(np.array([len(b) for b in blocks], np.int64), joined("start"), joined("size"))
    states0, words0 = _fold(joined("literals"), joined("start0"), joined("size0"))
    heads = [h for m in found for h in m.heads]
    return [struct.pack("<IIII", len(h), len(w), x, y) + h + w + v for h, w, v, x, y in zip(heads, words, words0, states, states0, strict=True)]


def _literals(counts: list[np.ndarray], words: list[bytes], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(literal ids of all blocks, where each block's begin): places in its table and, above 12 bits, how habitual they are."""
    many, size = (np.array([f(c) for c in counts], np.int64) for f in (len, np.sum))
    count = np.concatenate([*counts, np.zeros(0, np.int64)])
    start, width = _order0(count, many, _BITS)
    end = start + width
    entry = (np.arange(len(count)) - np.repeat(np.cumsum(many) - many, many) | np.searchsorted(_HABIT, count, "right") << 12).astype(np.int16)
    # in whose interval each 4096th of a block begins; no other but the next can begin in it too
    low = _BITS - _BITS0
    slot = np.repeat(np.arange(len(count), dtype=np.int32), (end + (1 << low) - 1 >> low) - (start + (1 << low) - 1 >> low))
    order = np.argsort(-size, kind="stable")
    lens, state = size[order], states[order]
    row = ((np.cumsum(size > 0) - 1) << _BITS0)[order]
    data, word_at = np.frombuffer(b"".join([*words, b"\0\0"]), "<u2"), (np.cumsum([0, *map(len, words)])[:-1] // 2)[order]
    steps = int(lens[0]) if len(lens) else 0
    out = np.zeros((steps, len(lens)), np.int16)
    for t, k in enumerate(_active(lens)):
        x, where = state[:k], word_at[:k]
        v = x & ((1 << _BITS) - 1)
        e = slot.take(row[:k] + (v >> low))
        e += v >= end.take(e)
        out[t, :k] = entry.take(e)
        v -= start.take(e)
        y = x >> _BITS
        y *= width.take(e)
        y += v
        few = y < 1 << 16
        np.copyto(x, y)
        y <<= 16
        y |= data.take(where, mode="clip")
        np.copyto(x, y, where=few)
        where += few
    at = np.zeros(len(lens), np.int64)
    at[order] = np.arange(len(lens)) * steps
    return np.append(out.T.ravel(), np.int16(0)), at


def _decode(lens: np.ndarray, codes: list[bytes]) -> np.ndarray:
    """The ids of each block, longest first, as [lanes, steps]."""
    lanes, steps = len(lens), int(lens[0]) if len(lens) else 0
    heads, words, words0, known, counts = [], [], [], [], []
    state, state0 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for lane, code in enumerate(codes):
        n, m, state[lane], state0[lane] = struct.unpack("<IIII", code[:16])
        head = zlib.decompress(code[16 : 16 + n])
        heads.append(head[:_KNOWN])
        gaps, own = np.split(_numbers_in(head[_KNOWN:]), 2)
        known.append(np.cumsum(gaps))
        counts.append(own)
        words.append(code[16 + n : 16 + n + m])
        words0.append(code[16 + n + m :])
    literals, literal_at = _literals(counts, words0, state0)
    raw = np.frombuffer(b"".join(heads), np.uint8).reshape(lanes, _KNOWN)
    ends = np.cumsum([12, *_WAYS]).tolist()
    t2, t1, t0, u2, u1, u0 = _tables(np.ascontiguousarray(raw[:, :12]).view("<i2"), [np.ascontiguousarray(raw[:, i:j]).view(np.int8) for i, j in zip(ends[:-1], ends[1:], strict=True)])
    data, word_at = np.frombuffer(b"".join([*words, b"\0\0"]), "<u2"), np.cumsum([0, *map(len, words)])[:-1] // 2
    # 8 times the id that last followed a context, and what the context knows
    after2, after1 = np.full(lanes * _SLOTS2, _NOTHING, np.int32), np.full(lanes * _SLOTS1, _NOTHING, np.int32)
    every = np.arange(lanes)
    base2, base1, by8, by16 = every * _SLOTS2, every * _SLOTS1, every * 8, every * 16
    a, b = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    out = np.zeros((steps, lanes), np.int16)
    last = 0
    for t, k in enumerate(_active(lens)):
        if k != last:
            # rows: where the three intervals begin and end; the ids they stand for
            last, bounds, offer, own = k, np.zeros((4, k), np.int32), np.zeros((3, k), np.int32), every[:k]
            bounds[3] = 1 << _BITS
            ends, p, both = bounds[1:].ravel(), bounds[1], bounds[2]
            begins, c2, c1, b2, b1, b8, b16 = bounds.ravel(), offer[0], offer[1], base2[:k], base1[:k], by8[:k], by16[:k]
            a, b, x, at, where = a[:k], b[:k], state[:k], literal_at[:k], word_at[:k]
        i2 = b2 + (a + b & (_SLOTS2 - 1))
        i1 = b1 + (a & (_SLOTS1 - 1))
        e2, e1 = after2.take(i2, mode="clip"), after1.take(i1, mode="clip")
        np.right_shift(e2, 3, out=c2)
        np.right_shift(e1, 3, out=c1)
        s2, s1 = e2 & 7, (e1 & 7) << 1
        n1 = b16 + (s1 | (c1 == c2))
        n2 = b8 + s2
        dot = t2.take(n2, mode="clip")
        dot += t1.take(n1, mode="clip")
        dot += t0.take(b8 + (c2 >> 12), mode="clip")
        dot >>= 5
        dot += _ZERO
        _SQUASH.take(dot, mode="clip", out=p)
        dot = u2.take(n2, mode="clip")
        dot += u1.take(n1, mode="clip")
        dot += u0.take(b8 + (c1 >> 12), mode="clip")
        dot >>= 5
        dot += _ZERO
        np.add(p, _intervals(p, _GUESS.take(dot, mode="clip")), out=both)
        v = x & ((1 << _BITS) - 1)
        beyond, miss = v >= p, v >= both
        way = own + k * beyond
        way += k * miss
        begin = begins.take(way, mode="clip")
        v -= begin
        y = x >> _BITS
        y *= ends.take(way, mode="clip") - begin
        y += v
        low = y < 1 << 16
        np.copyto(x, y)
        y <<= 16
        y |= data.take(where, mode="clip")
        np.copyto(x, y, where=low)
        where += low
        literals.take(at, mode="clip", out=out[t, :k])
        offer[2] = out[t, :k]
        at += miss
        now = offer.ravel().take(way, mode="clip")
        out[t, :k] = now
        coded = now << 3
        s2 <<= 1
        after2[i2] = coded | _NEXT.take(s2 + ~beyond.view(np.int8) + 2, mode="clip")
        after1[i1] = coded | _NEXT.take(s1 | (now == c1), mode="clip")
        b = a * np.int32(421)
        a = now
    sizes = np.array([len(x) for x in known], np.int64)
    every_id = np.concatenate([*known, np.zeros(1, np.int64)]).astype(np.int32)
    return every_id.take((out.T & (_SYMBOLS - 1)) + (np.cumsum(sizes) - sizes)[:, None])


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of up to ``BLOCK`` ids (each under 65,536): magic, count, CRC-32 of the ids and of the code, code."""
    if any(len(x) > BLOCK or len(x) and x.max() > 0xFFFF for x in blocks):
        raise ValueError(f"a block holds at most {BLOCK} ids under 65,536")
    out: list[bytes] = [b""] * len(blocks)
    for i in range(0, len(blocks), LANES):
        part = blocks[i : i + LANES]
        for x, code in enumerate(_encode(part)):
            raw = part[x].astype("<u4").tobytes()
            out[i + x] = MAGIC + struct.pack("<III", len(part[x]), zlib.crc32(raw), zlib.crc32(code)) + code
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids (little-endian unsigned 32-bit) of each block; BlockError if a checksum fails."""
    out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(blocks)
    for i in range(0, len(blocks), LANES):
        part = blocks[i : i + LANES]
        heads = []
        for x in part:
            if x[:4] != MAGIC or len(x) < 16:
                raise BlockError("no block")
            heads.append(struct.unpack("<III", x[4:16]))
            if zlib.crc32(x[16:]) != heads[-1][2]:
                raise BlockError("checksum of the code")
        order = sorted(range(len(part)), key=lambda x: -heads[x][0])
        lens = np.array([heads[x][0] for x in order], np.int64)
        ids = _decode(lens, [part[x][16:] for x in order])
        for lane, x in enumerate(order):
            own = ids[lane, : lens[lane]].astype("<u4")
            if zlib.crc32(own.tobytes()) != heads[x][1]:
                raise BlockError("checksum of the ids")
            out[i + x] = own
    return out


def write_token_blocks(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Rows of a token file: (part, block, docs, code), documents in ascending id order.

    ``part`` ascends with the ids, ``block`` within a part.  ``docs`` lists the block's documents: id, number within
    the part, piece, ids.  A document's ids are those of its text (null: none) and ``end_id``.  Null ids come first;
    rows that repeat an id stand side by side.
    """
    prepare(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    dealt = slim.repartitionByRange(shuffle_parts(df.sparkSession), "id").sortWithinPartitions("id")
    entry = pa.struct([("id", pa.int64()), ("seq", pa.int64()), ("piece", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        cache = worker_cache(vocabulary(path, "byte_bpe_50k.json"), spaced=True, limit=ATOMS)
        blocks: list[np.ndarray] = []
        tables: list[list[dict]] = []
        held: list[np.ndarray] = []
        listed: list[dict] = []
        room, seq, first = BLOCK, 0, 0

        def close() -> None:
            nonlocal held, listed, room
            if held:
                blocks.append(np.concatenate(held))
                tables.append(listed)
                held, listed, room = [], [], BLOCK

        def rows() -> pa.RecordBatch:
            nonlocal first
            codes = encode_blocks(blocks)
            n = len(blocks)
            out = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(tables, pa.list_(entry)), pa.array(codes, pa.binary())], names=["part", "block", "docs", "code"])
            first += n
            blocks.clear()
            tables.clear()
            return out

        for batch in batches:
            for piece_of in slices(batch, "text"):
                flat, at = cache(piece_of.column(1))
                for doc, a, b in zip(piece_of.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = np.append(flat[a:b], np.uint32(end_id))
                    if len(ids) > room:
                        close()
                    for piece, k in enumerate(range(0, len(ids), BLOCK)):
                        own = ids[k : k + BLOCK]
                        held.append(own)
                        listed.append({"id": doc, "seq": seq, "piece": piece, "n": len(own)})
                        room -= len(own)
                        if k + BLOCK < len(ids):
                            close()
                    seq += 1
                while len(blocks) >= LANES:
                    yield rows()
        close()
        if blocks:
            yield rows()

    return dealt.mapInArrow(run, "part int, block long, docs array<struct<id: long, seq: long, piece: int, n: int>>, code binary")


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """(part, id, seq, piece, ids) of every document or piece; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            got = decode_blocks(table["code"].to_pylist())
            docs = table["docs"].combine_chunks()
            flat = docs.flatten()
            row = np.repeat(np.arange(len(got)), np.diff(docs.offsets.to_numpy()))
            part = table["part"].combine_chunks().take(pa.array(row))
            raw = b"".join(x.tobytes() for x in got)
            ends = np.cumsum(flat.field(3).to_numpy()) * 4
            for k in range(0, len(ends), 2000):
                stop = ends[k : k + 2000].tolist()
                start = [int(ends[k - 1]) if k else 0, *stop[:-1]]
                own = slice(k, k + 2000)
                yield pa.RecordBatch.from_arrays([part[own], flat.field(0)[own], flat.field(1)[own], flat.field(2)[own], pa.array([raw[a:b] for a, b in zip(start, stop, strict=True)], pa.binary())], names=["part", "id", "seq", "piece", "ids"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LANES:
                yield from rows()
                held = []
        if held:
            yield from rows()

    return blocks.mapInArrow(run, "part int, id long, seq long, piece int, ids binary")


@cache
def _zero_bytes(power: int) -> list[int]:
    """What 2^power zero bytes make of each bit of the CRC-32 register."""
    if power < 0:
        return [0xEDB88320, *(1 << i for i in range(31))]
    matrix = _zero_bytes(power - 1)
    for _ in range(1 if power else 3):
        matrix = [_times(matrix, row) for row in matrix]
    return matrix


def _times(matrix: list[int], v: int) -> int:
    total = 0
    while v:
        total ^= matrix[(v & -v).bit_length() - 1]
        v &= v - 1
    return total


def _shift_crc(crc: int, zeros: int) -> int:
    """The CRC-32 register after so many more zero bytes, by their number's powers of two."""
    for power in range(zeros.bit_length()):
        if zeros >> power & 1:
            crc = _times(_zero_bytes(power), crc)
    return crc


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (CRC-32, bytes) of its parts."""
    crc, size = parts[0]
    for more, n in parts[1:]:
        crc = _shift_crc(crc, n) ^ more
    return crc


def token_index(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document of a token file, from its decoded ids."""
    pieces = read_token_blocks(blocks).select("part", "id", "seq", "piece", (F.octet_length("ids") / 4).cast("long").alias("n"), F.crc32("ids").alias("crc"))
    pieces = cut(pieces)
    whole = pieces.groupBy("part", "seq").agg(F.first("id").alias("id"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("piece", "crc", "n"))).alias("pieces"))
    long, short = whole.where(F.size("pieces") > 1), whole.where(F.size("pieces") == 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [join_crcs([(p["crc"], 4 * p["n"]) for p in x]) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(crc, pa.int64())], names=["part", "seq", "id", "n", "crc"])

    joined = long.mapInArrow(run, "part int, seq long, id long, n long, crc long")
    docs = joined.unionByName(short.select("part", "seq", "id", "n", F.col("pieces")[0]["crc"].alias("crc")))
    # a row for each part: their number is that of the file's partitions
    totals = pieces.groupBy("part").agg(F.sum("n").alias("ids"))
    before = totals.withColumn("base", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).drop("ids")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")
    placed = docs.withColumn("inside", inside).join(F.broadcast(before), "part")
    return placed.select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op3_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to a token file in doc_id order, read back and indexed."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return token_index(cut(write_token_blocks(docs)))


QUERIES = {"op3_mixing_coder": op3_mixing_coder}
ORACLES: dict[str, str] = {}
