"""FLAC media columns: lossless 8-bit mono streams, decoded by lanes of frames.

A stream holds STREAMINFO (with the MD5 of its samples), a SEEKTABLE with a point for every frame, and frames
of ``BLOCK`` samples with constant, verbatim, fixed or linear-prediction subframes and partitioned Rice codes.
Frames are independent, so numpy works on many at once: one row of a matrix per sample position, one column
per frame.  A sample is the byte less 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import column, nullable, prepare, slices, text_bytes

#: Samples of a frame; the last of a stream may be shorter.
BLOCK = 576
RATE = 8000
#: Order, coefficient bits and partition order that the encoder uses; the decoder takes any.
ORDER, PRECISION, PARTITIONS = 4, 9, 2
#: Frames worked on at once.
LANES = 1536
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


class FlacError(ValueError):
    """A stream that is not whole."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for b in range(256):
        x = b << (bits - 8)
        for _ in range(8):
            x = (x << 1) ^ poly if x >> (bits - 1) & 1 else x << 1
            x &= (1 << bits) - 1
        out.append(x)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_shifted = _CRC16[None, :].copy()


def _crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each span: the remainder is linear, so each byte adds its own, by its distance from the end."""
    global _shifted
    lens = ends - starts
    longest = int(lens.max())
    while len(_shifted) < longest:
        last = _shifted[-1]
        _shifted = np.vstack([_shifted, ((last.astype(np.uint32) << 8) & 0xFFFF).astype(np.uint16) ^ _CRC16[last >> 8]])
    total = np.cumsum(lens)
    first = total - lens
    step = np.arange(int(total[-1]))
    at = step + np.repeat(starts - first, lens)
    far = np.repeat(total - 1, lens) - step
    return np.bitwise_xor.reduceat(_shifted.ravel()[far * 256 + data[at]], first)


def _crc8(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    x = np.zeros(len(rows), np.uint16)
    for i in range(rows.shape[1]):
        x = np.where(i < lens, _CRC8[(x ^ rows[:, i]) & 255], x)
    return x


def _frame_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in FLAC's UTF-8-like code: (bytes [frames, 6], lengths)."""
    size = 1 + sum((n >= limit).astype(np.int64) for limit in (0x80, 0x800, 0x10000, 0x200000, 0x4000000))
    out = np.zeros((len(n), 6), np.int64)
    for k in range(1, 7):
        rows = np.flatnonzero(size == k)
        if not len(rows):
            continue
        v = n[rows]
        if k == 1:
            out[rows, 0] = v
            continue
        for i in range(k - 1, 0, -1):
            out[rows, i] = 0x80 | v & 0x3F
            v = v >> 6
        out[rows, 0] = (0xFF << (7 - k) & 0xFF if k < 7 else 0xFE) | v
        out[rows, 0] &= 0xFF
    return out, size


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor of each column by Levinson-Durbin: (coefficients [ORDER, frames], shifts)."""
    f = x.astype(np.float32)
    n = len(f)
    r = [np.einsum("tf,tf->f", f[lag:], f[: n - lag], dtype=np.float64) for lag in range(ORDER + 1)]
    error = r[0] * 1.0001 + 1
    a = np.zeros((ORDER, x.shape[1]))
    for i in range(ORDER):
        k = (r[i + 1] - sum((a[j] * r[i - j] for j in range(i)), np.zeros(x.shape[1]))) / error
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-3)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(0), 1e-6))), 0, PRECISION - 1).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)), -top - 1, top).astype(np.int32), shift


def _encode_group(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of a matrix [samples, frames] of int32, all of one length."""
    n, lanes = samples.shape
    order_of = np.zeros(lanes, np.int64)
    kind = np.zeros(lanes, np.int64)  # 0 fixed, 1 linear, 2 verbatim, 3 constant
    best = np.abs(samples).sum(0, dtype=np.int64)
    residual = samples.copy()
    coefs, shift = None, np.zeros(lanes, np.int64)
    candidates = []
    if n > ORDER:
        d1 = samples[1:] - samples[:-1]
        candidates += [(0, 1, d1), (0, 2, d1[1:] - d1[:-1])]
        coefs, shift = _linear(samples)
        pred = coefs[0] * samples[ORDER - 1 : -1]
        for j in range(1, ORDER):
            pred += coefs[j] * samples[ORDER - 1 - j : n - 1 - j]
        candidates.append((1, ORDER, samples[ORDER:] - (pred >> shift.astype(np.int32))))
    for what, order, res in candidates:
        cost = np.abs(res).sum(0, dtype=np.int64) + 40 * order
        take = np.flatnonzero(cost < best)
        best[take] = cost[take]
        kind[take], order_of[take] = what, order
        residual[order:, take] = res[:, take]
    kind[(samples == samples[:1]).all(0)] = 3
    order_of[kind == 3] = 0

    parts = 1 << PARTITIONS if n % (1 << PARTITIONS) == 0 and n >> PARTITIONS > ORDER else 1
    each = n // parts
    u = (residual << 1) ^ (residual >> 31)
    time = np.arange(n)[:, None]
    warm = time < order_of
    u[warm] = 0
    counts = np.full((parts, lanes), each)
    counts[0] -= order_of
    mean = u.reshape(parts, each, lanes).sum(1) / np.maximum(counts, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1))), 0, 14).astype(np.int32)
    k = np.repeat(rice, each, axis=0)
    bits = (u >> k) + 1 + k
    bits[warm] = 0

    coded, size = _frame_number(numbers)
    short = n != BLOCK
    head = 4 + size + 2 * short + 1
    linear_bits = np.where(kind == 1, 9 + order_of * PRECISION, 0)
    body = 8 + 8 * order_of + linear_bits + 6 + 4 * parts + bits.sum(0, dtype=np.int64)
    plain = 8 + 8 * n
    kind[(kind < 2) & (body >= plain)] = 2
    body = np.select([kind == 2, kind == 3], [plain, 16], body)
    whole = head + (body + 7) // 8 + 2
    ends = np.cumsum(whole)
    starts = ends - whole

    at: list[np.ndarray] = []
    values: list[np.ndarray] = []

    def put(end: np.ndarray, value: np.ndarray) -> None:
        """Add a field of at most 16 bits that ends before bit ``end``."""
        last = (end - 1) >> 3
        moved = value.astype(np.int64) << (7 - ((end - 1) & 7))
        for i in range(3):
            part = (moved >> (8 * i)) & 255
            has = np.flatnonzero(part)
            at.append((last - i)[has])
            values.append(part[has])

    rows = np.zeros((lanes, 4 + 6 + 2), np.int64)
    rows[:, 0], rows[:, 1] = 0xFF, 0xF8
    rows[:, 2] = (0x70 if short else 0x20) | 0
    rows[:, 3] = 0x02
    rows[:, 4:10] = coded
    if short:
        lane = np.arange(lanes)
        rows[lane, 4 + size], rows[lane, 5 + size] = (n - 1) >> 8, (n - 1) & 255
    crc = _crc8(rows, head - 1)
    for i in range(rows.shape[1]):
        put(8 * (starts + i + 1), np.where(i < head - 1, rows[:, i], 0))
    put(8 * (starts + head), crc)
    pos = 8 * (starts + head)
    label = np.select([kind == 2, kind == 3, kind == 1], [1, 0, 32 + order_of - 1], 8 + order_of)
    put(pos + 8, label << 1)
    pos = pos + 8
    one = np.flatnonzero(kind == 3)
    if len(one):
        put(pos[one] + 8, samples[0, one] & 255)
    raw = np.flatnonzero(kind == 2)
    if len(raw):
        base = (pos[raw] >> 3) + time
        at.append(base.ravel())
        values.append((samples[:, raw] & 255).astype(np.int64).ravel())
    soft = np.flatnonzero(kind < 2)
    if len(soft):
        p, o = pos[soft], order_of[soft]
        for i in range(ORDER):
            has = np.flatnonzero(o > i)
            put(p[has] + 8 * (i + 1), samples[i, soft[has]] & 255)
        p = p + 8 * o
        lin = np.flatnonzero(kind[soft] == 1)
        if len(lin):
            q = p[lin]
            put(q + 4, np.full(len(lin), PRECISION - 1))
            put(q + 9, shift[soft[lin]])
            for j in range(ORDER):
                put(q + 9 + PRECISION * (j + 1), coefs[j, soft[lin]] & ((1 << PRECISION) - 1))
            p[lin] += 9 + PRECISION * ORDER
        put(p + 6, np.full(len(soft), parts.bit_length() - 1))
        p = p + 6
        b = bits[:, soft] if len(soft) < lanes else bits
        end = np.cumsum(b, axis=0, dtype=np.int64) + p + 4 * (1 + time // each)
        opening = np.concatenate([p[None, :], end[each - 1 :: each][:-1]])
        for i in range(parts):
            put(opening[i] + 4, rice[i, soft])
        kk, uu = (k[:, soft], u[:, soft]) if len(soft) < lanes else (k, u)
        tail = (1 << kk) | (uu & ((1 << kk) - 1))
        live = np.flatnonzero((b > 0).ravel())
        put(end.ravel()[live], tail.ravel()[live])
    out = np.bincount(np.concatenate(at), weights=np.concatenate(values), minlength=int(ends[-1])).astype(np.uint8)
    check = _crc16(out, starts, ends - 2)
    out[ends - 2], out[ends - 1] = check >> 8, check & 255
    blob = out.tobytes()
    return [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def encode_streams(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream of each byte string; an empty one has no frame."""
    sizes = np.diff(offsets)
    frames = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = offsets[:-1][stream] + number * BLOCK
    length = np.minimum(BLOCK, offsets[1:][stream] - start)
    coded: list[bytes] = [b""] * len(stream)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        for i in range(0, len(own), LANES):
            lanes = own[i : i + LANES]
            samples = data[start[lanes] + np.arange(int(n))[:, None]].astype(np.int32) - 128
            for lane, frame in zip(lanes.tolist(), _encode_group(samples, number[lanes]), strict=True):
                coded[lane] = frame
    out, at = [], 0
    signed = (data ^ 0x80).tobytes()
    for i, count in enumerate(frames.tolist()):
        own, at = coded[at : at + count], at + count
        lens = [len(x) for x in own]
        n = int(sizes[i])
        info = BLOCK.to_bytes(2, "big") * 2 + min(lens, default=0).to_bytes(3, "big") + max(lens, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed[offsets[i] : offsets[i + 1]]).digest()
        points = np.zeros(count, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        points["sample"] = np.arange(count) * BLOCK
        points["offset"] = np.cumsum([0, *lens[:-1]]) if count else []
        points["samples"] = np.minimum(BLOCK, n - points["sample"].astype(np.int64))
        table = points.tobytes()
        out.append(b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


def _take(windows: np.ndarray, pos: np.ndarray, count) -> np.ndarray:
    """``count`` (up to 24) bits from bit ``pos`` of each lane."""
    word = windows[pos >> 3].astype(np.int64)
    return (word >> (32 - (pos & 7) - count)) & ((1 << np.asarray(count, np.int64)) - 1)


_LEAD = np.array([16 - i.bit_length() for i in range(1 << 16)], np.int64)


def _decode_group(data: np.ndarray, windows: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, head: np.ndarray) -> np.ndarray:
    """Samples [n, frames] of frames of one length whose headers have been read."""
    lanes = len(start)
    out = np.zeros((n, lanes), np.int32)
    pos = 8 * (start + head)
    label = data[pos >> 3].astype(np.int64)
    if (label & 0x81).any():
        raise FlacError("a subframe with wasted bits or a wrong mark")
    label >>= 1
    pos = pos + 8
    time = np.arange(n)[:, None]
    signed = data.view(np.int8)
    one, raw = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    if len(one):
        out[:, one] = signed[pos[one] >> 3]
    if len(raw):
        out[:, raw] = signed[(pos[raw] >> 3) + time]
    soft = np.flatnonzero(((label >= 8) & (label <= 12)) | (label >= 32))
    if len(one) + len(raw) + len(soft) != lanes:
        raise FlacError("a reserved subframe type")
    if not len(soft):
        return out
    label, p = label[soft], pos[soft]
    linear = label >= 32
    order = np.where(linear, label - 31, label - 8)
    deepest = int(order.max())
    res = np.zeros((n, len(soft)), np.int64)
    coef = np.zeros((max(deepest, 1), len(soft)), np.int64)
    for i in range(deepest):
        has = np.flatnonzero(order > i)
        res[i, has] = signed[(p[has] >> 3) + i]
    p = p + 8 * order
    shift = np.zeros(len(soft), np.int64)
    for o, c in FIXED.items():
        own = np.flatnonzero(~linear & (order == o))
        for j in range(len(c) if len(own) else 0):
            coef[j, own] = c[j]
    lin = np.flatnonzero(linear)
    if len(lin):
        precision = _take(windows, p[lin], 4) + 1
        shift[lin] = _take(windows, p[lin] + 4, 5)
        q = p[lin] + 9
        for j in range(int(order[lin].max())):
            has = order[lin] > j
            c = _take(windows, q[has], precision[has])
            coef[j, lin[has]] = c - ((c >> (precision[has] - 1)) << precision[has])
            q[has] += precision[has]
        p[lin] = q
    method, split = _take(windows, p, 2), _take(windows, p + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved residual code")
    p = p + 6
    wide = 4 + method
    each = n >> split
    if ((each << split) != n).any():
        raise FlacError("partitions that don't divide the block")
    k, width = np.zeros(len(soft), np.int64), np.full(len(soft), -1)
    uniform = bool((each == each[0]).all())
    for t in range(n):
        opens = t % each[0] == 0 if uniform else None
        if opens is None or opens:
            new = np.flatnonzero(t % each == 0) if opens is None else slice(None)
            k[new] = _take(windows, p[new], wide[new])
            escape = k == (1 << wide) - 1
            p[new] += wide[new]
            width[new] = -1
            if escape.any():
                raw_new = np.flatnonzero(escape & (t % each == 0))
                width[raw_new] = _take(windows, p[raw_new], 5)
                p[raw_new] += 5
        skip = t < deepest and (order > t).any()
        special = bool((width >= 0).any())
        own = np.flatnonzero((order <= t) & (width < 0)) if skip or special else slice(None)
        at, kk = p[own], k[own]
        word = windows[at >> 3].astype(np.int64) << (at & 7) & 0xFFFFFFFF
        lead = _LEAD[word >> 16]
        q = lead
        if (lead == 16).any():
            q = lead.copy()
            far = np.flatnonzero(lead == 16)
            while len(far):
                word_far = windows[(at[far] + q[far]) >> 3].astype(np.int64) << ((at[far] + q[far]) & 7) & 0xFFFFFFFF
                more = _LEAD[word_far >> 16]
                q[far] += more
                far = far[more == 16]
                if len(far) and int((at[far] + q[far]).max()) > 8 * len(data):
                    raise FlacError("a code beyond the end")
        at = at + q + 1
        rest = (windows[at >> 3].astype(np.int64) >> (32 - (at & 7) - kk)) & ((1 << kk) - 1)
        u = q << kk | rest
        res[t, own] = (u >> 1) ^ -(u & 1)
        p[own] = at + kk
        if special:
            bare = np.flatnonzero((order <= t) & (width >= 0))
            v = _take(windows, p[bare], width[bare])
            res[t, bare] = v - np.where(width[bare] > 0, (v >> np.maximum(width[bare] - 1, 0)) << width[bare], 0)
            p[bare] += width[bare]
    if ((p + 7) // 8 != end[soft] - 2).any():
        raise FlacError("residuals that end elsewhere than their frame")
    for t in range(1, n):
        depth = min(t, deepest)
        pred = coef[0] * res[t - 1]
        for j in range(1, depth):
            pred += coef[j] * res[t - 1 - j]
        pred >>= shift
        if t < deepest:
            pred[order > t] = 0
        res[t] += pred
    if (res.min() < -128) or (res.max() > 127):
        raise FlacError("a sample beyond 8 bits")
    out[:, soft] = res
    return out


def decode_streams(streams: list[bytes | None]) -> list[tuple[bytes, np.ndarray] | None]:
    """(PCM as unsigned bytes, sample offset of every block) of each stream; None stays None.

    Header CRC-8, frame CRC-16, frame numbers and the stream's MD5 are verified: FlacError tells what is broken.
    """
    blob = b"".join(s or b"" for s in streams)
    data = np.frombuffer(blob + bytes(16), np.uint8)
    starts, ends, sizes, counts, md5s = [], [], [], [], []
    base = 0
    for s in streams:
        if s is None:
            counts.append(0)
            sizes.append(0)
            md5s.append(b"")
            continue
        if s[:4] != b"fLaC" or len(s) < 46 or s[4] & 127:
            raise FlacError("no stream info")
        rate_bits = int.from_bytes(s[18:26], "big")
        if rate_bits >> 36 & 0xFF != 7:
            raise FlacError("not 8-bit mono")
        sizes.append(rate_bits & (1 << 36) - 1)
        md5s.append(s[26:42])
        at, last, table = 42, s[4] >> 7, b""
        while not last:
            last, kind, long = s[at] >> 7, s[at] & 127, int.from_bytes(s[at + 1 : at + 4], "big")
            if kind == 3:
                table = s[at + 4 : at + 4 + long]
            at += 4 + long
        points = np.frombuffer(table, [("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
        held = points["samples"].astype(np.int64)
        if int(held.sum()) != sizes[-1] or (points["sample"].astype(np.int64) != np.cumsum(held) - held).any():
            raise FlacError("the seek table doesn't cover the stream")
        own = base + at + points["offset"].astype(np.int64)
        starts.append(own)
        ends.append(np.append(own[1:], base + len(s)) if len(own) else own)
        counts.append(len(own))
        base += len(s)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else start
    count = np.array(counts, np.int64)
    pcm = np.zeros(sum(sizes), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    stream = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    if len(start):
        wide = data.astype(np.uint32)
        windows = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 3] != 0x02).any():
            raise FlacError("no frame where the seek table has one")
        coded, size = _frame_number(number)
        code = data[start + 2].astype(np.int64) >> 4
        extra = np.select([code == 6, code == 7], [1, 2], 0)
        head = 4 + size + extra + 1
        rows = data[start[:, None] + np.arange(13)].astype(np.int64)
        lane = np.arange(len(start))
        if any((np.where(i < size, rows[:, 4 + i] != coded[:, i], False)).any() for i in range(6)):
            raise FlacError("frame numbers out of order")
        if (_crc8(rows, head - 1) != rows[lane, head - 1]).any():
            raise FlacError("header CRC-8")
        where = 4 + size
        n = np.select(
            [code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8],
            [192, 576 << np.maximum(code - 2, 0), rows[lane, where] + 1, (rows[lane, where] << 8 | rows[lane, where + 1]) + 1, 256 << np.maximum(code - 8, 0)],
        )
        for i in range(0, len(start), LANES):
            part = slice(i, i + LANES)
            crc = _crc16(data, start[part], end[part] - 2)
            if (crc != (data[end[part] - 2].astype(np.uint16) << 8 | data[end[part] - 1])).any():
                raise FlacError("frame CRC-16")
        total = np.cumsum(n)
        inside = total - n - np.repeat(np.concatenate([[0], total])[np.cumsum(count) - count], count)
        target = first[stream] + inside
        for size_n in np.unique(n):
            own = np.flatnonzero(n == size_n)
            for i in range(0, len(own), LANES):
                lanes = own[i : i + LANES]
                samples = _decode_group(data, windows, start[lanes], end[lanes], int(size_n), head[lanes])
                pcm[target[lanes] + np.arange(int(size_n))[:, None]] = (samples + 128).astype(np.uint8)
    signed = (pcm ^ 0x80).tobytes()
    plain = pcm.tobytes()
    out: list[tuple[bytes, np.ndarray] | None] = []
    at = 0
    for i, s in enumerate(streams):
        if s is None:
            out.append(None)
            continue
        a, b = int(first[i]), int(first[i + 1])
        if hashlib.md5(signed[a:b]).digest() != md5s[i]:
            raise FlacError("MD5 of the samples")
        out.append((plain[a:b], inside[at : at + counts[i]] if counts[i] else np.zeros(0, np.int64)))
        at += counts[i]
    return out


def _feature(pcm: bytes) -> str:
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "ms=0;peak=0;power=0;crossings=0"
    return f"ms={len(x) * 1000 // RATE};peak={int(np.abs(x).max())};power={int((x * x).sum()) // len(x)};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def flac_encode(df: DataFrame, payload: str = "payload", flac: str = "flac") -> DataFrame:
    """Replace binary ``payload`` by ``flac``, its stream.  Null stays null; an empty payload gives a stream without frames."""
    if flac in df.columns and flac != payload:
        raise ValueError(f"column {flac} exists")
    prepare(df.sparkSession)
    keep = [c for c in df.columns if c != payload]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{payload}`"))
    schema = df.withColumnRenamed(payload, flac).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, payload):
                raw = column(part, payload)
                streams = encode_streams(*text_bytes(raw))
                valid = raw.is_valid().to_pylist()
                out = pa.array([s if ok else None for s, ok in zip(streams, valid, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), out], names=[*keep, flac])

    return df.mapInArrow(run, nullable(schema))


def flac_decode(df: DataFrame, flac: str = "flac") -> DataFrame:
    """Add ``pcm`` (unsigned bytes), ``block_offsets`` (first sample of each block) and ``feature`` (of the samples).

    A null stream gives nulls.  A broken stream fails the job with FlacError.
    """
    prepare(df.sparkSession)
    new = ["pcm", "block_offsets", "feature"]
    if set(new) & set(df.columns):
        raise ValueError(f"columns {new} must be new")
    names = [*df.columns, *new]
    schema = df.select("*", F.lit(b"").alias("pcm"), F.array(F.lit(0).cast("long")).alias("block_offsets"), F.lit("").alias("feature")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, flac):
                got = decode_streams(column(part, flac).to_pylist())
                arrays = [
                    pa.array([g and g[0] for g in got], pa.binary()),
                    pa.array([g if g is None else g[1].tolist() for g in got], pa.list_(pa.int64())),
                    pa.array([g if g is None else _feature(g[0]) for g in got], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    return df.mapInArrow(run, nullable(schema))


def pcm_blocks(decoded: DataFrame, id_col: str, block: str = "block") -> DataFrame:
    """A row per PCM block: id, block number, ``sample_offset``, its bytes and ``samples``; null streams have no block."""
    each = decoded.select(F.col(f"`{id_col}`"), F.posexplode(blocks_of("pcm", "block_offsets")).alias(block, "b"))
    return each.select(id_col, block, "b.sample_offset", "b.pcm", "b.samples")


def blocks_of(pcm: str, offsets: str) -> Column:
    """The PCM as an array of blocks (sample_offset, samples, pcm): a reader seeks by the offset."""
    stop = lambda i: F.coalesce(F.get(offsets, i + 1), F.octet_length(pcm).cast("long"))
    return F.transform(offsets, lambda at, i: F.struct(at.alias("sample_offset"), (stop(i) - at).alias("samples"), F.substring(pcm, (at + 1).cast("int"), (stop(i) - at).cast("int")).alias("pcm")))


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as FLAC samples, read back, digested."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select("doc_id", raw.alias("raw")).withColumn("n_bytes", F.octet_length("raw").cast("long"))
    size = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / BLOCK)) * BLOCK
    pad = F.unhex(F.repeat(F.lit("FF"), (size - F.col("n_bytes")).cast("int")))
    payload = docs.select("doc_id", "n_bytes", F.concat("raw", pad).alias("payload"))
    read = flac_decode(flac_encode(payload))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pcm, -32, 32)")).alias("tail_crc32"),
        F.octet_length("flac").cast("long").alias("media_bytes"),
        F.sha2("flac", 256).alias("media_sha256"),
        "feature",
        F.size("block_offsets").alias("n_blocks"),
        F.element_at("block_offsets", -1).alias("last_block_offset"),
    )


QUERIES = {"op1_flac": op1_flac}
ORACLES: dict[str, str] = {}
