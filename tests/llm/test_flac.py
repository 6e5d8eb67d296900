import hashlib
import zlib

import numpy as np
import pytest

from loomtab.llm import flac as A


class Bits:
    def __init__(self, data):
        self.v, self.n, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, k):
        self.at += k
        return self.v >> (self.n - self.at) & ((1 << k) - 1)

    def signed(self, k):
        x = self.take(k)
        return x - (1 << k) if k and x >> (k - 1) else x


def plain_decode(s):
    """A scalar decoder written from the format's public description."""
    assert s[:4] == b"fLaC"
    at, last = 4, 0
    while not last:
        last, long = s[at] >> 7, int.from_bytes(s[at + 1 : at + 4], "big")
        if s[at] & 127 == 0:
            total = int.from_bytes(s[at + 14 : at + 22], "big") & (1 << 36) - 1
        at += 4 + long
    b, out = Bits(s[at:]), []
    while len(out) < total:
        assert b.take(15) == 0x7FFC and b.take(1) == 0
        code = b.take(4)
        assert b.take(4) == 0 and b.take(4) == 0 and b.take(3) == 1 and b.take(1) == 0
        lead = b.take(8)
        for _ in range(max(0, 8 - (~lead & 0xFF).bit_length() - 1) if lead >= 0xC0 else 0):
            assert b.take(2) == 2
            b.take(6)
        n = {2: 576}.get(code) or b.take(16) + 1
        b.take(8)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            coef, shift = A.FIXED.get(order, []), 0
            if kind >= 32:
                precision, shift = b.take(4) + 1, b.signed(5)
                coef = [b.signed(precision) for _ in range(order)]
            wide, split = (4, 5)[b.take(2)], b.take(4)
            for p in range(1 << split):
                k = b.take(wide)
                for _ in range((n >> split) - (order if p == 0 else 0)):
                    q = 0
                    while not b.take(1):
                        q += 1
                    u = q << k | b.take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(c * v for c, v in zip(coef, x[::-1])) >> shift))
        b.at = -(-b.at // 8) * 8 + 16
        out += x
    return bytes(v + 128 for v in out)


RNG = np.random.default_rng(7)
RAW = [b"", b"a", b"the quick brown fox " * 100, b"z" * 1300, bytes(range(256)) * 5, RNG.integers(0, 256, 2000).astype(np.uint8).tobytes(), b"\0\xff" * 700, bytes(np.cumsum(RNG.integers(-2, 3, 3000)).astype(np.uint8)), b"\xff" * 576]


def encode(raw):
    return A.encode_streams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def test_round_trip_and_plain_decoder():
    streams = encode(RAW)
    got = A.decode_streams(streams)
    for raw, stream, (pcm, offsets) in zip(RAW, streams, got, strict=True):
        assert pcm == raw == plain_decode(stream)
        assert offsets.tolist() == list(range(0, len(raw), A.BLOCK))
    assert len(streams[3]) < 300  # constant subframes


def test_every_flipped_byte_is_found():
    stream = encode([b"some words for a short stream, " * 9])[0]
    for i in range(42, len(stream)):
        broken = bytearray(stream)
        broken[i] ^= 0x10
        with pytest.raises((A.FlacError, IndexError, OverflowError, ValueError)):
            A.decode_streams([bytes(broken)])


def test_frame_grouping_does_not_matter(monkeypatch):
    want = encode(RAW)
    monkeypatch.setattr(A, "LANES", 2)
    assert encode(RAW) == want and [x[0] for x in A.decode_streams(want)] == RAW


def test_operator(spark):
    rows = [(i, x, "c") for i, x in enumerate(RAW)] + [(99, None, "c"), (1, b"a", "c")]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, lang string")
    decoded = A.flac_decode(A.flac_encode(df))
    got = {r.doc_id: r for r in decoded.collect()}
    assert decoded.count() == len(rows) and got[99].pcm is None and got[99].feature is None
    blocks = A.pcm_blocks(decoded, "doc_id").collect()
    for i, raw in enumerate(RAW[2:], 2):
        own = sorted((b.sample_offset, bytes(b.pcm), b.samples) for b in blocks if b.doc_id == i)
        assert b"".join(x[1] for x in own) == raw and all(raw[a : a + n] == p for a, p, n in own)
    assert A.flac_decode(A.flac_encode(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        A.flac_encode(df.withColumnRenamed("lang", "flac"))


def test_whole_table(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = A.op1_flac(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        payload = t + b"\xff" * ((-len(t)) % 576 if t else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
