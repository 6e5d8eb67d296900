import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtab.llm import token_files as T
from loomtab.llm.pieces import library_cache, vocabulary


def blocks():
    r = np.random.default_rng(1)
    out = [r.integers(0, top, n).astype(np.uint32) for top, n in ((65536, 700), (50000, 1), (5, 4096), (300, 2000), (1, 4096), (40, 33))]
    return out + [np.tile(np.arange(17, dtype=np.uint32), 200), np.array([65535] * 50, np.uint32)]


def test_round_trip_alone_and_together(monkeypatch):
    want = blocks()
    together = T.encode_blocks(want)
    assert all((a == b).all() for a, b in zip(T.decode_blocks(together), want, strict=True))
    monkeypatch.setattr(T, "LANES", 1)
    assert T.encode_blocks(want) == together  # a block's code depends on nothing else
    assert all((a == b).all() for a, b in zip(T.decode_blocks(together), want, strict=True))
    assert len(together[6]) < 600 and len(together[4]) < 200


def test_broken_blocks_are_found():
    code = T.encode_blocks(blocks()[3:4])[0]
    for i in (0, 5, 9, 13, 20, len(code) - 1):
        broken = bytearray(code)
        broken[i] ^= 4
        with pytest.raises((T.BlockError, struct.error)):
            T.decode_blocks([bytes(broken)])


def test_order0_intervals_and_table():
    r = np.random.default_rng(4)
    for counts in (np.array([4096]), np.ones(4096, np.int64), np.ones(700, np.int64), np.array([1, 4094, 1]), np.zeros(0, np.int64), r.integers(1, 9, 500)):
        start, size = T._order0(counts)
        assert (size >= 1).all() and size.sum() == (4096 if len(counts) else 0) and (start == np.cumsum(size) - size).all()
    values = np.concatenate([[0, 127, 128, 16383, 16384, 65535], r.integers(0, 65536, 500)])
    assert (T._numbers_in(T._numbers_out(values)) == values).all() and len(T._numbers_in(T._numbers_out(values[:0]))) == 0
    # ids that are all different, and a block's code that is all table
    want = [r.permutation(65536)[:4096].astype(np.uint32), np.array([], np.uint32), np.arange(61440, 65536, dtype=np.uint32)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(T.decode_blocks(T.encode_blocks(want)), want, strict=True))


def test_a_step_of_all_lanes_takes_few_operations():
    """Both directions, in gathers of as many lanes: four adaptive steps for an id took 1800 of them."""
    r = np.random.default_rng(6)
    want = [(500 * r.random(400) ** 3 * 100).astype(np.uint32) for _ in range(512)]
    table, at = np.arange(1 << 16), r.integers(0, 1 << 16, 512)

    def seconds(run):
        found = []
        for _ in range(3):
            begin = time.process_time()
            run()
            found.append(time.process_time() - begin)
        return min(found)

    gather = seconds(lambda: [table[at] for _ in range(20_000)]) / 20_000
    spent = seconds(lambda: T.decode_blocks(T.encode_blocks(want))) / 400
    assert spent < 1300 * gather, spent / gather


def test_long_documents_are_joined_in_few_operations():
    """The register's matrices are made once: a piece took over 500 microseconds."""
    T.join_crcs([(1, 16384), (2, 16383)])
    begin = time.process_time()
    for i in range(1000):
        T.join_crcs([(i, 16384), (7 * i, 16384), (3, 4 * (i + 1))])
    assert time.process_time() - begin < 0.5


def test_blocks_that_no_table_holds_are_refused():
    for block in (np.zeros(4097, np.uint32), np.array([65536], np.uint32)):
        with pytest.raises(ValueError):
            T.encode_blocks([block])


def test_ids_that_context_tells_are_not_literal():
    r = np.random.default_rng(3)
    phrase = r.integers(0, 50000, 200)
    told = np.concatenate([np.concatenate([phrase, r.integers(0, 50000, 5)]) for _ in range(19)]).astype(np.uint32)
    free = r.permutation(told)
    a, b = T.encode_blocks([told, free])
    assert len(a) < len(b) / 2 and all((x == y).all() for x, y in zip(T.decode_blocks([a, b]), (told, free), strict=True))


def test_weights_count_every_place():
    """Every eighth place is noise: weights fitted to those places only made 2,156 bytes of this block."""
    r = np.random.default_rng(8)
    told = np.tile(r.integers(0, 50000, 128), 32)
    told[7::8] = r.integers(0, 50000, 512)
    code = T.encode_blocks([told.astype(np.uint32)])
    assert len(code[0]) < 2080 and (T.decode_blocks(code)[0] == told).all()


def test_literal_ids_are_entropy_coded():
    """Nothing but order 0 tells these ids: classes of ranks and plain bits made 4,978 bytes of the block."""
    r = np.random.default_rng(8)
    r.integers(0, 50000, 640)
    p = 1 / np.arange(1, 1201) ** 0.9
    free = r.choice(1200, 4096, p=p / p.sum()).astype(np.uint32)
    code = T.encode_blocks([free])[0]
    made = T._model([free])
    ideal = -np.log2(made.size0 / 32768).sum() / 8
    n, m = struct.unpack("<II", code[16:24])
    assert len(code) < 4960 and made.literals[0] > 3900 and abs(len(code) - 32 - n - m - ideal) < 4
    assert (T.decode_blocks([code])[0] == free).all()


def test_both_votes_are_mixed():
    """The vote on order 1's id has weights of its own at the head, and they are fitted to the block."""
    r = np.random.default_rng(5)
    pairs = np.where(r.random(2000) < 0.5, 7, r.integers(100, 900, 2000))
    block = np.stack([r.integers(0, 3, 2000), pairs], 1).ravel().astype(np.uint32)
    made = T._model([block])
    assert (made.size > 0).all() and (T.decode_blocks(T.encode_blocks([block]))[0] == block).all()
    w = np.frombuffer(zlib.decompress(made.heads[0])[:12], "<i2")
    assert len(w) == 6 and (w[3:] != np.rint(256 * np.array([0.3, 0.7, 0.3]))).any()


def test_crc_of_parts():
    r = random.Random(0)
    for _ in range(20):
        parts = [r.randbytes(r.randint(0, 300)) for _ in range(r.randint(1, 5))]
        assert T.join_crcs([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


ODD = ["", " ", "a  b", "x \n y", "tab\tand\x1c\x85 end ", "<|endoftext|> it's 12345 ré日本語🙂 ÀÉ é x́", "a | b || c|d", "\n\n  lead", None, "Σας ΑΣ İ ı ſ ﬁ K", "a b   c", " lead | ", "|", "́ ́a", "​ x​y ﻿", "Word, WORD. word!? ×÷ straße"]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, spaced):
    cache, tokenizer = library_cache(vocabulary(None, name), spaced, limit=20), Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    for _ in range(2):
        ids, at = cache(ODD)
        for i, t in enumerate(ODD):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


def want(rows):
    tokenizer, out, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), [], 0
    tokenizer.encode_special_tokens = True
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, "long text, " * 4000), (51, None), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).orderBy(F.rand(3))
    got = T.token_index(T.write_token_blocks(df)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want(rows)
    assert T.token_index(T.write_token_blocks(df.limit(0))).count() == 0


def test_whole_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, T.op3_mixing_coder(spark, sf).collect())) == want(rows)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_atoms_of_random_texts(name, spaced):
    r = random.Random(7)
    parts = [" ", " ", "\n", "\n", "a", "Word", "it's", "é", "ß", "×", "Привет", "日本", "1", "23", ".", ",", "!?", "***", "'", "_", "|", "\t", "\r\n", " ", "́", " ", "<|endoftext|>", "🙂"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    cache, tokenizer = library_cache(vocabulary(None, name), spaced, limit=500), Tokenizer.from_file(P.path(name))
    tokenizer.encode_special_tokens = True
    for k in range(0, len(texts), 300):
        ids, at = cache(texts[k : k + 300])
        for i, t in enumerate(texts[k : k + 300]):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
