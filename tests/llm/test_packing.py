import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtab.llm import packing as K
from loomtab.llm.pieces import library_cache


def fewest(lengths, capacity):
    n = len(lengths)
    for bins in range(1, n + 1):
        for where in product(range(bins), repeat=n):
            if all(sum(x for x, w in zip(lengths, where) if w == b) <= capacity for b in range(bins)):
                return bins
    return 0


def test_bound_and_packing_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        lengths = [r.randint(1, 12) for _ in range(r.randint(1, 6))]
        best = fewest(lengths, 12)
        order = np.array(sorted(lengths, reverse=True))
        bins, offsets = K.best_fit_decreasing(order, 12)
        assert K.dual_feasible_bound(order, 12) <= best <= bins.max() + 1
    assert K.dual_feasible_bound(np.array([7] * 10), 12) == 10  # more than total length says


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_exchange_saves_sequences(spark):
    r = random.Random(2)
    lengths = [r.choice([700, 650, 400, 333, 301]) for _ in range(600)]
    df = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long")
    alone = K.pack_pieces(df, 1000, part_rows=10, rounds=0).collect()
    exchanged = K.pack_pieces(df, 1000, part_rows=10, rounds=6).collect()
    assert sorted((x.doc_id, x.length) for x in exchanged) == list(enumerate(lengths))
    assert check(exchanged, 1000) < check(alone, 1000)
    assert check(exchanged, 1000) >= K.dual_feasible_bound(np.array(lengths), 1000)


def test_full_sequences_stay_and_others_go_back():
    lengths = np.array([10, 6, 4, 9, 5, 5, 3])
    bins = np.array([0, 1, 1, 2, 3, 3, 4])
    assert K.underfull(bins, lengths, 10).tolist() == [False, False, True, False, True]
    assert not K.underfull(np.array([0]), np.array([10]), 10).any()


def test_rows_fall_from_round_to_round(spark, monkeypatch):
    r = random.Random(5)
    lengths = [r.choice([400, 350, 333, 290, 10, 9]) for _ in range(3000)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    seen, plain = [], K._pack_round
    monkeypatch.setattr(K, "_pack_round", lambda rows, *a: seen.append(rows.count()) or plain(rows, *a))
    out = K.pack_pieces(df, 1000, part_rows=300).collect()
    assert sorted((x.doc_id, x.length) for x in out) == list(enumerate(lengths))
    check(out, 1000)
    assert seen[0] == 3000 and len(seen) > 1 and all(b < a for a, b in zip(seen, seen[1:]))


def test_clashing_names_and_equal_rows(spark):
    df = spark.createDataFrame([(5, [1], 7)] * 90, "length int, part array<int>, row int").withColumn("back", F.lit("x")).withColumn("opened", F.lit(None).cast("int"))
    out = K.pack_pieces(df, 10, part_rows=20)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and out.drop("sequence_id", "offset").exceptAll(df).isEmpty()
    assert check(out.collect(), 10) <= 46
    with pytest.raises(ValueError):
        K.pack_pieces(df.withColumn("offset", F.lit(1)))


def test_words_are_held_in_lower_case():
    cache, tokenizer = library_cache(P.path("word_bpe_49k.json"), spaced=False, limit=500), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    cache(["Oak oak OAK oAk \u00c9t\u00c9 \u00e9T\u00e9"])
    assert list(cache.known) == ["oak", " oak", " \u00e9t\u00e9"]  # were six
    # capitals that may compose with what follows: lower H and U+0331 do, upper ones don't
    r = random.Random(5)
    parts = ["H", "h", "J", "T", "W", "I", "\u0331", "\u030c", "\u0308", "\u030a", "\u0307", "\u00c4", "\u00e4", "\u00de", "\u00d7", "\u00f7", "\u0130", "\u0410", "\u0419", "\u0439", "\u03a3", "\u1e9e", "\u00df", "ab", "AB", "'S", "'s", "1", ".", " ", "\n", "|", "\u0483", "\u212a"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(4000)]
    for k in range(0, len(texts), 400):
        ids, at = cache(texts[k : k + 400])
        for i, t in enumerate(texts[k : k + 400]):
            assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b"), (4, "a b"), (None, "x")]
    pieces = K.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"))
    got = K.pack_pieces(pieces)
    out = got.collect()
    assert len([x for x in out if x.doc_id == 4]) == 2 and [x.length for x in out if x.doc_id in (1, 2)] == [1, 1]
    assert sorted((x.piece, x.start, x.length) for x in out if x.doc_id == 3) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    check(out, 4096)
    assert K.pack_pieces(pieces.limit(0)).count() == 0


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = K.op8_best_fit_packing(spark, sf).collect()
    used = check(rows, 4096)
    want, total = [], 0
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        want += [(i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert used <= -(-total // 4096) * 1.01 + 1
