import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from loomtab.llm.byte_bpe import SegmentTreeBPE, bpe_decode, bpe_encode, load_ranks, op10_byte_bpe


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a  b", "x \n y", "tab\tand\x1c\x85 end ", "<|endoftext|> it's 12345 ré日本語🙂", "a" * 300, "ab" * 5000, "\n\n  lead", "two words", None]


def test_matches_library(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in bpe_decode(bpe_encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode_ordinary(t or ""), t
        assert bytes(got[i].bytes).decode() == (t or "")


def test_long_and_lanes_agree():
    bpe = SegmentTreeBPE(load_ranks(P.path("byte_bpe_50k.tiktoken")))
    words = [w.encode() for w in ("theaonering", "ioneraux", "éèlechou", "zzqx", "abcabcabc" * 9)]
    assert [bpe.encode_long(w) for w in words] == bpe.encode_words(words)


@pytest.mark.parametrize("n", [129, 1000, 30_000])
def test_words_without_an_end(library, n):
    bpe = SegmentTreeBPE(load_ranks(P.path("byte_bpe_50k.tiktoken")))
    r = np.random.default_rng(n)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "ä日e"):
        word = "".join(r.choice(list(letters), n))
        assert bpe.encode_long(word.encode()) == library.encode_ordinary(word)


def test_whole_table(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe_encode(df).columns == ["doc_id", "lang", "ids"] and bpe_encode(df).count() == 0
    with pytest.raises(ValueError):
        bpe_encode(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int"))
