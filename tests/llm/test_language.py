import math
import re
import zlib
from collections import Counter

import pytest

from loomtab.llm import language as L


def test_held_out_accuracy(spark, sf):
    rows = L.op9_language_id(spark, sf).where("held_out").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    train = spark.createDataFrame([(i, "the and of the words and", "en") for i in range(20)] + [(100 + i, "der und die wörter ßö", "de") for i in range(20)] + [(300, None, "en"), (301, "x", None)], "doc_id long, text string, lang string")
    model = L.fit_language_model(train)
    assert model.langs == ("de", "en")
    rows = [(1, None, "zz"), (2, "", "zz"), (3, "123 !? …", "zz"), (4, "the words", "zz"), (5, "wörterßö", "zz"), (6, "the words " * 50000, "zz"), (4, "the words", "zz"), (None, "die wörter", None)]
    got = L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "und", "en", "de", "en", "de"]
    with pytest.raises(ValueError):
        L.identify_language(spark.createDataFrame([("a", 0.5)], "text string, score double"), model)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    model = L.fit_language_model(df)
    assert L.identify_language(df, model).collect()[0].lang_pred == "und"
    assert L.identify_language(df.limit(0), model).count() == 0


def test_longest_known_ngram_wins(spark):
    df = spark.createDataFrame([(i, "abcde", "x") for i in range(5)] + [(9 + i, "abxyz", "y") for i in range(5)], "doc_id long, text string, lang string")
    model = L.fit_language_model(df)
    got = L.identify_language(spark.createDataFrame([(1, "zabcd"), (2, "qabxy")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["x", "y"]


def plain_words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")]


def brute(train, texts):
    """(language, score) of each text by dictionaries of strings."""
    langs = sorted({lang for _, lang in train})
    counts = {size: {} for size in (0, *L.NGRAMS)}
    for text, lang in train:
        for w in plain_words(text):
            for size, keys in [(0, [w]), *((n, [w[i : i + n] for i in range(len(w) - n + 1)]) for n in L.NGRAMS)]:
                for k in keys:
                    counts[size].setdefault(k, Counter())[lang] += 1
    logs = {}
    for size, found in counts.items():
        kept = {k: c for k, c in found.items() if sum(c.values()) >= L.MIN_COUNT or size == 1}
        total = {x: sum(c[x] for c in kept.values()) for x in langs}
        logs[size] = {k: [math.log((c[x] + 0.5) / (total[x] + 0.5 * max(len(kept), 1))) for x in langs] for k, c in kept.items()}

    def of_word(w):
        if w in logs[0]:
            return logs[0][w]
        rows = [next((logs[n][w[i : i + n]] for n in L.NGRAMS if i + n <= len(w) and w[i : i + n] in logs[n]), [-12.0] * len(langs)) for i in range(len(w))]
        return [sum(col) / len(rows) for col in zip(*rows, strict=True)]

    out = []
    for text in texts:
        if not text or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        words = plain_words(text)
        total = [sum(col) / math.sqrt(max(len(words), 1)) for col in zip(*map(of_word, words), strict=True)] if words else [0.0] * len(langs)
        p = [math.exp(x - max(total)) for x in total]
        out.append((langs[p.index(max(p))], max(p) / sum(p)))
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: r for r in L.op9_language_id(spark, sf).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    train = [(d.text, d.lang) for i, d in docs.items() if not held[i] and d.lang is not None and d.text is not None]
    assert len(train) < L.TRAIN_ROWS and set(out) == set(docs)
    for i, (lang, score) in zip(docs, brute(train, [d.text for d in docs.values()]), strict=True):
        assert out[i].held_out == held[i] and out[i].lang_pred == lang, i
        assert math.isclose(out[i].score, score, abs_tol=1e-9), i


def test_portions_change_nothing(monkeypatch):
    import numpy as np

    r = np.random.default_rng(1)
    letters = list("abcdeäöß日本")
    train = ["".join(r.choice([*letters, " "], 300)) for _ in range(30)]
    keys, logs = [], []
    for size in (0, *L.NGRAMS):
        grams = sorted({g for t in train for w in plain_words(t) for g in ([w] if not size else [w[i : i + size] for i in range(len(w) - size + 1)])})[:: 2 if size > 1 else 1]
        data = "".join(f" {g}" for g in grams).encode()
        masked, starts, ends, _ = L._letter_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        h = L.prefix_hash(masked)
        found = L.gram_hash(h, starts, ends) if not size else L.mix(L.gram_hash(h, starts, ends) ^ np.uint64(size))
        order = np.argsort(found)
        keys.append(found[order])
        logs.append(r.normal(size=(len(found), 3))[order])
    model = L.LanguageModel(("x", "y", "z"), tuple(keys), tuple(logs), np.full(3, -12.0))
    texts = ["", "a bc", "".join(r.choice(letters, 900)), " ".join("".join(r.choice(letters, int(n))) for n in r.integers(1, 200, 40)), "    " * 100 + "ab" + " " * 300, train[0]]
    data, offsets = L.text_bytes(L.pa.array(texts))
    whole = model.scores(data, offsets)
    for portion in (1, 37, 200):
        monkeypatch.setattr(L, "PORTION", portion)
        # only words over a portion may differ: they are in no table of words
        got = model.scores(data, offsets)
        assert np.array_equal(got[1], whole[1])
        if portion == 200:
            assert np.allclose(got[0], whole[0])
    monkeypatch.setattr(L, "PORTION", 1)
    single = model.scores(*L.text_bytes(L.pa.array([texts[2]])))[0]
    assert np.allclose(single, model.scores(data, offsets)[0][2]) and np.allclose(single, whole[0][2])
