import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as C
from loomtab.llm.pieces import vocabulary
from loomtab.llm.quality import BASE_RULES, VERDICT_RULES, Texts, run_cascade
from loomtab.llm.runtime import text_bytes

from .test_jaccard import brute as jaccard_brute
from .test_packing import check as packing_check


def grams(texts, length):
    seen = {}
    for t in texts:
        b = t.encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    return seen


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            assert len(kept[name]) > 0.9 * len(before)
        elif name == "quality_rules":
            import pyarrow as pa

            ok = run_cascade(Texts(*text_bytes(pa.array(list(before.values())))), (*VERDICT_RULES, *BASE_RULES))
            assert set(kept[name]) == {i for i, k in zip(before, ok, strict=True) if k}
        elif name == "near_duplicates":
            groups = jaccard_brute(sorted(before.items()), C.SHINGLE, C.PERCENT)
            assert set(kept[name]) == {root for _, _, root in groups}
        elif name == "repeated_passages":
            seen = grams(before.values(), C.PASSAGE)
            for i, t in before.items():
                b = t.encode()
                gone = np.zeros(len(b), bool)
                for k in range(len(b) - C.PASSAGE + 1):
                    if seen[b[k : k + C.PASSAGE]] > 1:
                        gone[k : k + C.PASSAGE] = True
                assert kept[name][i] == np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore")
        else:
            rows = docs.collect()
            packing_check(rows, 4096)
            t = Tokenizer.from_file(vocabulary(None, "word_bpe_49k.json"))
            size = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in before.items()}
            got = {}
            for r in rows:
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == size


def test_run_equals_the_stages(spark, sf):
    assert C.run(spark, sf).count() > 0


def test_odd_rows(spark, sf):
    text = " ".join(f"word{i} the and of" for i in range(30))
    rows = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text, None, "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for one in (docs, docs.limit(0)):
        now = one
        for _, stage in C.STAGES:
            now = stage(spark, now, sf)
        assert now.count() == (0 if one is not docs else 2)
