"""Quality rules as a short-circuit cascade.

Every rule is timed and its rejections are counted on a bounded sample; the rules then run in order of
rejections per second, each only on the documents that all earlier ones let pass.  The order changes the
work, never the verdict: a document is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import column, nullable, prepare, slices, text_bytes
from .words import line_spans, mix, span_hash, windows, word_spans

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_CONTINUED = np.zeros(256, np.int64)
_CONTINUED[0x80:0xC0] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.int64)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = 1
#: Words of a repeat window.
WINDOW = 8


def _sums(weight: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(weight[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _later_equals(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document, how many values equal an earlier one of the same document."""
    keyed = values ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    return np.bincount(doc[order][1:][same], minlength=docs)


class Texts:
    """The texts of a batch; every measure is computed when first asked for, for all of them at once."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def subset(self, keep: np.ndarray) -> Texts:
        """The texts at these positions; measures already known come along."""
        lens = np.diff(self.offsets)[keep]
        ends = np.cumsum(lens)
        at = np.arange(int(lens.sum())) + np.repeat(self.offsets[:-1][keep] - (ends - lens), lens)
        out = Texts(self.data[at], np.concatenate([[0], ends]).astype(np.int64))
        for k in MEASURES:
            if k in self.__dict__:
                out.__dict__[k] = self.__dict__[k][keep]
        return out

    def __getattr__(self, name: str):
        if name not in _COMPUTE:
            raise AttributeError(name)
        self.__dict__[name] = found = _COMPUTE[name](self)
        return found


def _spans(t: Texts):
    return word_spans(t.data, t.offsets)


def _repeat_words(t: Texts) -> np.ndarray:
    starts, ends, first = t.spans
    found, at, doc = windows(span_hash(t.data, starts, ends), first, WINDOW)
    if not len(found):
        return np.zeros(t.n, np.int64)
    keyed = found ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _dup_lines(t: Texts) -> np.ndarray:
    starts, ends, doc = line_spans(t.data, t.offsets)
    begins = t.spans[0]
    has = np.searchsorted(begins, ends) > np.searchsorted(begins, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    return _later_equals(span_hash(t.data, starts, ends), doc, t.n)


def _lines(t: Texts) -> np.ndarray:
    starts, ends, doc = line_spans(t.data, t.offsets)
    begins = t.spans[0]
    return np.bincount(doc[np.searchsorted(begins, ends) > np.searchsorted(begins, starts)], minlength=t.n)


_SPACE_WEIGHT = np.zeros(256, np.int64)
_SPACE_WEIGHT[[0x20, *range(0x09, 0x0E)]] = 1

_COMPUTE: dict[str, Callable[[Texts], object]] = {
    "spans": _spans,
    "n_words": lambda t: np.diff(t.spans[2]),
    "word_chars": lambda t: np.diff(t.offsets) - _sums(_SPACE_WEIGHT, t.data, t.offsets) - _sums(_CONTINUED, t.data, t.offsets),
    "n_symbols": lambda t: _sums(_SYMBOL, t.data, t.offsets),
    "n_upper": lambda t: _sums(_UPPER, t.data, t.offsets),
    "n_letters": lambda t: _sums(_LETTER, t.data, t.offsets),
    "n_lines": _lines,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
}
MEASURES = [k for k in _COMPUTE if k != "spans"]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps Texts to a boolean per text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _too_short(t: Texts) -> np.ndarray:
    return t.n_words < 20


def _repetitive(t: Texts) -> np.ndarray:
    return 100 * t.n_repeat_words > 30 * t.n_words


def _symbols(t: Texts) -> np.ndarray:
    return 100 * t.n_symbols > 25 * t.n_words


def _shouting(t: Texts) -> np.ndarray:
    return 100 * t.n_upper > 40 * t.n_letters


def _same_lines(t: Texts) -> np.ndarray:
    return 100 * t.n_dup_lines > 30 * t.n_lines


def _word_length(t: Texts) -> np.ndarray:
    return (t.word_chars < 2 * t.n_words) | (t.word_chars > 14 * t.n_words)


def _few_letters(t: Texts) -> np.ndarray:
    return 100 * t.n_letters < 50 * t.word_chars


BASE_RULES = (Rule("too_short", _too_short), Rule("repetitive", _repetitive))
VERDICT_RULES = (
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("same_lines", _same_lines),
    Rule("word_length", _word_length),
    Rule("few_letters", _few_letters),
)


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    seen: int
    rejected: int

    @property
    def worth(self) -> float:
        """Rejections per second of work."""
        return self.rejected / max(self.seconds, 1e-9)


def estimate_rules(df: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000, after: Sequence[Rule] = (), known: Sequence[str] = ()) -> list[RuleEstimate]:
    """Cost and rejections of each rule alone, over about ``sample_rows`` rows.

    They are what the rule adds in its place: only texts that pass the rules it runs ``after`` are looked at, and the
    measures ``known`` by then cost nothing.  An empty table gives zeros.  Equal texts are drawn row by row.
    """
    prepare(df.sparkSession)
    rows = df.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_000_000)) < int(share * 1_000_000) + 1
    sample = df.select(F.col(f"`{text}`").alias("text")).where(drawn)
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, gone, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                given = Texts(*text_bytes(part.column(0)))
                for measure in known:
                    getattr(given, measure)
                passed = np.flatnonzero(run_cascade(given, after))
                seen += len(passed)
                for i, rule in enumerate(rules):
                    fresh = given.subset(passed)
                    began = time.perf_counter()
                    gone[i] += int(rule.rejects(fresh).sum())
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"name": [r.name for r in rules], "seconds": spent, "seen": pa.array([seen] * len(rules), pa.int64()), "rejected": pa.array(gone, pa.int64())})

    found = sample.mapInArrow(run, "name string, seconds double, seen long, rejected long").groupBy("name").agg(F.sum("seconds"), F.sum("seen"), F.sum("rejected")).collect()
    by = {r[0]: RuleEstimate(r[0], r[1], r[2], r[3]) for r in found}
    return [by.get(r.name, RuleEstimate(r.name, 0.0, 0, 0)) for r in rules]


def cascade_order(rules: Sequence[Rule], estimates: Sequence[RuleEstimate]) -> list[Rule]:
    """Rules by rejections per cost, highest first; a tie keeps the given order."""
    worth = {e.name: e.worth for e in estimates}
    return sorted(rules, key=lambda r: -worth.get(r.name, 0.0))


def run_cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """A boolean per text: True where no rule rejects; each rule sees only what is left."""
    kept = np.ones(texts.n, bool)
    left, at = texts, np.arange(texts.n)
    for rule in rules:
        if not len(at):
            break
        no = rule.rejects(left)
        if no.any():
            kept[at[no]] = False
            stay = np.flatnonzero(~no)
            left, at = left.subset(stay), at[stay]
    return kept


def quality_filter(df: DataFrame, text: str = "text", rules: Sequence[Rule] = (*BASE_RULES, *VERDICT_RULES), sample_rows: int = 2000) -> DataFrame:
    """The rows whose text no rule rejects, with all their columns.

    A null or empty text has no word and goes by the rule ``too_short``; repeated rows are judged alike.
    """
    order = cascade_order(rules, estimate_rules(df, rules, text, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 19):
                yield part.filter(pa.array(run_cascade(Texts(*text_bytes(column(part, text))), order)))

    return df.mapInArrow(run, df.schema)


def quality_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: Sequence[Rule] = VERDICT_RULES, sample_rows: int = 2000) -> DataFrame:
    """Per row: id, the base measures, ``base_failed`` and ``kept``.

    The base measures are computed for every row; the cascade runs on those that pass the base rules.
    A null text counts as empty: all measures 0, base_failed true.
    """
    order = cascade_order(rules, estimate_rules(df, rules, text, sample_rows, after=BASE_RULES, known=BASE))
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = slim.select(F.col("id").alias(id_col), *[F.lit(0).cast("long").alias(c) for c in BASE], F.lit(True).alias("base_failed"), F.lit(True).alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                texts = Texts(*text_bytes(part.column(1)))
                measures = [getattr(texts, c) for c in BASE]
                failed = _too_short(texts) | _repetitive(texts)
                kept = np.zeros(texts.n, bool)
                passed = np.flatnonzero(~failed)
                kept[passed] = run_cascade(texts.subset(passed), order)
                arrays = [part.column(0), *[pa.array(np.asarray(m, np.int64)) for m in measures], pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *BASE, "base_failed", "kept"])

    return slim.mapInArrow(run, nullable(schema))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict of every document."""
    return quality_report(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_quality_cascade": op7_quality_cascade}
ORACLES = {
    "op7_quality_cascade": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, string_split(t, chr(10)) as ls from d),
grams as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)
),
twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1
),
covered as (
  select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(0, 8)) as k) group by doc_id
),
lines as (
  select doc_id, l from (select doc_id, unnest(ls) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')
),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lines group by doc_id),
f as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0) as n_lines,
    len(regexp_extract_all(t, '[A-Z]')) as up, len(regexp_extract_all(t, '[A-Za-z]|[^\x00-\x7F]')) as letters
  from w left join dup using (doc_id) left join covered using (doc_id)
),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (
    100 * n_symbols > 25 * n_words or 100 * up > 40 * letters or 100 * n_dup_lines > 30 * n_lines
    or word_chars < 2 * n_words or word_chars > 14 * n_words or 100 * letters < 50 * word_chars) as kept
from b
""",
}
