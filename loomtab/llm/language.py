"""Word-first language identification with character n-gram backoff.

A word the model knows scores its log frequency in each language.  An unseen word is read from left to right:
at each character the longest known n-gram that starts there scores, from ``NGRAMS[0]`` characters down to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import column, nullable, prepare, slices, text_bytes
from .words import LOWER, SPACE, gram_hash, mix, prefix_hash, word_spans

NGRAMS = (5, 4, 3, 2, 1)
#: Labelled rows that the model is fitted on at most, about; chosen by the hash of their id.
TRAIN_ROWS = 12_000
#: A word or n-gram is kept if the training rows hold it so often.
MIN_COUNT = 3
UNKNOWN = "und"

#: Everything but ASCII letters and non-ASCII bytes separates words here.
_BREAK = np.ones(256, bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def _letter_words(data: np.ndarray, offsets: np.ndarray):
    masked = np.where(_BREAK[data], np.uint8(0x20), LOWER[data])
    starts, ends, first = word_spans(masked, offsets)
    return masked, starts, ends, first


def _char_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(word, byte position) of every character that begins in a word, and for each the word's end."""
    lens = ends - starts
    total = np.cumsum(lens)
    n = int(total[-1]) if len(total) else 0
    word = np.repeat(np.arange(len(starts)), lens)
    at = np.arange(n) + np.repeat(starts - (total - lens), lens)
    head = (data[at] & 0xC0) != 0x80
    return word[head], at[head]


def _grams(h: np.ndarray, word: np.ndarray, at: np.ndarray, word_end: np.ndarray, size: int):
    """(index of the first character, hash) of every run of ``size`` characters within a word."""
    n = len(at) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(word[:n] == word[size - 1 :])
    after = np.append(at, 0)[first + size]
    last = np.append(word, -1)[first + size] != word[first]
    stop = np.where(last, word_end[word[first]], after)
    return first, mix(gram_hash(h, at[first], stop) ^ np.uint64(size))


#: Bytes of words that are looked at together.
PORTION = 1 << 18


def _portions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words in portions: (bytes, starts, ends, bytes to count from, first word, last word, None).

    A word longer than a portion comes in pieces, each with some characters of the next one to see its n-grams; the last field
    then says whether the word ends with it.  Such a word is in no table of words.
    """
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PORTION, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a <= PORTION:
            yield data[a:b], starts[i:j] - a, ends[i:j] - a, b - a, i, j, None
        else:
            while a < b:
                c = _character(data, min(a + PORTION, b), b)
                look = _character(data, min(c + 6 * NGRAMS[0], b), b)
                yield data[a:look], np.zeros(1, np.int64), np.array([look - a]), c - a, i, j, c == b
                a = c
        i = j


def _character(data: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on where a character begins, or the end."""
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


@dataclass(frozen=True)
class LanguageModel:
    """Languages, and per table (words, then each n-gram length) sorted hashes with a row of log frequencies."""

    langs: tuple[str, ...]
    keys: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    floor: np.ndarray

    def _look(self, table: int, hashes: np.ndarray):
        keys = self.keys[table]
        if not len(keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[at] == hashes, at

    @cached_property
    def _stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """(the floor, then the logs of all n-gram tables, as rows of one; the first row of each table)."""
        rows = np.cumsum([1, *(len(x) for x in self.logs[1:])])
        return np.concatenate([self.floor[None], *self.logs[1:]]), rows

    def _spelled(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: int):
        """(sums of the characters' log frequencies by word and language, characters) of those that begin before ``upto``."""
        logs, first_row = self._stacked
        word, pos = _char_spans(data, starts, ends)
        choice, open_ = np.zeros(len(pos), np.int64), np.ones(len(pos), bool)
        for table, size in enumerate(NGRAMS, 1):
            i, gram = _grams(h, word, pos, ends, size)
            i, gram = i[open_[i]], gram[open_[i]]
            hit, row = self._look(table, gram)
            choice[i[hit]] = first_row[table - 1] + row[hit]
            open_[i[hit]] = False
        own = pos < upto
        word, choice = word[own], choice[own]
        return np.stack([np.bincount(word, weights=logs[choice, k], minlength=len(starts)) for k in range(len(self.langs))], 1), np.bincount(word, minlength=len(starts))

    def scores(self, data: np.ndarray, offsets: np.ndarray):
        """(log likelihood per document and language, words per document), in portions of words."""
        docs, wide = len(offsets) - 1, len(self.langs)
        data, starts, ends, first = _letter_words(data, offsets)
        doc = np.repeat(np.arange(docs), np.diff(first))
        total = np.zeros((docs, wide))
        held, chars = np.zeros(wide), 0
        for block, own, stop, upto, i, j, ended in _portions(data, starts, ends):
            h = prefix_hash(block)
            if ended is None:
                known, at = self._look(0, gram_hash(h, own, stop))
                value = np.zeros((j - i, wide))
                value[known] = self.logs[0][at[known]]
                miss = np.flatnonzero(~known)
                if len(miss):
                    sums, n = self._spelled(h, block, own[miss], stop[miss], upto)
                    value[miss] = sums / np.maximum(n, 1)[:, None]
            else:
                sums, n = self._spelled(h, block, own, stop, upto)
                held, chars = held + sums[0], chars + int(n[0])
                if not ended:
                    continue
                value, held, chars = held[None] / max(chars, 1), np.zeros(wide), 0
            for k in range(wide):
                total[:, k] += np.bincount(doc[i:j], weights=value[:, k], minlength=docs)
        return total, np.diff(first)

    def predict(self, texts: pa.Array):
        """(language or ``und``, score) of each text: und, with score 0, where it is null or has no letter."""
        data, offsets = text_bytes(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total, n = self.scores(data, offsets)
        # the likelihood ratio of a mean word, sharpened by the root of the words: long texts stay comparable
        scaled = total / np.sqrt(np.maximum(n, 1))[:, None]
        scaled -= scaled.max(1, keepdims=True)
        p = np.exp(scaled)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        plain = np.zeros(len(texts), bool)
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            plain[filled] = np.logical_or.reduceat(~_BREAK[data] & (data < 128), offsets[:-1][filled])
        langs, score = [self.langs[b] for b in best], p[np.arange(len(best)), best]
        for i in np.flatnonzero(~plain):
            text = texts[int(i)].as_py()
            if not text or not any(c.isalpha() for c in text):
                langs[i], score[i] = UNKNOWN, 0.0
        return langs, score


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, who: np.ndarray):
    """(size, hashes, language of each) of the words (size 0) and n-grams, portion by portion."""
    for block, own, stop, upto, i, j, ended in _portions(data, starts, ends):
        h = prefix_hash(block)
        if ended is None:
            yield 0, gram_hash(h, own, stop), who[i:j]
        word, pos = _char_spans(block, own, stop)
        for size in NGRAMS:
            at, gram = _grams(h, word, pos, stop, size)
            ok = pos[at] < upto
            yield size, gram[ok], who[i:j][word[at[ok]]]


def count_features(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(size, hash, lang, n): how often each word (size 0) and character n-gram stands in the texts of a language."""
    slim = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                langs, of = np.unique(np.array(part.column(1).to_pylist(), object).astype(str), return_inverse=True)
                data, offsets = text_bytes(part.column(0))
                data, starts, ends, first = _letter_words(data, offsets)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                for size, hashes, who in _features(data, starts, ends, of[doc]):
                    order = np.lexsort((hashes, who))
                    hashes, who = hashes[order], who[order]
                    cut = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])])) if len(hashes) else np.zeros(0, np.int64)
                    counts = np.diff(np.append(cut, len(hashes)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cut), size, np.int32)), pa.array(hashes[cut].view(np.int64)), pa.array(langs[who[cut]].tolist(), pa.string()), pa.array(counts.astype(np.int64))],
                        names=["size", "hash", "lang", "n"],
                    )

    return slim.mapInArrow(run, "size int, hash long, lang string, n long").groupBy("size", "hash", "lang").agg(F.sum("n").alias("n"))


def fit_language_model(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model from about ``train_rows`` rows with a language, chosen by the hash of their id.

    Its size is bounded by that sample.  Rows with null text or language teach nothing; without any labelled
    row the model knows no language and predicts ``und``.
    """
    prepare(df.sparkSession)
    slim = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")
    rows = slim.count()
    share = min(1.0, train_rows / max(rows, 1))
    sample = slim.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    counts = count_features(sample)
    # single-character n-grams are all kept: they end every backoff
    kept = counts.groupBy("size", "hash").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"), F.sum("n").alias("all"))
    table = kept.where((F.col("all") >= MIN_COUNT) | (F.col("size") == 1)).select("size", "hash", "by").toArrow()
    langs = tuple(r.lang for r in sample.select("lang").distinct().orderBy("lang").collect())
    sizes, hashes = table["size"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
    entries = table["by"].combine_chunks()
    lens = np.diff(entries.offsets.to_numpy())
    row = np.repeat(np.arange(len(lens)), lens)
    which = np.searchsorted(np.array(langs), np.array(entries.keys.to_pylist(), dtype=str)) if len(row) else np.zeros(0, np.int64)
    dense = np.zeros((len(lens), len(langs)))
    dense[row, which] = entries.items.to_numpy(zero_copy_only=False)
    keys, logs = [], []
    floor = np.full(len(langs), -12.0)
    for size in (0, *NGRAMS):
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(hashes[own])]
        n = dense[own]
        smooth = np.log((n + 0.5) / (n.sum(0, keepdims=True) + 0.5 * max(len(own), 1))) if len(own) else n
        keys.append(hashes[own])
        logs.append(smooth)
    return LanguageModel(langs, tuple(keys), tuple(logs), floor)


def identify_language(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its score (0 to 1) to every row; repeated rows get equal predictions."""
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    names = [*df.columns, lang_pred, score]
    if len(set(names)) < len(names):
        raise ValueError(f"columns {lang_pred} and {score} must be new")
    schema = df.withColumn(lang_pred, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 18):
                langs, p = shared.value.predict(column(part, text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(p)], names=names)

    return df.mapInArrow(run, nullable(schema))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that no model learns from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the documents that are not held out."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs.where(~held_out()))
    seen = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify_language(seen, model).drop("text")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES: dict[str, str] = {}
