"""The corpus pipeline: language, quality, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents``; all but the last return those columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.llm.jaccard import jaccard_components
from loomtab.llm.language import UNKNOWN, fit_language_model, identify_language
from loomtab.llm.packing import pack_pieces, token_pieces
from loomtab.llm.quality import quality_filter
from loomtab.llm.repeats import remove_repeats
from loomtab.llm.runtime import BROADCAST_IDS, cut, forget, prepare

#: Score under which no language is sure; words of a shingle and percent of a near duplicate; bytes of a repeated passage.
SURE, SHINGLE, PERCENT, PASSAGE = 0.5, 5, 80, 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure; null, letterless and mixed texts go.  Without labels nothing is known, so all stay."""
    model = fit_language_model(docs)
    if not model.langs:
        return docs
    lang, score = _free(docs, "found_lang"), _free(docs, "found_score")
    named = identify_language(docs, model, lang_pred=lang, score=score)
    return named.where((F.col(lang) != UNKNOWN) & (F.col(score) >= SURE)).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows that repeat one, one.

    Rows with a null id are in no group and stay.  Rows of one id are one document in the graph and go or stay together.
    """
    found = jaccard_components(docs, size=SHINGLE, percent=PERCENT)
    others = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    left = docs.join(_small(others), "doc_id", "left_anti")
    # rows are told apart by id and digest; only those of a repeated pair are gathered
    key = _free(docs, "digest")
    named = left.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit("\0"))).cast("binary"))))
    repeated = named.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    if repeated.isEmpty():
        return left
    repeated = cut(repeated)
    once = named.join(_small(repeated), key, "left_anti")
    return once.unionByName(named.join(_small(repeated), key, "left_semi").dropDuplicates([key]).select(*once.columns)).select(*docs.columns)


def _small(table: DataFrame) -> DataFrame:
    """A table from files, to be broadcast if it is counted to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 200 bytes or more that repeat are cut out of their texts, and n_chars follows."""
    left = remove_repeats(docs, length=PASSAGE)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces in sequences."""
    return pack_pieces(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, cut(stage(spark, docs, sf_dir))
        if i:
            forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
