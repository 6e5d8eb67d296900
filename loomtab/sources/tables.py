"""Table sources and sinks: CSV, Parquet, SQLite, and checksummed Parquet output."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sqlite import SqliteSource


class DataLoadError(ValueError):
    """A source that can't be read."""


def load_csv(spark: SparkSession, path: str, separator: str = ",", schema: T.StructType | str | None = None, sampling: float = 1.0) -> DataFrame:
    """A CSV file with a header; give ``schema`` to save the pass that infers it."""
    reader = spark.read.option("header", True).option("sep", separator)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).option("samplingRatio", sampling).csv(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_data(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv or .parquet."""
    kind = Path(path).suffix.lower()
    try:
        if kind == ".csv":
            return load_csv(spark, path)
        if kind == ".parquet":
            return load_parquet(spark, path)
    except Exception as e:
        raise DataLoadError(f"{path}: {e}") from e
    raise DataLoadError(f"{path}: neither .csv nor .parquet")


#: Words that a query for a read-only source may not hold, wherever they stand.
_BLOCKED = re.compile(r"\b(drop|delete|insert|update|alter|create|exec|execute)\b", re.IGNORECASE)


def check_select(query: str) -> str:
    """The query, if it is one SELECT without a blocked word."""
    body = query.strip().rstrip(";").strip()
    if ";" in body or not re.match(r"(select|with)\b", body, re.IGNORECASE):
        raise DataLoadError("only a single SELECT is allowed")
    if found := _BLOCKED.search(body):
        raise DataLoadError(f"{found[1].upper()} is not allowed")
    return body


def load_sqlite(spark: SparkSession, database: str, query: str | None = None, table: str | None = None, partitions: int = 8) -> DataFrame:
    """Rows of a SQLite file on a shared folder, read by executors: a table in ranges of row ids, a SELECT by one task.

    A table's types are those declared, else, as for a query, those of the values; a value that does not fit is null.
    """
    if (query is None) == (table is None):
        raise DataLoadError("give a query or a table")
    source = {"query": check_select(query)} if query is not None else {"table": table}
    spark.dataSource.register(SqliteSource)
    try:
        return spark.read.format(SqliteSource.name()).options(path=database, partitions=str(partitions), **source).load()
    except Exception as e:
        raise DataLoadError(f"{database}: {e}") from e


@dataclass(frozen=True)
class ArtifactRef:
    """What was written: where, how many rows, files and bytes, and an order-free digest of the content."""

    path: str
    row_count: int
    files: int
    size: int
    digest: str


def write_parquet(df: DataFrame, path: str) -> ArtifactRef:
    """Write and describe.  Part files are hashed where they lie, by a distributed read."""
    df.write.mode("errorifexists").parquet(path)
    return describe_parquet(df.sparkSession, path)


def describe_parquet(spark: SparkSession, path: str) -> ArtifactRef:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("length", F.sha2("content", 256).alias("sum"))
    found = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("sum"))), 256)).first()
    return ArtifactRef(path, spark.read.parquet(path).count(), found[0], found[1], found[2])


def add_file(spark: SparkSession, source: str, folder: str) -> ArtifactRef:
    """Copy one file into a folder, both anywhere Spark's file systems reach; it must not be there yet."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    a = hadoop.Path(source)
    b = hadoop.Path(folder, a.getName())
    if b.getFileSystem(conf).exists(b):
        raise DataLoadError(f"{b} exists")
    if not hadoop.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise DataLoadError(f"{source} could not be copied")
    size, digest = spark.read.format("binaryFile").load(b.toString()).select("length", F.sha2("content", 256)).first()
    return ArtifactRef(b.toString(), 0, 1, size, digest)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are written."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def to_markdown(df: DataFrame, limit: int = 100) -> str:
    """The first rows as a Markdown table: a view for people, so at most ``limit``."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in r] for r in df.limit(limit).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["-"] * len(df.columns), *rows])
