"""The event log: JSON lines, one event a line."""

from __future__ import annotations

import gzip
import json
import os
import threading
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of an event; anything else in a line is ignored.
EVENT_SCHEMA = (
    "event string, run_id string, timestamp string, model string, task string, dataset string, n_rows long, "
    "cv_scores map<string,double>, cv_std map<string,double>, params map<string,string>, calibration string, "
    "duration_seconds double, artifact_path string, error string, config string, lift map<string,double>"
)


class EventLogError(ValueError):
    """A line that is no event, where none may be skipped."""


def read_events(spark: SparkSession, paths: str | list[str], on_error: str = "raise") -> DataFrame:
    """Events of JSON-lines files with ``file`` and ``line`` (their order in the file).

    ``raise`` fails at any malformed line, ``skip`` leaves them out, ``skip_trailing`` leaves out those after the
    last good line of their file (a torn tail) and fails at others.  Blank lines don't count.
    """
    if on_error not in ("raise", "skip", "skip_trailing"):
        raise ValueError(on_error)
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = raw.where(F.trim("value") != "").withColumn("e", F.from_json("value", EVENT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    lines = lines.withColumn("bad", F.col("e._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{.*\}\s*$"))
    if on_error != "skip":
        per = lines.groupBy("file").agg(F.max(F.when(~F.col("bad"), F.struct("block", "at"))).alias("good"), F.min(F.when(F.col("bad"), F.struct("block", "at"))).alias("broken"))
        wrong = per.where("broken is not null") if on_error == "raise" else per.where("broken < good")
        if first := wrong.select("file").first():
            raise EventLogError(f"malformed line in {first[0]}")
    good = lines.where(~F.col("bad"))
    line = F.row_number().over(Window.partitionBy("file").orderBy("block", "at"))
    names = [p.split()[0] for p in EVENT_SCHEMA.split(", ")]
    return good.select("file", line.alias("line"), *[F.col(f"e.{n}").alias(n) for n in names])


def stream_events(spark: SparkSession, path: str, backups: int = 5, on_error: str = "raise") -> DataFrame:
    """The events of a log as a stream, from its oldest kept file on: each line once, however the files are rotated.

    A line counts once its end is written.  A file that is rotated away before a batch reads it is an error.
    """
    from .event_stream import EventStreamSource

    spark.dataSource.register(EventStreamSource)
    return spark.readStream.format(EventStreamSource.name()).options(path=path, backups=str(backups), on_error=on_error).load()


class EventLog:
    """Appends events to a JSON-lines file, safely from threads; keeps ``backups`` files of ``max_bytes``."""

    def __init__(self, path: str, max_bytes: int = 10 << 20, backups: int = 5):
        self.path, self.max_bytes, self.backups = Path(path), max_bytes, backups
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self._lock = threading.Lock()

    def append(self, event: dict[str, Any]) -> None:
        line = json.dumps(event, sort_keys=True, default=str) + "\n"
        with self._lock:
            if self.path.exists() and self.path.stat().st_size + len(line) > self.max_bytes:
                self._rotate()
            with self.path.open("a") as f:
                f.write(line)
                f.flush()
                os.fsync(f.fileno())

    def _rotate(self) -> None:
        for i in range(self.backups, 0, -1):
            old = self.path if i == 1 else self.path.with_name(f"{self.path.name}.{i - 1}")
            if old.exists():
                old.replace(self.path.with_name(f"{self.path.name}.{i}"))

    def files(self) -> list[str]:
        """The live file and its backups, newest first."""
        backups = [self.path.with_name(f"{self.path.name}.{i}") for i in range(1, self.backups + 1)]
        return [str(p) for p in (self.path, *backups) if p.exists()]

    def finalize(self) -> str:
        """Check every line, then replace the file by its gzip form at once."""
        with self._lock:
            data = self.path.read_bytes()
            for n, line in enumerate(data.decode().splitlines(), 1):
                try:
                    json.loads(line)
                except ValueError as e:
                    raise EventLogError(f"{self.path}:{n}") from e
            target = self.path.with_name(self.path.name + ".gz")
            staging = target.with_name("." + target.name)
            staging.write_bytes(gzip.compress(data, mtime=0))
            staging.replace(target)
            self.path.unlink()
        return str(target)
