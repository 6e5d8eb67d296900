"""The event log as a stream: what was appended since, over rotations, never a torn line.

An offset says for each file, known by its inode as a rotation renames it, how many bytes were taken; it always ends behind a
line.  The log lies where every executor can read it.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes at the end of a file that are looked at together for its last whole line; bytes of a file that one task reads.
TAIL, SPAN = 1 << 16, 8 << 20


def log_files(path: str, backups: int) -> dict[str, str]:
    """The live file and its backups by inode."""
    found = {}
    for name in [f"{path}.{i}" for i in range(backups, 0, -1)] + [path]:
        try:
            found[str(os.stat(name).st_ino)] = name
        except FileNotFoundError:
            continue
    return found


def whole_lines(path: str) -> int:
    """Bytes up to the last line end."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        while end > 0:
            start = max(0, end - TAIL)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


@dataclass
class _Span(InputPartition):
    inode: str
    start: int
    end: int


class EventStreamReader(DataSourceStreamReader):
    def __init__(self, fields: list[tuple[str, str]], options: dict):
        self.fields, self.path = fields, options["path"]
        self.backups, self.strict = int(options.get("backups", 5)), options.get("on_error", "raise") == "raise"

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {inode: whole_lines(name) for inode, name in log_files(self.path, self.backups).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for inode, upto in end.items():
            at = start.get(inode, 0)
            if at > upto:  # the inode has come back as another file
                at = 0
            out += [_Span(inode, a, min(a + SPAN, upto)) for a in range(at, upto, SPAN)]
        return out

    def read(self, partition: _Span) -> Iterator[tuple]:
        name = log_files(self.path, self.backups).get(partition.inode)
        if name is None:
            raise FileNotFoundError(f"a file of {self.path} was rotated away before it was read")
        with open(name, "rb") as f:
            # a line belongs to the span in which it begins
            f.seek(max(partition.start - 1, 0))
            if partition.start:
                f.readline()
            while f.tell() < partition.end:
                line = f.readline()
                if not line.strip():
                    continue
                try:
                    event = json.loads(line)
                    if not isinstance(event, dict):
                        raise ValueError("no object")
                except ValueError as e:
                    if self.strict:
                        raise ValueError(f"malformed line in {name}") from e
                    continue
                yield tuple(_value(event.get(field), kind) for field, kind in self.fields)

    def commit(self, end: dict) -> None:
        pass


def _value(value, kind: str):
    if value is None:
        return None
    if kind.startswith("map"):
        number = kind.endswith("double>")
        return {str(k): float(v) if number else str(v) for k, v in value.items() if v is not None} if isinstance(value, dict) else None
    if kind in ("bigint", "double"):
        return (int if kind == "bigint" else float)(value) if isinstance(value, (int, float)) else None
    return value if isinstance(value, str) else json.dumps(value, sort_keys=True)


class EventStreamSource(DataSource):
    """Options: ``path`` of the live file, ``backups`` kept, ``on_error``: raise or skip."""

    @classmethod
    def name(cls) -> str:
        return "loomtab_events"

    def schema(self) -> str:
        from loomtab.sources.events import EVENT_SCHEMA

        return EVENT_SCHEMA

    def streamReader(self, schema) -> EventStreamReader:
        return EventStreamReader([(f.name, f.dataType.simpleString()) for f in schema.fields], dict(self.options))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
