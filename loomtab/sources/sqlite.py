"""SQLite files as a data source of their own: executors read ranges of row ids, or one of them a query.

The file lies where every executor can read it, on a mounted shared folder.
"""

from __future__ import annotations

import sqlite3
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of an Arrow batch.
BATCH = 5000
_OF = {"integer": T.LongType(), "real": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType()}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(kinds: set[str]) -> T.DataType:
    """The type of a column by the storage classes of its values: numbers meet in double, anything else in string."""
    kinds = kinds - {"null"}
    if kinds == {"integer", "real"}:
        return T.DoubleType()
    return _OF[next(iter(kinds))] if len(kinds) == 1 else T.StringType()


def declared(type_: str) -> T.DataType | None:
    """The type that a declaration stands for, by the affinity of its name; None where it says nothing."""
    name = type_.upper()
    if "INT" in name:
        return T.LongType()
    if any(w in name for w in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in name:
        return T.BinaryType()
    if any(w in name for w in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return None


def _schema(con: sqlite3.Connection, source: str, table: str | None) -> T.StructType:
    """Declared types of a table's columns; others, and a query's, by what storage classes their values have."""
    names = [d[0] for d in con.execute(f"select * from {source} limit 0").description]
    known = {r[1]: declared(r[2] or "") for r in con.execute(f"pragma table_info({quoted(table)})")} if table else {}
    open_ = [n for n in names if known.get(n) is None]
    if open_:
        # only the names of the classes leave the database
        row = con.execute(f"select {', '.join(f'group_concat(distinct typeof({quoted(n)}))' for n in open_)} from {source}").fetchone()
        known |= {n: kind_of(set((k or "").split(","))) for n, k in zip(open_, row, strict=True)}
    return T.StructType([T.StructField(n, known[n]) for n in names])


@dataclass
class _Rows(InputPartition):
    """Row ids from ``low`` to below ``high``; None: all rows."""

    low: int | None = None
    high: int | None = None


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.query = schema, options["path"], options.get("table"), options.get("query")
        self.parts = int(options.get("partitions", 8))

    def partitions(self) -> list[InputPartition]:
        if not self.table:
            return [_Rows()]
        with _open(self.path) as con:
            try:
                low, high = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view, or a table without row ids
                return [_Rows()]
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = ", ".join(quoted(f.name) for f in self.schema)
        source = quoted(self.table) if self.table else f"({self.query})"
        where, values = (" where rowid >= ? and rowid < ?", (partition.low, partition.high)) if partition.low is not None else ("", ())
        target = to_arrow_schema(self.schema)
        with _open(self.path) as con:
            con.text_factory = lambda b: b.decode(errors="replace")
            cursor = con.execute(f"select {names} from {source}{where}", values)
            while rows := cursor.fetchmany(BATCH):
                columns = [pa.array([_cast(r[i], f.dataType) for r in rows], target.field(i).type) for i, f in enumerate(self.schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


def _cast(value, kind: T.DataType):
    """SQLite stores any class in any column: what does not fit the column's type is null, but anything is a string."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else value.decode(errors="replace") if isinstance(value, bytes) else str(value)
    if isinstance(kind, T.DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) else int(value) if isinstance(value, float) and value.is_integer() else None
    return value if isinstance(value, bytes) else value.encode() if isinstance(value, str) else None


class SqliteSource(DataSource):
    """Options: ``path``, and ``table`` (read in ``partitions`` ranges of row ids) or ``query`` (read by one task)."""

    @classmethod
    def name(cls) -> str:
        return "loomtab_sqlite"

    def schema(self) -> T.StructType:
        table = self.options.get("table")
        with _open(self.options["path"]) as con:
            return _schema(con, quoted(table) if table else f"({self.options['query']})", table)

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
