"""SQLite files as a Spark data source, read-only, cut by row id into partitions.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", ...).option("table", ...).load()
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# SQLite's declared types and Spark's.
TYPES = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def connect(path: str) -> sqlite3.Connection:
    """Opens a file without writing to it or its folder."""
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


class Range(InputPartition):
    """Row ids from ``low`` up to, but without, ``high``."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """One table of a SQLite file; options ``path``, ``table``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as c:
            found = c.execute("SELECT name, type FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{n}` {TYPES.get(t.upper().split('(')[0], 'string')}" for n, t in found)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(DataSourceReader):
    """Reads ranges of row ids, each task with a connection of its own."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.parts = options["path"], options["table"].replace('"', '""'), int(options.get("partitions", 4))
        self.columns = ", ".join('"' + f.name.replace('"', '""') + '"' for f in schema)

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with connect(self.path) as c:
            yield from c.execute(f'SELECT {self.columns} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high))
