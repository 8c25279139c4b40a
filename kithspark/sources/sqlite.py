"""SQLite files as a data source: ``spark.read.format("kith_sqlite").option("path", ...).option("table", ...)``.

Partitions are ranges of row ids. Vectors, stored as bytes of 32-bit numbers,
come out as arrays; lists, stored as JSON, as arrays of strings. The file has to
be reachable from the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

VECTORS, LISTS, TIMES = ("embedding", "eye_embedding"), ("sample_image_paths",), ("created_at", "updated_at", "seen_at")
TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[Rows]:
        import sqlite3

        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        import sqlite3

        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            for row in c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', (partition.low, partition.high)):
                yield tuple(_value(n, v) for n, v in zip(self.columns, row))


def _value(name: str, v: Any) -> Any:
    import array
    import json
    from datetime import datetime, timezone

    if v is None:
        return None
    if name in VECTORS and isinstance(v, bytes):
        return list(array.array("f", v)) if len(v) % 4 == 0 else None
    if name in LISTS:
        try:
            got = json.loads(v)
        except ValueError:
            return []
        return [str(x) for x in got] if isinstance(got, list) else []
    if name in TIMES and isinstance(v, str):
        try:
            at = datetime.fromisoformat(v)
        except ValueError:
            return None
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return v


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kith_sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            return [(r[1], r[2].upper().split("(")[0]) for r in c.execute(f'PRAGMA table_info("{self.options["table"]}")')]

    def schema(self) -> str:
        kind = lambda n, t: "array<float>" if n in VECTORS else "array<string>" if n in LISTS else "timestamp" if n in TIMES else TYPES.get(t, "string")
        return ", ".join(f"`{n}` {kind(n, t)}" for n, t in self._columns())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], [n for n, _ in self._columns()], int(self.options.get("partitions", "8")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteSource)
