"""Tables that are replaced part by part: each part is a folder of Parquet, a small file names the folders of a version."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Store:
    """One table under a path on any file system that Spark can write to.

    ``bucket`` deals the rows out to ``buckets`` parts, by what an update is keyed
    by; without it the table has one part. A version is a file ``version-n.json``
    with the folder of each part; the one with the highest number counts. The
    parts of a version are written in full before its file appears, in one step
    and under a number of its own, and no file is removed before a later one is
    there. So at whatever point a writer stops, a reader finds the last version
    that was finished, and what was being read stays until ``drop_old``. Of two
    writers at once the second is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, bucket: Column | None = None, buckets: int = 1):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.bucket, self.buckets = F.lit(0) if bucket is None else F.pmod(F.xxhash64(bucket), F.lit(buckets)).cast("int"), buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the finished versions, in order."""
        return sorted(int(n[8:-5]) for n in self._names(self.path) if n.startswith("version-") and n.endswith(".json"))

    def _state(self, number: int) -> dict[str, Any]:
        return json.loads(self.spark.read.text(f"{self.path}/version-{number}.json", wholetext=True).first()[0])

    def _current(self) -> tuple[int, dict[str, Any]]:
        known = self.versions()
        return (known[-1], self._state(known[-1])) if known else (0, {"parts": {}, "note": {}})

    def note(self) -> dict[str, Any]:
        """What the writer of the current version noted with it."""
        return self._current()[1]["note"]

    def touched(self, df: DataFrame) -> list[int]:
        """The buckets that ``df`` has rows of, at most ``buckets``."""
        return sorted(r.b for r in df.select(self.bucket.alias("b")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The current version, or some buckets of it; empty before the first. Columns that it lacks are null, so old tables still read."""
        parts = self._current()[1]["parts"]
        paths = sorted(f"{self.path}/{folder}/__bucket={b}" for b, folder in parts.items() if only is None or int(b) in only)
        empty = self.spark.createDataFrame([], self.schema)
        return empty.unionByName(self.spark.read.parquet(*paths), allowMissingColumns=True) if paths else empty

    def write(self, df: DataFrame, note: dict[str, Any] | None = None, only: list[int] | None = None) -> int:
        """Replace the table, or only the buckets ``only``, of which ``df`` then has the rows; the number of the new version."""
        number, state = self._current()
        folder = f"data-{number + 1}-{uuid.uuid4().hex}"
        df.withColumn("__bucket", self.bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        kept = {} if only is None else {b: f for b, f in state["parts"].items() if int(b) not in only}
        new = {n.partition("=")[2]: folder for n in self._names(f"{self.path}/{folder}") if n.startswith("__bucket=")}
        self._finish(number + 1, {"parts": kept | new, "note": state["note"] if note is None else note})
        return number + 1

    def _finish(self, number: int, state: dict[str, Any]) -> None:
        fs, part = self._fs(f"{self.path}/_next-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._publish(fs, part, self._fs(f"{self.path}/version-{number}.json")[1])

    def _publish(self, fs, part, to) -> None:
        if fs.exists(to) or not fs.rename(part, to):
            fs.delete(part, False)
            raise RuntimeError(f"{to} was written by another")

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the ``keep`` newest versions, and folders that none of these has."""
        known = self.versions()
        stay = known[-max(1, keep) :]
        used = {f for n in stay for f in self._state(n)["parts"].values()}
        for n in known[: -len(stay)] if stay else []:
            fs, where = self._fs(f"{self.path}/version-{n}.json")
            fs.delete(where, False)
        for name in self._names(self.path):
            # A folder with a number beyond the last is one that a writer is at.
            if name.startswith("data-") and name not in used and stay and int(name.split("-")[1]) <= stay[-1]:
                fs, where = self._fs(f"{self.path}/{name}")
                fs.delete(where, True)


def open_store(spark: SparkSession, path: str | None, schema: StructType) -> Store | None:
    """A store, or None where the setting says that there is none."""
    if path is None or str(path).strip().lower() in ("", "none", "false", "off"):
        return None
    return Store(spark, path, schema)
