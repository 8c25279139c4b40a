"""Session helpers: the shared folder, written cut points, size checks."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in rows, that an operator may broadcast after counting it.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local (tests, one machine) a temporary
    folder is set; on a cluster its absence is an error, since a machine-local
    folder would lose data with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="kithspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers, once for each application.

    It is packed and sent along as Spark does with any Python file, so workers
    need neither a working directory nor a path of their own.
    """
    context = spark.sparkContext
    if getattr(context, "_kithspark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="kithspark-code-")) / "kithspark-code.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(packed))
    context._kithspark_shipped = True


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``keep`` writes a frame as Parquet and returns its reader; ``drop`` removes
    one that a later one replaces. What is left goes when the program ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _clear(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the JVM may be gone already
            pass


def parts(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` at ``per_task`` each, at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / per_task))
