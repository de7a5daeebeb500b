"""What the operators of this folder share: tables, scratch space, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder the cluster names.

    Only where the session names none and all its tasks run on this machine (tests) is a local
    folder set, once for the session; elsewhere other executors would not see it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


_GATHER: list = []


@contextlib.contextmanager
def gathering(into: list) -> Iterator[None]:
    """Workspaces made meanwhile are put into the list."""
    _GATHER.append(into)
    try:
        yield
    finally:
        _GATHER.pop()


def close_unread(spaces: list, docs: DataFrame) -> None:
    """Deletes those of the workspaces that docs does not read."""
    if spaces:
        read = docs.inputFiles()
        for w in [w for w in spaces if not any(w.name in f for f in read)]:
            w.close()
            spaces.remove(w)


class Workspace:
    """Tables written between the steps of one operator.

    ``put`` cuts the lineage: the table is on shared storage, so a lost
    executor costs only the tasks it was running.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.dir = spark, scratch(spark)
        self.name = self.dir.rsplit("/", 1)[1]
        for into in _GATHER:
            into.append(self)

    def put(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = f"{self.dir}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.dir}/{name}")

    def close(self) -> None:
        """Deletes all its tables: what was made of them has to be written by then."""
        self._delete(self.dir)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def free_shuffles(self) -> None:
        """Let Spark's cleaner remove shuffle files of finished steps now, not
        whenever the driver next collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python reads texts, which can be long: the package goes to the workers, and the session's
    batches get a bounded size from now on (results are lazy, so it has to last)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def clean_text(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, m: int):
    """crc32 of the id as decimal text, mod m; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m).cast("int")


_HELD: dict = {}


def hold(name: str, make=None):
    """What a worker process keeps from task to task, for one operator at a time.

    Workers outlive the operators of a pipeline; whoever comes next has the last one's memory freed.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)
        _HELD[name] = make() if make else None
    return _HELD[name]
