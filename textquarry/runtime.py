"""Session helpers shared by every operator: tables, checkpoints, small files, size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size (bytes) of a side that may be broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Tables of fewer bytes than this per core are dealt out before costly work by the row.
CORE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; where none is configured, a temporary one, but only on a single machine."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc._jsc.sc().getCheckpointDir().get()


class Folder:
    """Small files and names below a folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        """Names in the folder, in order; none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.exists() else []

    def stamps(self, name: str) -> str:
        """Names, sizes and times of a file, or of those in a folder, as one text."""
        found = self._fs.listStatus(self._at(name)) if self.exists(name) else []
        return "\n".join(sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in found))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; the name must be new."""
        stream = self._fs.create(self._at(f".{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(self._at(f".{name}"), self._at(name)):
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpoint made by ``cut``; nothing that is still to run may read it."""
    plan = df._jdf.queryExecution().analyzed()
    found = plan.rdd().getCheckpointFile() if plan.nodeName().startswith(("LogicalRDD", "Scan")) else None
    if found is not None and found.isDefined():
        Folder(df.sparkSession, found.get()).delete()


def sweep(spark: SparkSession) -> None:
    """Let the shuffle files of plans that nothing refers to any more be deleted: it happens when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_or_plain(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint only if its estimated size is within ``limit``."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def dealt(df: DataFrame) -> DataFrame:
    """A table smaller than ``CORE_BYTES`` a core, dealt out evenly: it may lie in one block that one task would read alone.

    For work by the row only; larger tables stay as they are read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if cores > 1 and estimated_bytes(df) < cores * CORE_BYTES else df


def numbered(df: DataFrame, order: list[str], name: str = "row_no", start: int = 0) -> DataFrame:
    """Dense numbers from ``start`` in the order of ``order``, without putting all rows in one task.

    The rows are range-partitioned and sorted; the rows per partition (one number per task) are summed up on the
    driver, so that each partition counts on from the total of those before it. ``order`` should be unique.
    """
    parts = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())
    offsets, total = [], start
    for part, count in counts:
        offsets.append((part, total))
        total += count
    base = df.sparkSession.createDataFrame(offsets, "_part int, _base long")
    return parts.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_pos")).drop("_part", "_pos", "_base")
