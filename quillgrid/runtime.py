"""What every operator needs from the session: shared checkpoints and sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The longest array of bytes that any operator broadcasts; see README.
BROADCAST_LIMIT = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, which the session names in ``spark.checkpoint.dir``.

    A temporary one is set only where none is named and all runs on one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master or "").split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="quillgrid-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A folder of any file system that Spark knows, seen through the session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.root = folder.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _at(self, *parts: str) -> object:
        return self._jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._at(*parts))

    def names(self, *parts: str) -> list[str]:
        """Names of what the folder holds; none if there is no such folder."""
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(*parts))] if self.exists(*parts) else []

    def mark(self, *parts: str) -> None:
        """An empty file."""
        self._fs.create(self._at(*parts), True).close()

    def move(self, parts: tuple[str, ...], to: tuple[str, ...]) -> bool:
        return self._fs.rename(self._at(*parts), self._at(*to))

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._at(*parts), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the session has cores.

    A small table is one file and so one task; costly column work on it would
    leave all other cores idle.  Larger inputs are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
