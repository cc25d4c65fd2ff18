"""The folder that driver and executors share, and tables kept in versions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on one machine alone, a temporary folder is set in its place."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once for all its uses, and there if an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class VersionedTable:
    """A table as folders v=1, v=2, ...: a writer adds the next one, readers take the last that is complete.

    Nothing is overwritten while it is read, and a writer that dies leaves a folder without _SUCCESS, which readers
    pass over.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        done = [p.getName() for p in names if p.getName().startswith("v=") and fs.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(n[2:]) for n in done)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.versions()[-1]}")

    def write(self, rows: DataFrame) -> int:
        """The next version. The folder's name is taken before anything is written, so of two writers one fails. A writer that
        died leaves its name below _claims, which has to be removed before that version can be written."""
        fs, at = self._fs()
        n = max([0, *self.versions()]) + 1
        claim = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_claims/{n}")
        if not fs.createNewFile(claim):
            raise FileExistsError(f"{self.path}/v={n} is being written")
        try:
            rows.write.mode("overwrite").parquet(f"{self.path}/v={n}")
        finally:
            fs.delete(claim, False)
        return n


def write_report(report: DataFrame, path: str) -> None:
    """A run's report as JSON lines."""
    report.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
