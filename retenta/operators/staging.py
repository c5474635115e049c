"""The folder all executors share, and intermediate results written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named in ``spark.checkpoint.dir``, else the context's checkpoint folder, else None."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def use_checkpoints(spark: SparkSession) -> None:
    """Make sure ``checkpoint()`` has a shared folder to write to."""
    if spark.sparkContext.getCheckpointDir():
        return
    folder = shared_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(folder)


def staged(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a result to ``folder`` under ``name`` (replacing an earlier one) and read it back.

    The plan then starts from a table of known size, so Spark broadcasts it if it is small and streams the
    big side past it; a lost executor cannot undo it. Runs one job.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_is(df: DataFrame) -> DataFrame:
    """The stage that stores nothing."""
    return df


class RunFolder:
    """Intermediate results of one run, in a folder of their own that no other run uses.

    ``folder`` is a place all executors share, as the run's output or ``spark.checkpoint.dir``. Each call of the
    stage stores one result and reads it back. As a context manager it removes the folder at the end.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self._count = spark, f"{folder.rstrip('/')}/run-{uuid.uuid4().hex}", 0

    @classmethod
    def of_session(cls, spark: SparkSession) -> RunFolder:
        """In the session's shared folder; a local session that names none gets a temporary one."""
        folder = shared_folder(spark)
        if not folder:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="retenta-")
            spark.sparkContext.setCheckpointDir(folder)
        return cls(spark, folder)

    def __call__(self, df: DataFrame) -> DataFrame:
        self._count += 1
        return staged(df, self.path, str(self._count))

    def __enter__(self) -> RunFolder:
        return self

    def __exit__(self, *exc: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
