"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import shared_folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed; once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_retenta_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp(prefix='package-')}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._retenta_shipped = True


class Workspace:
    """A folder of one run below ``spark.checkpoint.dir``. Tables written to it survive lost executors.

    Where the session names no such folder, a local session gets a temporary one; a cluster session is refused,
    as its executors don't share a local folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        base = shared_folder(spark)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='llm-')}"
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.folder = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: Spark then knows its size, and what led to it is not run again."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` itself if it only reads files and picks rows and columns, else written and read back.

        The rows of a table of files come in the same partitions and order each time, so they can be known by place.
        """
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() in ("Project", "Filter"):
            plan = plan.children().head()
        return df if plan.nodeName() == "LogicalRelation" else self.stage(df, name)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
