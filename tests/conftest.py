import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from retenta.sources import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """``table(name, {...}, {...})``: rows of a declared source table, columns not given are NULL."""

    def make(name, *rows):
        schema = TABLES[name]
        assert all(set(r) <= set(schema.fieldNames()) for r in rows), "unknown column"
        return spark.createDataFrame([tuple(r.get(c) for c in schema.fieldNames()) for r in rows], schema)

    return make


@pytest.fixture(scope="session")
def values(spark):
    """``values(frame_column_type, [inputs], fn)``: results of a column function over literal inputs."""
    from pyspark.sql import functions as F

    def run(ddl, inputs, fn):
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
        frame = spark.createDataFrame(rows, f"i int, {ddl}")
        names = frame.columns[1:]
        return [r[0] for r in frame.orderBy("i").select(fn(*[F.col(n) for n in names]).alias("v")).collect()]

    return run
