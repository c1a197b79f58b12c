"""Session factory and the few helpers that every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the session that is there."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("legajo")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEGAJO_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for each application; Spark's file server carries it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="spark-legajo-")) / "legajo.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(z.filename))
    _shipped.add(sc.applicationId)


def text_batches(spark: SparkSession) -> None:
    """Before Python work: the package on the workers, and one bound of rows and bytes for every Arrow batch.

    The settings are read when a plan runs, not when it is built, so they are the same for every operator:
    a batch ends at BATCH_BYTES or BATCH_ROWS, whichever comes first, however long the texts are.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input in few files over all cores, ahead of costly work on texts; an input with half as many partitions as cores or more stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() * 2 <= n else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and the session is local (tests).

    On a cluster without that setting it is an error: a machine's own folder would hold only a part of each table.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-legajo-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    It cuts the lineage and spares a second computation where two branches need the same rows; the
    files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/legajo-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._legajo_path = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that materialize() gave, as soon as nothing that is still to run reads them."""
    for f in frames:
        path = f._legajo_path
        _written.remove(path)
        _delete(f.sparkSession, path)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that materialize() has written so far, once no frame made from them is needed any more; how many."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n
