"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests, the command line and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.files.minPartitionNum", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()
_cuts: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver imported it from."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, True)
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)


#: Rows in an Arrow batch; bounds what a Python worker holds when texts are long.
BATCH_ROWS = 200


def arrow_ready(spark: SparkSession) -> None:
    """Send the package to the workers and keep Arrow batches of long texts small."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by key over all shuffle partitions, ahead of work that costs far more than moving the texts.

    A file's row groups bound how many tasks of a scan have rows: a table in one large row group is one task's work,
    however many cores there are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Rows for each task that writes a table of known size.
ROWS_A_TASK = 5_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in as many partitions as that is worth, two for each core at least.

    Partitions of the last shuffle are put together, without another one: a few rows in each of very many partitions cost
    a task and a file each.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut points: the one the cluster names, or a throw-away one in local mode."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_KEY} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, root, True)
    spark.conf.set(CHECKPOINT_KEY, root)
    return root


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one; release_cuts() deletes it, too."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _cuts.append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Values that depend on how one run placed its rows (partition numbers, offsets) become plain stored
    columns, and lost executors only cost a re-read.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_cuts(spark: SparkSession) -> None:
    """Delete the cut points this driver wrote; for the end of a job, when no result is still unread."""
    settings = spark._jsc.hadoopConfiguration()
    while _cuts:
        path = spark._jvm.org.apache.hadoop.fs.Path(_cuts.pop())
        path.getFileSystem(settings).delete(path, True)
