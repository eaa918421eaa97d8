"""Session helpers: shared work folder, Arrow batch bounds, a local test session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch sent to a Python worker. A page may be 2 MB, so a batch stays in the tens of MB
#: for ordinary pages and under 1 GB even if every page has the largest size the guard lets through.
ARROW_ROWS = 500
CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g", work: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine; ``work`` becomes its ``spark.checkpoint.dir``."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    if work:
        builder = builder.config(CHECKPOINT_DIR, work)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def bound_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound Arrow batches so that a Python worker never holds many large pages at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    All executors see it, so data written there survives the loss of an executor. Only where the setting is
    unset and all runs on this machine (a ``local`` master) a temporary folder is chosen, one a session.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
        root = getattr(context, "_siltloom_work", None)
        if root is None:
            folder = tempfile.mkdtemp(prefix="siltloom-")
            atexit.register(shutil.rmtree, folder, True)
            root = context._siltloom_work = f"file://{folder}"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made(spark).append(folder)
    return folder


def _made(spark: SparkSession) -> list[str]:
    """Work folders of this session that were not removed."""
    context = spark.sparkContext
    if not hasattr(context, "_siltloom_folders"):
        context._siltloom_folders = []
    return context._siltloom_folders


@contextmanager
def temporary(spark: SparkSession):
    """Work folders made inside are removed at the end, when nothing lazy reads them any more."""
    made = _made(spark)
    before = len(made)
    try:
        yield
    finally:
        for folder in made[before:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del made[before:]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, work is done once."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for those that don't have it on their path.

    The archive is made on the driver and handed out by Spark's own file server.
    """
    context = spark.sparkContext
    if getattr(context, "_siltloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltloom-")) / "siltloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(archive))
    context._siltloom_shipped = True


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship_package(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


#: Rows up to which a narrow table (keys and a few numbers, well under 100 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a join side: written, counted, and marked for broadcast only if it has at most ``rows`` rows.

    Beyond that the join shuffles, where adaptive execution splits skewed partitions.
    """
    from pyspark.sql import functions as F

    df = cut(df, name)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for a pass that costs far more than its rows' transport.

    Inputs that already have enough partitions, as all large ones do, are left as they are and not shuffled.
    """
    if df.isStreaming:
        return df
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # the outcome of a shuffle, whose partitions are only known once it has run
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if execution.toRdd().getNumPartitions() >= cores else df.repartition(cores)
