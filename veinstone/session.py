"""Session defaults and lineage cuts shared by every operator."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "veinstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map={**settings, **conf}).getOrCreate()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named in ``spark.checkpoint.dir``; where that is
    unset, a temporary one in local mode (tests) and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="veinstone-")


def cut_lineage(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder that all executors share. ``done``: earlier
    checkpoints that nothing but ``df`` reads; their files go once ``df`` is written."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    kept = df.checkpoint(eager=True)
    for old in done:
        drop_checkpoint(old)
    return kept


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run inside hand their rows to Python in batches of about ``most`` bytes, one row at
    least, in place of 10 000 rows of any length. The session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared folder, read back: like :func:`cut_lineage`, but later
    steps read only the columns that they use, and no text is kept uncompressed."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def rewritten(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage`, through :func:`written`: for many rounds of self-joins, as Spark
    takes a file's size as it is, while a checkpoint keeps the product of the sizes that were
    joined, a number whose digits double every round. ``done``: tables of this function that
    nothing but ``df`` reads; they are deleted."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for old in done:
        drop_written(old)
    kept = df.sparkSession.read.parquet(path)
    kept.written_to = path
    return kept


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Like :func:`rewritten`, in buckets by a column: rounds that join on it move the other side
    alone. To be deleted by :func:`drop_written` once nothing reads it."""
    spark, name = df.sparkSession, f"veinstone_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(name)
    kept = spark.table(name)
    kept.written_to, kept.table_name = path, name
    return kept


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`rewritten` or :func:`bucketed` returned. Other tables have none."""
    if name := getattr(df, "table_name", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path := getattr(df, "written_to", None):
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_checkpoint(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`cut_lineage` returned. Other tables have none."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or not plan.rdd().getCheckpointFile().isDefined():
        return
    path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The same rows, with a broadcast hint only if there are at most ``most``; counting
    stops one row after it. Larger tables are left to Spark's own choice of join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
