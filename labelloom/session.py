"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Skewed joins are split at run time, small shuffles are merged, and a join side is
# broadcast only when its measured size is under the threshold.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

#: Bytes of input for one partition of a shuffle before adaptive execution merges small ones.
PARTITION_INPUT = 4 << 20
#: Bytes up to which adaptive execution merges partitions, at most.
MERGED_BYTES = 32 << 20


def input_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.agg(F.sum("length")).first()[0] or 0


def prepare(spark: SparkSession, path: str) -> None:
    """Apply ``SETTINGS``, and let the number of shuffle partitions grow with the input.

    With a fixed number each task's sorts and hash tables grow with the tables. The session's
    own number is the least; adaptive execution merges partitions that turn out small.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(spark, path) // PARTITION_INPUT))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(number))
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(merged))
    spark.conf.set(merged, str(min(given, MERGED_BYTES)))


def local_session(cores: str = "8", app: str = "labelloom", memory: str = "12g") -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in ``spark.checkpoint.dir``.

    Executors can be lost without losing what lies there. Only a local session without that
    setting, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that starts here go as soon as it has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read on from there.

    Only the stored rows stay on disk: the shuffle files of the write are removed with it.
    ``instead_of`` is an earlier result of this function that nothing reads any more, such as
    the table of the last round; its files are removed.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if instead_of is not None:
        discard(instead_of)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def sent_if_few(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """``df``, stored; a join sends it to all tasks where it has at most ``most`` rows.

    Spark does not know how small a filtered or parsed table is, and adaptive execution finds
    out when the other side of the join has been shuffled already.
    """
    found = stored(df, name)
    return F.broadcast(found) if found.count() <= most else found


def discard(df: DataFrame) -> None:
    """Remove the files of a result of ``stored`` that nothing reads any more."""
    old = getattr(df, "stored_at", None)
    if old is not None:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
