"""Staged tables in the cluster's shared folder, and broadcasts behind a check of their size."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The paths that this process has staged, by application.
STAGED: dict[str, list[str]] = {}
#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session within one process, as in tests, gets a temporary one; on a cluster it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df once and read it back.

    The table lies in the shared folder, so whatever reads it survives the loss of an executor, reads only the
    columns it needs and doesn't repeat the work before. It stays until drop_staged(). With release, the shuffle files of the
    write are deleted with its end, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, str(release or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*tables: DataFrame) -> DataFrame:
    """Staged tables of one schema as one, by a single scan."""
    folders = sorted({f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()})
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*folders) if folders else tables[0]


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    jvm, held = spark.sparkContext._jvm, STAGED.get(spark.sparkContext.applicationId, [])
    gone = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for t in tables for f in t.inputFiles()}
    for p in [p for p in held if p.rsplit("/", 1)[1] in gone]:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        held.remove(p)


def drop_staged(spark: SparkSession) -> int:
    """Deletes what this application has staged, once its results are written; returns how many tables."""
    paths = STAGED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if df has at most so many rows; otherwise df as it is, for a shuffled join.

    Pass a staged or otherwise cheap df: its rows are counted, up to one more than the bound.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
