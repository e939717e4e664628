"""Session settings and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session as tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("planweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its file system's scheme: spark.checkpoint.dir.

    Where that is unset a local session, as in tests, gets a folder of its own; a cluster has to name one.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_planweave_folder", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = context._planweave_folder = tempfile.mkdtemp(prefix="planweave-")
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """`path` as a whole URI: one without a scheme is on Spark's default file system, and other libraries must be told so."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def shipped(spark: SparkSession) -> SparkSession:
    """The session, after its workers have been given this package, wherever the driver was started."""
    context = spark.sparkContext
    if not getattr(context, "_planweave_shipped", False):
        root = Path(__file__).resolve().parent
        if root.is_dir():
            name = Path(tempfile.mkdtemp(prefix="planweave-py-")) / "planweave.zip"
            with zipfile.ZipFile(name, "w") as out:
                for file in sorted(root.rglob("*.py")):
                    out.write(file, file.relative_to(root.parent))
            context.addPyFile(str(name))
        context._planweave_shipped = True
    return spark


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written once to the shared folder and read back: lineage is cut and a lost executor costs nothing. Deleted when the session's JVM ends, or by `discard`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/planweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a folder that is there deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/planweave-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    until_exit(spark, path)
    return path


def discard(df: DataFrame) -> None:
    """Delete a table that `stored` wrote, once nothing reads it any more."""
    path = getattr(df, "stored_at", None)
    if path:
        removed(df.sparkSession, path)
