"""The Spark session used by the tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "quillstone", memory: str = "4g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of the checkpoints, as the session names it.

    Where none is named, one of this machine is made in local mode, as in a test; on a cluster the other machines
    could not see it, and that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def files_of(spark: SparkSession, folder: str):
    """The file system of a folder and its path, as Hadoop sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    files, path = files_of(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, wherever it is stored."""
    files, path = files_of(spark, folder)
    files.delete(path, True)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, which `release` deletes, or else the end of the application.

    checkpoint() would keep the size that was estimated for the plan; where a loop joins its own results, that
    estimate grows with its square each time, until the driver is busy with one number. A table has its real size.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, root = files_of(spark, _tables(spark))
    files.deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that were saved so far, once no result that is still to be read depends on them."""
    remove(spark, _tables(spark))
