"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "querent", master: str | None = None, **settings: str) -> SparkSession:
    """A session with DEFAULTS; keyword names have ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine for a local master, and an error for a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="querent-"))
    return context.getCheckpointDir().get()


def stored_dir(spark: SparkSession) -> str:
    """The folder of this application's stored tables."""
    return f"{shared_dir(spark).rstrip('/')}/querent-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's stored tables; data frames made from them can't be read any more."""
    removed(spark, stored_dir(spark))


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read again.

    It cuts the lineage, survives the loss of any executor, and gives Catalyst real sizes to choose joins by.
    Such tables stay until ``forgotten`` or ``clear`` is called, since results may still read them.
    """
    path = f"{stored_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_path = path
    return found


def forgotten(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` gave and nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table.stored_path)


def removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
