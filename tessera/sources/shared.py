"""Tables in the folder that all executors share: they cut lineage, and survive the loss of any executor."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of a local session that names no folder.
LOCAL_FOLDER = "file:///tmp/checkpoints/tessera"
_cleaned: set[str] = set()
#: Attribute of a DataFrame that ``table`` has made: where its files are.
_PATH = "_shared_path"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, else the one that the session has set. Only a local session that
    has neither gets one of our own; on a cluster a folder of one machine would lose rows, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        folder = LOCAL_FOLDER
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there is deleted when Python ends in good order."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(clean, spark)
    return f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def small(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """A table that ``table`` has made, marked for broadcast if its files hold ``most`` bytes at most; else as it is, for a
    shuffled join."""
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(getattr(df, _PATH))
    size = p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return F.broadcast(df) if size <= most else df


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, _PATH, None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; whether there was one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has written here."""
    with contextlib.suppress(Exception):  # the session may be gone by then
        delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
