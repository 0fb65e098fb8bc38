"""Tables written once in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    It is deleted by ``forget``, or when the driver ends. Only with a local master may the setting be
    missing: then a temporary folder serves.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="scopelens-")
    folder = f"{named}/scopelens-{uuid.uuid4().hex}"
    _written[folder] = spark
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget() -> None:
    """Deletes all that was stored so far. Frames that read from it are of no use afterwards."""
    while _written:
        folder, spark = _written.popitem()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  a session that has ended deletes nothing
            continue


atexit.register(forget)
