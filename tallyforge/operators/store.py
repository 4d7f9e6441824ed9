"""Tables cut off from their lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder; a local session without either gets a temporary one, and a
    cluster without either is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        d = spark.sparkContext.getCheckpointDir()
    return d.rstrip("/")


def cut(df: DataFrame, name: str = "table", again: bool = False) -> DataFrame:
    """Writes df and reads it back. The tables of an application lie in one folder, scratch-<application id>, which may go once
    it has ended. again: the table's folder is named name and no more, and takes the place of an earlier one, which df mustn't read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{name}" + ("" if again else f"-{uuid.uuid4().hex}")
    df.write.parquet(path, mode="overwrite" if again else "error")
    return spark.read.schema(df.schema).parquet(path)
