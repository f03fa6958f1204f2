"""Stage tables: what a flow's stage has made, written once and read by the steps after it.

A stage that several later steps read would else be planned and computed once for each of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a folder of its own if all executors run on this machine, else an error,
    as other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cadenza/{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Removes all stage tables of this application. Results that read them must have been written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, written once.

    Its files are many times smaller than its rows, and Spark goes by the files: joins are told not to broadcast it. A
    stage table itself isn't written anew."""
    if getattr(df, "stage_path", None):
        return df
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
    table.stage_path = path
    return table
