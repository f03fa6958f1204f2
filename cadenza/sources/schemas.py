"""The stored tables: projects, jobs and clips. Names and types are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stages import staged

PROJECTS = """project_id string, name string, source_path string, source_filename string, source_hash string, duration double, width int, height int,
fps double, video_codec string, audio_codec string, has_audio boolean, size_bytes bigint, audio_path string, created_at timestamp"""
JOBS = """job_id string, project_id string, type string, status string, progress double, current_stage string, error string, params string, result string,
created_at timestamp, started_at timestamp, completed_at timestamp"""
CLIPS = """clip_id string, project_id string, index int, start_ms double, end_ms double, duration double, text string, hook string, topic string, category string,
score double, strategy string, boundary_score double, boundary_notes string, crop_strategy string, render_path string, size_bytes bigint, qc_ok boolean,
qc_issues string, created_at timestamp"""
TABLES = {"projects": PROJECTS, "jobs": JOBS, "clips": CLIPS}


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table, with the columns that it must have; what a file lacks is null."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def store(rows: DataFrame, folder: str, name: str) -> None:
    """Replaces a stored table, of a project each folder where rows have one. Columns that rows lack are null."""
    spark = rows.sparkSession
    whole = spark.createDataFrame([], TABLES[name]).unionByName(rows, allowMissingColumns=True)
    whole.select(*spark.createDataFrame([], TABLES[name]).columns).write.mode("overwrite").parquet(f"{folder}/{name}")


def bucket(project_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(project_id.cast("string")), F.lit(buckets)).cast("int")


def store_clips(clips: DataFrame, path: str, buckets: int = 64) -> None:
    """A clip table in folders by bucket of project_id."""
    clips.withColumn("bucket", bucket(F.col("project_id"), buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, new: DataFrame | None, buckets: int) -> None:
    """Rewrites the buckets of the touched projects, without their rows and with new ones; other folders stay as they are."""
    touched = staged(touched.select("project_id").distinct(), "touched").withColumn("bucket", bucket(F.col("project_id"), buckets))
    numbers = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most `buckets`
    if not numbers:
        return
    old = spark.read.parquet(path)
    kept = old.filter(F.col("bucket").isin(numbers)).join(touched.select("project_id"), "project_id", "left_anti").select(*old.columns)
    if new is not None:
        kept = kept.unionByName(new.withColumn("bucket", bucket(F.col("project_id"), buckets)).select(*old.columns))
    rows = staged(kept, "rewritten")  # read whole before its folders are replaced
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    # A bucket that has no rows left isn't overwritten: its folder goes.
    left = {r.bucket for r in rows.select("bucket").distinct().collect()}
    for number in set(numbers) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_clips(spark: SparkSession, path: str, new: DataFrame, buckets: int = 64) -> None:
    """Replaces the clips of the projects in `new` in a table of store_clips()."""
    _rewrite(spark, path, new, new, buckets)


def delete_projects(spark: SparkSession, path: str, projects: DataFrame, buckets: int = 64) -> None:
    """Removes the clips of projects (project_id) from a table of store_clips()."""
    _rewrite(spark, path, projects, None, buckets)
