"""Answers in attempts: each window of a transcript is asked until an answer gives a candidate or its attempts run out.

Answers (transcript_id, window, attempt, text, error) stand in a table that only grows; what is still to ask follows
from it by an anti-join, so a run that was cut off asks what is open and nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates
from .stages import staged

ANSWERS = "transcript_id long, window long, attempt int, text string, error string"
RETRIES = 1


def judged(answers: DataFrame, words: DataFrame, retries: int = RETRIES, min_ms: int = 25_000, max_ms: int = 60_000) -> tuple[DataFrame, DataFrame]:
    """(windows, parsed) of answers: windows (transcript_id, window, attempt, outcome) with the attempt that counts, and the
    candidates and rejections of those attempts, as candidates.parse() gives them.

    outcome: `usable` by the first attempt that gives a candidate; else `failed` when the last attempt has been made,
    which then counts; else `open`, with the last one made."""
    read = answers.filter("error is null").select("transcript_id", F.col("window").alias("window_idx"), "attempt", "text")
    parsed = staged(candidates.parse(read, words, min_ms, max_ms), "attempts-parsed")
    usable = parsed.filter("reject_reason is null").groupBy("transcript_id", F.col("chunk_index").alias("window")).agg(F.min("attempt").alias("usable"))
    made = answers.groupBy("transcript_id", "window").agg(F.max("attempt").alias("last"))
    outcome = F.when(F.col("usable").isNotNull(), "usable").when(F.col("last") >= retries, "failed").otherwise("open")
    windows = made.join(usable, ["transcript_id", "window"], "left").select("transcript_id", "window", F.coalesce("usable", "last").alias("attempt"), outcome.alias("outcome"))
    windows = staged(windows, "attempts-judged")
    counts = windows.filter("outcome <> 'open'").select("transcript_id", F.col("window").alias("chunk_index"), "attempt")
    return windows, parsed.join(counts, ["transcript_id", "chunk_index", "attempt"], "left_semi")


def rejections(windows: DataFrame, parsed: DataFrame, answers: DataFrame) -> DataFrame:
    """(transcript_id, window, item, reason) of judged(): why items of the attempts that count were rejected, the error of
    a failed window's last attempt, or that it gave no candidates. A reason names its window."""
    named = lambda reason: F.concat(F.lit("window "), F.col("window").cast("string"), F.lit(": "), reason).alias("reason")
    items = parsed.filter("reject_reason is not null").select("transcript_id", F.col("chunk_index").alias("window"), "item", "reject_reason")
    items = items.select("transcript_id", "window", "item", named(F.col("reject_reason")))
    failed = windows.filter("outcome = 'failed'").join(answers.select("transcript_id", "window", "attempt", "error"), ["transcript_id", "window", "attempt"])
    silent = failed.join(items.select("transcript_id", "window").distinct(), ["transcript_id", "window"], "left_anti")
    return items.unionByName(silent.select("transcript_id", "window", F.lit(0).alias("item"), named(F.coalesce("error", F.lit("no candidates returned")))))


def open_windows(prompts: DataFrame, windows: DataFrame) -> DataFrame:
    """What is still to ask of prompts (transcript_id, window, prompt): its next attempt, and a temperature that rises with
    it. windows: of judged()."""
    waiting = windows.filter("outcome = 'open'").select("transcript_id", "window", (F.col("attempt") + 1).alias("next"))
    settled = windows.filter("outcome <> 'open'").select("transcript_id", "window")
    left = prompts.join(settled, ["transcript_id", "window"], "left_anti").join(waiting, ["transcript_id", "window"], "left")
    attempt = F.coalesce("next", F.lit(0)).cast("int")
    return left.select("transcript_id", "window", "prompt", attempt.alias("attempt"), F.round(0.2 + 0.2 * attempt, 2).alias("temperature"))


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """The answers that a table holds; none where it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(ANSWERS).parquet(path) if there else spark.createDataFrame([], ANSWERS)


def resume(prompts: DataFrame, words: DataFrame, path: str, ask: Callable[[DataFrame], DataFrame], retries: int = RETRIES) -> tuple[DataFrame, DataFrame]:
    """judged() answers to all prompts: asks what the table of answers leaves open, and adds what it gets, until nothing is.

    ask: open windows (transcript_id, window, prompt, attempt, temperature) to answers, as a table job."""
    spark = prompts.sparkSession
    for _ in range(retries + 1):
        windows, _ = judged(stored_answers(spark, path), words, retries)
        left = staged(open_windows(prompts, windows), "attempts-open")
        if left.isEmpty():
            break
        ask(left).select("transcript_id", "window", "attempt", "text", "error").write.mode("append").parquet(path)
    return judged(stored_answers(spark, path), words, retries)
