"""Answers in attempts: the first usable one counts, failed windows are named, a rerun asks what is open."""

from pyspark.sql import functions as F

from cadenza.plans import attempts

GOOD = '[{"start": 1.0, "end": 31.0, "hook": "h", "category": "story", "score": 70}, {"start": 900, "end": 930}]'


def words(spark):
    return spark.range(400).select(F.lit(1).cast("long").alias("transcript_id"), F.lit(0).cast("long").alias("seg_idx"), F.col("id").alias("word_idx"), F.lit("w").alias("text"), (F.col("id") * 500).alias("start_ms"), (F.col("id") * 500 + 400).alias("end_ms"))


def test_first_usable_attempt_counts(spark):
    rows = [(1, 0, 0, GOOD, None), (1, 1, 0, "nothing", None), (1, 1, 1, GOOD, None), (1, 1, 2, GOOD, None), (1, 2, 0, None, "timed out"), (1, 3, 0, "[]", None), (1, 3, 1, "[]", None), (1, 4, 0, None, "a"), (1, 4, 1, None, "b"), (1, 5, 0, "nothing", None), (1, 5, 1, '[{"start": 900, "end": 930}]', None)]
    answers = spark.createDataFrame(rows, attempts.ANSWERS)
    windows, parsed = attempts.judged(answers, words(spark))
    assert {r.window: (r.attempt, r.outcome) for r in windows.collect()} == {0: (0, "usable"), 1: (1, "usable"), 2: (0, "open"), 3: (1, "failed"), 4: (1, "failed"), 5: (1, "failed")}
    assert sorted((r.chunk_index, r.attempt) for r in parsed.filter("reject_reason is null").collect()) == [(0, 0), (1, 1)]
    reasons = {(r.window, r.item): r.reason for r in attempts.rejections(windows, parsed, answers).collect()}
    gap = "timestamps 900.0-930.0 do not match the transcript"
    assert reasons == {(0, 1): f"window 0: {gap}", (1, 1): f"window 1: {gap}", (3, 0): "window 3: no candidates returned", (4, 0): "window 4: b", (5, 0): f"window 5: {gap}"}


def test_a_rerun_asks_what_is_open(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), []
    prompts = spark.createDataFrame([(1, w, f"prompt {w}") for w in range(5)], "transcript_id long, window long, prompt string")

    def ask(left):
        asked.append(sorted((r.window, r.attempt, r.temperature) for r in left.collect()))
        bad = (F.col("window") == 3) | ((F.col("window") == 2) & (F.col("attempt") == 0))
        return left.select("transcript_id", "window", "attempt", F.when(~bad, GOOD).alias("text"), F.when(bad, "timed out").alias("error"))

    # An earlier run was cut off behind two windows.
    spark.createDataFrame([(1, 0, 0, GOOD, None), (1, 1, 0, "nothing", None)], attempts.ANSWERS).write.parquet(path)
    windows, _ = attempts.resume(prompts, words(spark), path, ask)
    assert asked == [[(1, 1, 0.4), (2, 0, 0.2), (3, 0, 0.2), (4, 0, 0.2)], [(2, 1, 0.4), (3, 1, 0.4)]]
    assert {r.window: r.outcome for r in windows.collect()} == {0: "usable", 1: "usable", 2: "usable", 3: "failed", 4: "usable"}
    attempts.resume(prompts, words(spark), path, ask)
    assert len(asked) == 2
