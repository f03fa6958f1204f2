"""The whole flows on generated transcripts."""

from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.plans import pipelines
from cadenza.sources import tables

SF = "/root/testdata/sf0.001"


def test_discover_then_clips(spark):
    segs = tables.segments(spark, SF)
    words, media = tables.words(segs), catalog.media_of(segs)
    answers = catalog._answers(segs)
    ranking = segs.select("transcript_id").distinct().withColumn("text", F.lit('[{"id": 1, "rank": 1}, {"id": 0, "rank": 2}]'))
    moments, rejections = pipelines.discover(segs, words, answers.unionByName(answers.limit(1).withColumn("text", F.lit("no"))), ranking)
    assert moments.count() > 0 and rejections.filter("reject_reason like 'No valid JSON%'").count() == 1
    assert moments.filter("final_score < 0 or final_score > 1").count() == 0
    clips = pipelines.generate_clips(segs, words, media, moments, pipelines.Settings(clips=2)).cache()
    per = clips.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first().m
    assert per <= 2 and clips.filter("strategy = 'discovered'").count() > 0
    assert clips.filter("end_ms - start_ms > 60000").count() == 0
    subtitles = pipelines.clip_captions(clips, words)
    assert subtitles.filter("start_ms >= end_ms").count() == 0 and subtitles.count() > 0


def test_small_helpers(spark):
    one = spark.range(1)
    assert len(one.select(pipelines.new_id().alias("i")).first().i) == 12
    assert one.select(pipelines.new_id(F.lit("a")).alias("i")).first() == one.select(pipelines.new_id(F.lit("a")).alias("i")).first()
    stamp = one.select(pipelines.shown_time(F.lit("2024-05-01 10:00:00").cast("timestamp")).alias("t")).first().t
    assert stamp == "2024-05-01T10:00:00.000000Z"
    runs = spark.createDataFrame([(1, 60.0, 20.0), (1, 60.0, 40.0), (2, 5.0, 0.0)], "project_id long, duration double, elapsed double")
    assert {r.project_id: r.realtime_factor for r in pipelines.throughput(runs).collect()} == {1: 2.0, 2: None}
    checked = spark.createDataFrame([(1, 3, False), (1, 1, False), (1, 2, True)], "project_id long, index long, qc_ok boolean")
    assert pipelines.failed_checks(checked).first().failed == [1, 3]
    prompts = pipelines.prompts(tables.segments(spark, SF), pipelines.Settings(window_tokens=200, context_tokens=1_000))
    assert prompts.filter("budget_issue is not null").count() == prompts.filter("length(prompt) div 4 + 768 > 900").count()
