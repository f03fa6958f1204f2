"""Text, JSON, media and job functions."""

import json

import pytest
from pyspark.sql import functions as F

from cadenza.functions import json_recovery, media, text
from cadenza.sources import readers
from cadenza.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,clean", [("  “Hello,” ", "hello,”".rstrip("”,")), ("'So...'", "so"), ("Y'know?", "y'know"), ("…", "…"), (" Wow! ", "wow"), ("", "")])
def test_clean(spark, raw, clean):
    expected = raw.strip().strip("\"'“”‘’").rstrip(",.!?;:").lower()
    assert one(spark, text.clean(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw", ["Done.", 'He said "no!"', "wait…", "and then", "really?’ ", "x.y", ""])
def test_ends_sentence(spark, raw):
    assert one(spark, text.ends_sentence(F.col("t")), t=raw) == raw.strip().rstrip("\"'”’").endswith((".", "!", "?", "…"))


def test_similarity_calibration(spark):
    rows = [("I quit my job to build a company", "I quit my job and built my own company", True), ("The moon landing changed physics", "How to bake sourdough bread at home", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    for r in df.select("same", text.lexical_similarity(text.tokens(F.col("a")), text.tokens(F.col("b")), text.trigrams(F.col("a")), text.trigrams(F.col("b"))).alias("s")).collect():
        assert (r.s >= 0.27) == r.same
    assert one(spark, text.lexical_similarity(text.tokens(F.col("a")), text.tokens(F.col("a")), text.trigrams(F.col("a")), text.trigrams(F.col("a"))), a="") == 0.0


#: Damage to a list of one item, by what is wrong with it.
DAMAGED = {
    "nothing": '[{"start": 1}]',
    "a fence": '```json\n[{"start": 1}]\n```',
    "a bare fence": '```\n[{"start": 1}]\n```',
    "an open fence": '```json\n[{"start": 1}]',
    "prose before": 'Here are the best:\n[{"start": 1}]',
    "prose around": 'Sure! [{"start": 1}] ok? [2]',
    "comma in an object": '[{"start": 1,}]',
    "comma in an array": '[{"start": 1} , ]',
    "typographic quotes": "[{“start”: 1}]",
    "bare keys": "[{start: 1}]",
    "no-break spaces": '[\xa0{"start":\xa01}]',
    "all of it": "x {moments:\xa0[{“start” : 1,},]} y",
    "a known key": '{"clips": [{"start": 1}], "other": [2]}',
    "one item": '{"start": 1}',
    "an unknown key": '{"whatever": [{"start": 1}]}',
    "an object in prose": 'best: {"start": 1} fine',
    "an object in a fence": 'see [here\n```json\n{"start": 1}\n```',
}


@pytest.mark.parametrize("raw", DAMAGED.values(), ids=DAMAGED.keys())
def test_damaged_lists(raw):
    assert json_recovery.read_list(raw) == [{"start": 1}]


def test_values_that_are_read():
    read = json_recovery.read
    assert read('say: [{"hook": "a ] \\" } b"}] end') == [{"hook": 'a ] " } b'}]
    assert read('before {"hook": "he said {this} aloud", "n": 1} after') == {"hook": "he said {this} aloud", "n": 1}
    assert read('{"a": –5, "b": "x – y", "c": [1.5e—2]}') == {"a": -5, "b": "x - y", "c": [0.015]}
    assert read('{"a": "x – “y”"}') == {"a": "x – “y”"}  # nothing had to be mended
    assert read("{“a”: “it’s”,}") == {"a": "it's"}
    assert read('at [10.0] there is {"a": 1}') == [10.0]
    assert read('{"a": 1, "a": 2, "b": [true, false, null, -0.5E+1, 0]}') == {"a": 2, "b": [True, False, None, -5.0, 0]}
    assert str(read("[NaN, -Infinity]")) == "[nan, -inf]" and read('"only text"') == "only text"
    for raw in ("", None, " \n", "prose only", "[1, 2", '{"a" 1}', "[" * 5000, '["open', "{“a”: “open}", "[01]", "[1,,]", '["line\nbreak"]'):
        with pytest.raises(json_recovery.NoJson):
            read(raw)
    with pytest.raises(json_recovery.NoJson, match="totally broken"):
        read("totally broken output")


def test_what_is_no_list():
    for raw in ("42", '"x"', '{"a": 1}', '{"a": [1], "b": [2]}', "prose"):
        with pytest.raises(json_recovery.NoJson):
            json_recovery.read_list(raw)


@pytest.mark.parametrize("raw,rate", [("30000/1001", 30000 / 1001), ("25/1", 25.0), ("29.97", 29.97), ("0/0", None), ("N/A", None), (None, None), ("30/0", None)])
def test_frame_rates(spark, raw, rate):
    got = one(spark, media.frame_rate(F.col("t")), t=raw)
    assert got == (None if rate is None else pytest.approx(rate))


def test_probe_cases(spark):
    v = {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "25/1", "duration": "9.5"}
    a = {"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}
    probe = lambda **p: one(spark, media.probe(F.col("t")), t=json.dumps(p))
    full = probe(format={"duration": "12.5", "format_name": "mov"}, streams=[v, a])
    assert (full.duration, full.is_landscape, full.sample_rate, full.error) == (12.5, True, 48000, None)
    assert probe(format={}, streams=[v]).duration == 9.5
    assert probe(format={"duration": "N/A"}, streams=[a]).has_video is False
    assert probe(format={}, streams=[]).error == "no streams"


def test_caption_text(spark):
    assert one(spark, text.caption_escape(F.col("t")), t="a{b}\\c\nd") == "a\\{b\\}\\\\c d"
    assert one(spark, text.caption_time(F.col("t").cast("double")), t="3723.456") == "1:02:03.46"
    assert one(spark, text.caption_time(F.col("t").cast("double")), t="-4") == "0:00:00.00"


def test_speech_json_and_cache(spark, tmp_path):
    payload = json.dumps({"segments": [{"start": 0, "end": 2, "text": " hi ", "words": [{"word": "hi", "start": 0.1, "end": 0.4, "probability": 0.9}, {"word": "x", "start": None, "end": None}]}]})
    t = readers.speech_transcripts(spark.createDataFrame([("a", payload)], "transcript_id string, json string"), 100.0)
    row = t.first()
    assert row.duration == 2.0 and row.segments[0].text == "hi" and [w.start for w in row.segments[0].words] == [100.1]
    stored = t.withColumn("cache_key", F.lit("k")).withColumns({c: F.lit("m") for c in ("backend", "model")})
    readers.write_transcripts(stored, str(tmp_path / "t"))
    (tmp_path / "t" / "part-bad.json").write_text("{broken\n")
    back = readers.read_transcripts(spark, str(tmp_path / "t"))
    assert [r.cache_key for r in back.collect()] == ["k"]
    hits, misses = readers.cached(spark.createDataFrame([("k",), ("z",)], "cache_key string"), back)
    assert hits.count() == 1 and [r.cache_key for r in misses.collect()] == ["z"]


def test_uploads(spark, tmp_path):
    for name, content in (("a.mp4", b"abc"), ("b.txt", b"abc"), ("c.mov", b""), ("d.mkv", b"x" * 50)):
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in readers.uploads(spark, str(tmp_path), 40).collect()}
    # Spark's reader passes over files without bytes.
    assert got == {"a.mp4": None, "b.txt": "unsupported type", "d.mkv": "file too large"}


def test_jobs_batch_and_recovery(spark):
    rows = [(1, 1, "QUEUED", 0.0), (1, 2, "PROCESSING", 9.0), (1, 3, "COMPLETED", 1.0), (1, 4, "PROCESSING", 0.2), (2, 1, "PROCESSING", -5.0)]
    e = spark.createDataFrame(rows, "job_id long, seq long, status string, progress double")
    got = {r.job_id: (r.status, r.progress, r.n_events) for r in jobs.latest_state(e).collect()}
    assert got == {1: ("COMPLETED", 1.0, 3), 2: ("PROCESSING", 0.0, 1)}
    j = spark.createDataFrame([(1, "PROCESSING", None), (2, "QUEUED", None)], "job_id long, status string, error string")
    assert {r.job_id: r.status for r in jobs.recover(j).collect()} == {1: "FAILED", 2: "QUEUED"}


def test_job_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, "QUEUED", 0.0), (1, 2, "PROCESSING", 0.5), (2, 1, "PROCESSING", 0.1), (2, 2, "FAILED", 0.3), (2, 3, "PROCESSING", 0.9)]
    e = spark.createDataFrame(rows, "job_id long, seq long, status string, progress double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.follow_jobs(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("jobs_out").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.job_id, r.status, r.n_events) for r in jobs.latest_state(e).collect()}
    assert {(r.job_id, r.status, r.n_events) for r in spark.table("jobs_out").collect()} == want


def test_lists(spark):
    clips = spark.createDataFrame([(1, 1, 0, 0.5, None, 9.0, 5), (2, 1, 1, None, 0.3, 3.0, 2), (3, 1, 2, 0.9, 0.1, 5.0, 9)], "clip_id long, project_id long, index long, score double, boundary_score double, duration double, start_ms long")
    order = lambda by: [r.clip_id for r in readers.sorted_clips(clips, by).collect()]
    assert order("score") == [3, 1, 2] and order("boundary") == [2, 3, 1] and order("duration") == [2, 3, 1] and order("start") == [2, 1, 3] and order("?") == [1, 2, 3]
    assert readers.replace_by_project(clips, clips.filter("clip_id = 1")).count() == 1
    media = spark.createDataFrame([(1, 10_000), (2, 5_100), (3, 0)], "transcript_id long, media_ms long")
    made = readers.synthetic_transcripts(media)
    assert {r.transcript_id: r["count"] for r in made.groupBy("transcript_id").count().collect()} == {1: 26, 2: 14}
    assert made.filter("transcript_id = 2 and seg_idx = 1").select("text", "start_ms", "end_ms").collect() == [("word13", 5_000, 5_100)]


def test_progress_rollup_streams_like_a_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.progress_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("rollup_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in jobs.progress_rollup(events).collect()}
    assert {tuple(r) for r in spark.table("rollup_out").collect()} == want


def test_encoder_progress_lines(spark):
    lines = spark.createDataFrame([(1, 1, "frame=3"), (1, 2, "out_time_us=5000000"), (1, 3, "out_time_us=99000000"), (1, 4, "out_time_us=N/A")], "job_id long, seq long, value string")
    assert [r.progress for r in jobs.progress_lines(lines, F.lit(10.0)).orderBy("seq").collect()] == [0.5, 1.0]
