"""Ranged reads, the speech source, the caption sink, bucketed stores, job streams, publishing, sessions."""

import hashlib
import json
import random
import time
import wave

import pytest
from pyspark.sql import functions as F

from cadenza.sources import caption_sink, files, readers, schemas, speech_source
from cadenza.streaming import jobs

EVENT = "job_id long, seq long, status string, progress double"


def test_fingerprint_of_a_file_of_three_gigabytes(spark, tmp_path):
    size = 3 << 30
    with (tmp_path / "long.mp4").open("wb") as f:  # sparse: only its ends are written
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    (tmp_path / "short.mp4").write_bytes(b"abc" * 10)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.fingerprints(files.listed(spark, str(tmp_path))).collect()}
    part = 8 << 20
    want = hashlib.sha256(str(size).encode() + b"head".ljust(part, b"\0") + b"tail".rjust(part, b"\0")).hexdigest()
    assert (got["long.mp4"].fingerprint, got["long.mp4"].bytes_read) == (want, 2 * part)
    assert (got["short.mp4"].fingerprint, got["short.mp4"].bytes_read) == (hashlib.sha256(b"30" + b"abc" * 10).hexdigest(), 30)
    probes = spark.createDataFrame([(r.path, name == "long.mp4") for name, r in got.items()], "path string, has_audio boolean")
    up = {r.path.rsplit("/", 1)[1]: r for r in readers.uploads(spark, str(tmp_path), 8 << 30, probes).collect()}
    assert up["long.mp4"].fingerprint == want and up["short.mp4"].reject_reason == "no audio track" and up["short.mp4"].fingerprint is None
    assert {r.reject_reason for r in readers.uploads(spark, str(tmp_path), 100, probes.limit(0)).collect()} == {"file too large", "could not be inspected"}


class Loud(speech_source.Stub):
    name, automatic = "loud", True

    def transcribe(self, path, duration_ms, model, language, offset):
        return super().transcribe(path, duration_ms, model, language, offset) | {"language": "xx"}


class Absent(speech_source.Stub):
    name, automatic = "absent", True

    def is_available(self):
        return False, "not installed"


def test_speech_source(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1_000)
        w.writeframes(b"\0\0" * 6_000)
    (tmp_path / "b.wav.json").write_text(json.dumps({"language": "de", "segments": [{"start": 1.0, "end": 2.0, "text": " hallo ", "words": [{"word": "hallo", "start": 1.0, "end": 1.5}, {"word": "weg", "start": None, "end": 2.0}]}]}))
    rows = [("a", str(tmp_path / "a.wav"), None), ("b", str(tmp_path / "b.wav"), None), ("c", None, 5_100)]
    media = spark.createDataFrame(rows, "transcript_id string, path string, duration_ms long")
    media.repartition(3).write.parquet(str(tmp_path / "media"))
    media.filter("transcript_id = 'b'").write.parquet(str(tmp_path / "one"))
    speech_source.register(spark)
    read = lambda folder, **o: spark.read.format("cadenza_speech").options(**o).load(str(tmp_path / folder))
    stub = read("media", backend="stub", offset="100")
    assert stub.rdd.getNumPartitions() == 3
    got = {r.transcript_id: r for r in stub.collect()}
    assert {k: (r.backend, r.duration, sum(len(s.words) for s in r.segments)) for k, r in got.items()} == {"a": ("stub", 6.0, 16), "b": ("stub", 10.0, 26), "c": ("stub", 5.1, 14)}
    assert got["c"].segments[1].words[0] == ("word13", 105.0, 105.1, 0.9)
    b = read("one").collect()[0]  # auto: recorded, never the stub
    assert (b.backend, b.language, b.duration, [tuple(w) for w in b.segments[0].words]) == ("recorded", "de", 2.0, [("hallo", 1.0, 1.5, None)])
    with pytest.raises(Exception, match="unknown speech backend 'x': recorded, stub"):
        read("media", backend="x").collect()
    with pytest.raises(RuntimeError, match="absent: not installed"):
        speech_source.chosen("auto", {"absent": Absent, "stub": speech_source.Stub})
    speech_source.register(spark, (Absent, Loud))
    assert {r.backend for r in read("media", backend="auto").collect()} == {"loud"}
    speech_source.register(spark)


def test_captions_of_ten_thousand_clips(spark, tmp_path):
    docs = spark.range(10_000).select(F.col("id").alias("clip_id"), F.concat(F.lit("text of "), "id", F.lit("\nend\n")).alias("document"))
    out = tmp_path / "captions"
    caption_sink.write_documents(docs.repartition(8), str(out))
    assert len(list(out.glob("part-*"))) == 8 and len(list(out.glob("part-*/*.ass"))) == 10_000 and not list(out.glob("_*"))
    back = caption_sink.read_documents(spark, str(out)).join(docs.select(F.col("clip_id").cast("string").alias("name"), F.col("document").alias("own")), "name")
    assert back.filter("document = own").count() == 10_000
    # A task that fails leaves none of its job's files, and those of earlier jobs.
    bad = docs.repartition(8).withColumn("document", F.when(F.col("clip_id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="broken"):
        caption_sink.write_documents(bad, str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("part-*"))
    caption_sink.clear_staging(str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("**/*.ass"))
    caption_sink.write_documents(docs.limit(3), str(out), "overwrite")
    assert len(list(out.glob("part-*/*.ass"))) == 3
    assert caption_sink.safe_name("../ä b") == "%2E./%C3%A4%20b".replace("/", "%2F")


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "clips")
    clips = spark.range(200).select((F.col("id") % 40).alias("project_id"), F.col("id").alias("clip_id"))
    schemas.store_clips(clips, path, 8)
    before = {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "clips").glob("bucket=*/*.parquet")}
    own = {r.project_id: r.b for r in clips.select("project_id", schemas.bucket(F.col("project_id"), 8).alias("b")).distinct().collect()}
    new = spark.createDataFrame([(3, -1), (3, -2), (77, -3)], "project_id long, clip_id long")
    schemas.replace_clips(spark, path, new, 8)
    other = {77: new.filter("project_id = 77").select(schemas.bucket(F.col("project_id"), 8)).first()[0]}
    after = {f.relative_to(path): f.stat().st_mtime_ns for f in (tmp_path / "clips").glob("bucket=*/*.parquet")}
    touched = {own[3], other[77]}
    same = {k: v for k, v in before.items() if int(k.parts[0].split("=")[1]) not in touched}
    assert same and all(after[k] == v for k, v in same.items())
    want = {(r.project_id, r.clip_id) for r in clips.collect() if r.project_id != 3} | {(3, -1), (3, -2), (77, -3)}
    rows = lambda: {(r.project_id, r.clip_id) for r in spark.read.parquet(path).collect()}
    assert rows() == want
    gone = [p for p, b in own.items() if b == own[3]]
    schemas.delete_projects(spark, path, spark.createDataFrame([(p,) for p in gone], "project_id long"), 8)
    assert rows() == {w for w in want if w[0] not in gone}
    schemas.delete_projects(spark, path, spark.createDataFrame([], "project_id long"), 8)


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_stream_in_any_order(spark, tmp_path, seed):
    """Whatever batches the events come in, the last state of each job is that of all events at once."""
    rng = random.Random(seed)
    rows = [(j, s, rng.choice(["QUEUED", "PROCESSING", "PROCESSING", "COMPLETED", "CANCELLED"]) if s % 3 == 2 else "PROCESSING", rng.choice([None, -1.0, 0.5, 2.0])) for j in range(8) for s in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, EVENT)
    step = len(rows) // 3 + 1
    for n, at in enumerate(range(0, len(rows), step)):
        spark.createDataFrame(rows[at : at + step], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01 * n)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def put(batch, number):
        for r in batch.collect():
            seen[r.job_id] = (r.status, r.progress, r.n_events)

    q = jobs.follow_jobs(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {r.job_id: (r.status, r.progress, r.n_events) for r in jobs.latest_state(e).collect()}


def test_ended_jobs_are_closed(spark, tmp_path):
    """Once its timer has fired an ended job takes no more events, and holds none."""
    seen = []
    put = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 5, "COMPLETED", 1.0), (2, 5, "PROCESSING", 0.5)])
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    q = jobs.follow_jobs(stream, 50).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            time.sleep(0.2)

    wait(2)
    batch = q.lastProgress["batchId"] if q.lastProgress else 0
    end = time.time() + 60
    while (q.lastProgress or {"batchId": 0})["batchId"] < batch + 4 and time.time() < end:
        time.sleep(0.2)
    put([(1, 1, "FAILED", 0.1), (2, 6, "PROCESSING", 0.7)])
    wait(3)
    q.stop()
    assert sorted(seen[:2]) == [(1, "COMPLETED", 1.0, 1), (2, "PROCESSING", 0.5, 1)] and seen[2:] == [(2, "PROCESSING", 0.7, 2)]


def test_a_restarted_query_writes_no_row_twice(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:01", "click" if i % 2 else "view", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    feed, told = jobs.ProgressFeed(), []
    spark.streams.addListener(feed)
    path, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (events.filter("id < 20"), events.filter("id >= 20")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.progress_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="10 days")
        jobs.publish(stream, path, ck, lambda batch, n: told.append((n, batch.count()))).awaitTermination()
    # The last batch runs again: its commit is lost, as when a driver ends before it is written.
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "ck" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    stream = jobs.progress_rollup(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="10 days")
    jobs.publish(stream, path, ck).awaitTermination()
    spark.streams.removeListener(feed)
    got = jobs.published(spark, path, "window_start", "event_type")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.progress_rollup(events).select(*got.columns).collect()))
    rows = spark.read.parquet(path)
    assert rows.count() == rows.select("batch", "window_start", "event_type").distinct().count() and told[0][0] == 0


def test_sessions_stream_like_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(u, 1_700_000_000 + at * 60, 1.0) for u in range(3) for at in rng.sample(range(600), 30)]
    events = spark.createDataFrame(rows, "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value")
    want = sorted(map(tuple, jobs.session_rollup(events).collect()))
    plain = 0
    for u in range(3):
        at = sorted(t for x, t, _ in rows if x == u)
        plain += 1 + sum(b - a > 1_800 for a, b in zip(at, at[1:]))
    assert len(want) == plain
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([(99, 1_800_000_000, 0.0)], "user_id long, t long, value double").select("user_id", F.timestamp_seconds("t").alias("ts"), "value")
    stream = jobs.session_rollup(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), late="30 days")
    run = lambda: stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    flush.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
