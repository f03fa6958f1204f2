"""Readers and keys at the edges: speech-model JSON, stored transcripts, uploads, fingerprints, cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from . import files

SPEECH = "language string, segments array<struct<start:double,end:double,text:string,words:array<struct<word:string,text:string,start:double,end:double,probability:double>>>>"
TRANSCRIPT = "transcript_id string, language string, backend string, model string, duration double, cache_key string, segments array<struct<start:double,end:double,text:string,words:array<struct<text:string,start:double,end:double,probability:double>>>>"
EXTENSIONS = ("mp4", "mov", "mkv", "webm", "m4v", "avi")


def speech_transcripts(payloads: DataFrame, offset: Column | float = 0.0) -> DataFrame:
    """payloads (transcript_id, json) as transcripts: times moved by an offset, words without times dropped, text
    stripped, a word's text under `word` or `text`."""
    by = F.lit(offset) if isinstance(offset, (int, float)) else offset
    p = payloads.select("transcript_id", F.from_json("json", SPEECH).alias("p"), by.alias("by"))

    def word(w: Column) -> Column:
        return F.struct(F.coalesce(w["word"], w["text"]).alias("text"), (w["start"] + F.col("by")).alias("start"), (w["end"] + F.col("by")).alias("end"), w["probability"].alias("probability"))

    def segment(s: Column) -> Column:
        timed = F.filter(F.coalesce(s["words"], F.array()), lambda w: w["start"].isNotNull() & w["end"].isNotNull())
        return F.struct((s["start"] + F.col("by")).alias("start"), (s["end"] + F.col("by")).alias("end"), stripped(s["text"]).alias("text"), F.transform(timed, word).alias("words"))

    segments = F.transform(F.coalesce("p.segments", F.array()), segment)
    read = p.select("transcript_id", F.coalesce("p.language", F.lit("unknown")).alias("language"), segments.alias("segments"), "by")
    return read.select("transcript_id", "language", "segments", F.coalesce(F.element_at("segments", -1)["end"] - F.col("by"), F.lit(0.0)).alias("duration"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Stored transcripts; damaged lines are dropped, missing names are "unknown"."""
    rows = spark.read.schema(TRANSCRIPT + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path).filter("_corrupt is null").drop("_corrupt")
    return rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("language", "backend", "model")})


def load_transcript(spark: SparkSession, path: str) -> DataFrame:
    """Stored transcripts that must be there and whole: a missing file or a damaged line is an error."""
    return spark.read.schema(TRANSCRIPT).option("mode", "FAILFAST").json(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").json(path)


def cached(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted (cache_key, ...) among stored transcripts."""
    return wanted.join(stored, "cache_key"), wanted.join(stored.select("cache_key"), "cache_key", "left_anti")


def cache_key(file_hash: Column, backend: Column, model: Column, language: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", file_hash, backend, model, F.coalesce(language, F.lit("auto"))), 256), F.lit(16))


def uploads(spark: SparkSession, path: str, most_bytes: int, probes: DataFrame | None = None) -> DataFrame:
    """Files of a folder (path, length, extension), those accepted with their fingerprint, the others with a reject_reason:
    their kind or size, or, where probes (path, has_audio) are given, that they have no sound or couldn't be inspected.

    Lengths come from the listing, and of what is accepted two parts are read: a file may be of any length."""
    listed = files.listed(spark, path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~kind.isin(*EXTENSIONS), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > most_bytes, "file too large")
    if probes is not None:
        listed = listed.join(probes.select("path", F.col("has_audio").alias("_sound")), "path", "left")
        reason = F.coalesce(reason, F.when(F.col("_sound").isNull(), "could not be inspected").when(~F.col("_sound"), "no audio track"))
    judged = listed.select("path", "length", kind.alias("extension"), reason.alias("reject_reason"))
    prints = files.fingerprints(judged.filter("reject_reason is null").select("path", "length")).select("path", "fingerprint")
    return judged.join(prints, "path", "left")


def synthetic_transcripts(media: DataFrame, step_ms: int = 400, segment_ms: int = 5_000, fill: float = 0.8) -> DataFrame:
    """Words (transcript_id, seg_idx, word_idx, text, start_ms, end_ms, probability_pct) of made-up transcripts of media
    (transcript_id, media_ms): segments of equal length, in each a word a step, that fills most of it or ends with it."""
    last = lambda length, step: F.ceil(length / step).cast("long") - 1
    segs = media.filter("media_ms > 0").select("transcript_id", "media_ms", F.explode(F.sequence(F.lit(0).cast("long"), last(F.col("media_ms"), segment_ms))).alias("seg_idx"))
    begin = F.col("seg_idx") * segment_ms
    segs = segs.withColumn("stop", F.least(begin + segment_ms, F.col("media_ms")))
    each = segs.withColumn("word_idx", F.explode(F.sequence(F.lit(0).cast("long"), last(F.col("stop") - begin, step_ms))))
    start = begin + F.col("word_idx") * step_ms
    number = F.col("seg_idx") * -(-segment_ms // step_ms) + F.col("word_idx")
    return each.select("transcript_id", "seg_idx", "word_idx", F.concat(F.lit("word"), number.cast("string")).alias("text"), start.alias("start_ms"), F.least(start + int(step_ms * fill), F.col("stop")).alias("end_ms"), F.lit(90).cast("long").alias("probability_pct"))


def replace_by_project(old: DataFrame, new: DataFrame) -> DataFrame:
    """Clips after those of the projects in `new` have been replaced."""
    return old.join(new.select("project_id").distinct(), "project_id", "left_anti").unionByName(new)


def without_project(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows whose project isn't deleted."""
    return rows.join(deleted.select("project_id").distinct(), "project_id", "left_anti")


def sorted_clips(clips: DataFrame, by: str = "score") -> DataFrame:
    """Clips by index, duration, start, or score or boundary (best first, nulls last); any other name means index."""
    keys = {"duration": F.col("duration").asc(), "start": F.col("start_ms").asc(), "score": F.col("score").desc_nulls_last(), "boundary": F.col("boundary_score").desc_nulls_last()}
    return clips.orderBy(keys.get(by, F.col("index").asc()), F.col("index").asc(), "clip_id")


def latest_jobs(jobs: DataFrame, most: int = 50, project_id=None) -> DataFrame:
    """The newest jobs, of one project or of all."""
    kept = jobs if project_id is None else jobs.filter(F.col("project_id") == project_id)
    return kept.orderBy(F.desc("created_at"), "job_id").limit(most)


def list_projects(projects: DataFrame, clips: DataFrame | None = None, candidates: DataFrame | None = None, transcripts: DataFrame | None = None) -> DataFrame:
    """Projects, the newest first, with what there is of each: clip_count, candidate_count, has_extracted_audio,
    has_transcript (of stored transcripts, by project_id)."""
    shown = projects
    for name, rows in (("clip_count", clips), ("candidate_count", candidates)):
        if rows is not None:
            counts = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
            shown = shown.join(counts, "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if transcripts is not None:
        known = transcripts.select("project_id").distinct().withColumn("has_transcript", F.lit(True))
        shown = shown.join(known, "project_id", "left").withColumn("has_transcript", F.coalesce("has_transcript", F.lit(False)))
    if "audio_path" in projects.columns:
        shown = shown.withColumn("has_extracted_audio", F.coalesce(F.length("audio_path") > 0, F.lit(False)))
    return shown.orderBy(F.desc("created_at"), "project_id")


def shown_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs as an API shows them: progress in ten-thousandths, times in ISO 8601 with their zone."""
    iso = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return jobs.withColumns({c: iso(c) for c in ("created_at", "started_at", "completed_at") if c in jobs.columns} | {"progress": F.round("progress", 4)})


def clip_counts(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """Projects with clip_count."""
    counts = clips.groupBy("project_id").agg(F.count(F.lit(1)).alias("clip_count"))
    return projects.join(counts, "project_id", "left").withColumn("clip_count", F.coalesce("clip_count", F.lit(0)))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("index", F.row_number().over(Window.partitionBy("project_id").orderBy(*order)) - 1)
