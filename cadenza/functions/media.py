"""Media metadata as columns: probe JSON, frame rates, crop geometry, quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE_SCHEMA = """format struct<format_name:string,duration:string,size:string>,
streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,
sample_rate:string,channels:int,duration:string>>"""


def frame_rate(text: Column) -> Column:
    """"30000/1001" or "25" as a number; null for what isn't one above 0."""
    parts = F.split(text, "/")
    rate = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0))))
    return F.when(rate > 0, rate)


def probe(json: Column) -> Column:
    """A probe's JSON as a struct: the first video and audio stream, duration of the format or else of a stream."""
    p = F.from_json(json, PROBE_SCHEMA)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = first("video"), first("audio")
    length = F.coalesce(p["format"]["duration"], F.coalesce(video, audio)["duration"])
    width, height = video["width"], video["height"]
    return F.struct(
        F.coalesce(length.try_cast("double"), F.lit(0.0)).alias("duration"),
        p["format"]["format_name"].alias("container"),
        p["format"]["size"].try_cast("long").alias("size_bytes"),
        video.isNotNull().alias("has_video"),
        audio.isNotNull().alias("has_audio"),
        width.alias("width"),
        height.alias("height"),
        F.coalesce(frame_rate(video["avg_frame_rate"]), frame_rate(video["r_frame_rate"])).alias("fps"),
        video["codec_name"].alias("video_codec"),
        audio["codec_name"].alias("audio_codec"),
        audio["sample_rate"].try_cast("int").alias("sample_rate"),
        audio["channels"].alias("channels"),
        F.try_divide(width.cast("double"), height.cast("double")).alias("aspect_ratio"),
        F.coalesce(width > height, F.lit(False)).alias("is_landscape"),
        F.when(F.coalesce(F.size(p["streams"]), F.lit(0)) <= 0, F.lit("no streams")).alias("error"),
    )


def crop(width: Column, height: Column, out_width: int = 1080, out_height: int = 1920) -> Column:
    """The centred window of the target's shape: (w, h, x, y), whole pixels."""
    shape = out_width / out_height
    w = F.floor(F.least(width.cast("double"), height * F.lit(shape))).cast("long")
    h = F.floor(F.least(height.cast("double"), width / F.lit(shape))).cast("long")
    return F.struct(w.alias("w"), h.alias("h"), F.floor((width - w) / 2).cast("long").alias("x"), F.floor((height - h) / 2).cast("long").alias("y"))


def fit(width: Column, height: Column, out_width: int = 1080, out_height: int = 1920) -> Column:
    """The whole picture within the target, centred on a fill of it: (w, h, x, y) in the target, whole pixels."""
    scale = F.least(F.lit(float(out_width)) / width, F.lit(float(out_height)) / height)
    w, h = (F.floor(side * scale + 1e-9).cast("long") for side in (width, height))
    return F.struct(w.alias("w"), h.alias("h"), F.floor((F.lit(out_width) - w) / 2).cast("long").alias("x"), F.floor((F.lit(out_height) - h) / 2).cast("long").alias("y"))


def reframe(strategy: str, width: Column, height: Column, out_width: int = 1080, out_height: int = 1920) -> Column:
    """crop() for "center", fit() for "fit"."""
    kinds = {"center": crop, "fit": fit}
    if strategy not in kinds:
        raise ValueError(f"unknown strategy {strategy!r}: {' or '.join(kinds)}")
    return kinds[strategy](width, height, out_width, out_height)


def quality_issues(expected: Column, found: Column, width: Column, height: Column, has_video: Column, has_audio: Column, out_width: int = 1080, out_height: int = 1920) -> Column:
    """What is wrong with a rendered clip, as a list."""
    return F.array_compact(
        F.array(
            F.when(~has_video, F.lit("no video stream")),
            F.when(~has_audio, F.lit("no audio stream")),
            F.when(F.abs(found - expected) > 1.0, F.lit("duration differs")),
            F.when((width != out_width) | (height != out_height), F.lit("wrong dimensions")),
        )
    )


def quality_check(renders: DataFrame) -> DataFrame:
    """renders (clip_id, expected, duration, width, height, has_video, has_audio) with qc_issues and qc_ok."""
    issues = quality_issues(*(F.col(c) for c in ("expected", "duration", "width", "height", "has_video", "has_audio")))
    return renders.withColumn("qc_issues", issues).withColumn("qc_ok", F.size("qc_issues") == 0)
