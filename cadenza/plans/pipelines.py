"""The three flows as plans: chunk transcripts to one transcript, model answers to ranked moments, moments to clips.

Model and encoder outputs enter as tables. Steps that several later ones read are staged as tables, as a flow's stages
also are where each is a run of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import estimate_tokens
from ..operators import boundaries, candidates, captions, ranking, selection, transcript, windows
from .stages import staged


@dataclass(frozen=True)
class Settings:
    """Lengths, limits and weights of the flows."""

    clips: int = 5
    min_ms: int = 25_000
    max_ms: int = 60_000
    padding_ms: int = 350
    least_score: float = 0.0
    chunk_ms: int = 300_000
    overlap_ms: int = 2_000
    window_tokens: int = 1_800
    context_tokens: int = 8_192
    answer_tokens: int = 768
    iou: float = 0.5
    similar: float = ranking.SIMILAR
    shortlist: int = ranking.SHORTLIST
    boundary_weights: dict = field(default_factory=lambda: dict(lexicon.BOUNDARY_WEIGHTS))
    scoring_weights: dict = field(default_factory=lambda: dict(lexicon.SCORING_WEIGHTS))


def transcribe(media: DataFrame, heard: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Words of whole transcripts from those that each chunk's recogniser heard (transcript_id, chunk, ...)."""
    return transcript.merge_chunks(transcript.plan_chunks(media, settings.chunk_ms, settings.overlap_ms), heard)


def prompts(segments: DataFrame, settings: Settings = Settings(), ask: str = "Find the best moments of {min} to {max} seconds. Categories: {categories}.") -> DataFrame:
    """(transcript_id, window, prompt, budget_issue): what a model is asked for each window."""
    text = windows.window_text(windows.token_windows(segments, settings.window_tokens), segments)
    head = ask.format(min=settings.min_ms // 1000, max=settings.max_ms // 1000, categories=", ".join(sorted(lexicon.CATEGORIES)))
    prompt = F.concat(F.lit(head + "\n\n"), F.col("text"))
    return text.select("transcript_id", "window", prompt.alias("prompt"), candidates.budget_issue(prompt, settings.answer_tokens, settings.context_tokens).alias("budget_issue"))


def rerank_prompts(shortlisted: DataFrame, words: DataFrame, ask: str = "Rank these {count} moments, the best first.") -> DataFrame:
    """(transcript_id, prompt): what a model is asked about a shortlist (transcript_id, place, start_ms, end_ms, hook,
    topic, category): an entry for each candidate, with the start of what is said."""
    spans = shortlisted.select("transcript_id", F.col("place").alias("span_id"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    said = transcript.excerpt(words, spans).withColumnRenamed("span_id", "place")
    shown = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.col(c)).otherwise("(none)")
    entry = F.format_string("[%d] hook: %s\n     topic: %s | category: %s\n     says: %s", F.col("place"), shown("hook"), shown("topic"), F.col("category"), F.coalesce("excerpt", F.lit("")))
    entries = shortlisted.join(said, ["transcript_id", "place"], "left").select("transcript_id", F.struct("place", entry.alias("entry")).alias("e"))
    listed = entries.groupBy("transcript_id").agg(F.array_sort(F.collect_list("e")).alias("e"))  # a shortlist is short
    head, tail = ask.split("{count}")
    return listed.select("transcript_id", F.concat(F.lit(head), F.size("e").cast("string"), F.lit(tail + "\n\n"), F.array_join(F.col("e.entry"), "\n\n")).alias("prompt"))


def previews(issues: DataFrame, most: int = 20) -> DataFrame:
    """Of each transcript the first `most` issues or rejections by ord, as a result shows them."""
    order = Window.partitionBy("transcript_id").orderBy("ord")
    return issues.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def discover(segments: DataFrame, words: DataFrame, answers: DataFrame, rankings: DataFrame | None = None, settings: Settings = Settings(), features: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(moments, rejections): parsed answers (transcript_id, window_idx, text), scored within their window, without
    overlaps, with a boundary hint, ranked, without near repetitions, by final score.

    rankings (transcript_id, text) are ids of the shortlist in its order; without one, ranks don't tell candidates apart.
    features: boundaries.segment_features(segments, words), where a flow has them already; stage them."""
    words = staged(words, "words")
    parsed = staged(candidates.parse(staged(answers, "answers"), words, settings.min_ms, settings.max_ms), "parsed")
    rejections = parsed.filter("reject_reason is not null").select("transcript_id", "chunk_index", "item", "reject_reason")
    good = parsed.filter("reject_reason is null").drop("reject_reason").withColumn("ord", F.col("chunk_index") * 100_000 + F.col("item"))
    scored = staged(candidates.normalise(good), "scored")
    kept = candidates.drop_overlaps(scored, settings.iou).select("transcript_id", "ord")
    c = scored.join(kept, ["transcript_id", "ord"])

    c = staged(c, "kept")
    features = staged(boundaries.segment_features(segments, words), "features") if features is None else features
    hints = boundaries.solve(features, c.select("transcript_id", "ord", F.col("start_ms").alias("anchor_ms")), settings.min_ms, settings.max_ms)
    c = c.join(hints.select("transcript_id", "ord", F.col("total").alias("boundary_hint")), ["transcript_id", "ord"], "left").withColumn("boundary_hint", F.coalesce("boundary_hint", F.lit(0.0)))
    c = staged(c, "hinted")

    place = Window.partitionBy("transcript_id").orderBy(F.desc("normalized_score"), "ord")
    c = c.withColumn("place", (F.row_number().over(place) - 1).cast("long"))
    if rankings is not None:
        sizes = c.groupBy("transcript_id").agg(F.least(F.lit(settings.shortlist), F.count(F.lit(1))).cast("int").alias("candidate_count"))
        ranks = ranking.rank_scores(ranking.parse_rankings(rankings.join(sizes, "transcript_id")), F.col("rank"), F.col("n"))
        c = c.join(ranks.select("transcript_id", F.col("id").alias("place"), "rerank_score"), ["transcript_id", "place"], "left")
    c = c.withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.5)) if rankings is not None else F.lit(0.5))

    c = staged(c, "ranked")
    texts = c.withColumn("text", F.concat_ws(" ", "hook", "topic", "reason"))
    c = c.join(ranking.drop_similar(texts, settings.similar), ["transcript_id", "ord"])
    return staged(ranking.final_scores(c, settings.min_ms, settings.max_ms, settings.scoring_weights), "moments"), rejections


def generate_clips(segments: DataFrame, words: DataFrame, media: DataFrame, moments: DataFrame, settings: Settings = Settings(), features: DataFrame | None = None) -> DataFrame:
    """Clips of the best 2 * clips moments of each transcript (transcript_id, ord, start_ms, final_score). features as for
    discover()."""
    best = Window.partitionBy("transcript_id").orderBy(F.desc("final_score"), "ord")
    anchors = moments.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= 2 * settings.clips)
    # Stored moments carry their start in hundredths of a second.
    known = [F.col(c) for c in ("hook", "topic", "category") if c in moments.columns]
    anchors = anchors.select("transcript_id", F.col("n").alias("ord"), (F.round(F.col("start_ms") / 1000, 2) * 1000).alias("anchor_ms"), *known, F.col("final_score").alias("score"))
    words = staged(words, "words")
    features = staged(boundaries.segment_features(segments, words), "features") if features is None else features
    return selection.select_clips(features, words, media, staged(anchors, "anchors"), settings.clips, settings.min_ms, settings.max_ms, settings.padding_ms, settings.least_score)


def clip_captions(clips: DataFrame, words: DataFrame, style: captions.Style = captions.Style()) -> DataFrame:
    """(clip_id, w, start_ms, end_ms, dialogue) of clips (transcript_id, clip, start_ms, end_ms), times from each clip's start."""
    c = clips.select("transcript_id", F.concat_ws("-", "transcript_id", "clip").alias("clip_id"), F.col("start_ms").alias("from_ms"), F.col("end_ms").alias("to_ms"))
    inside = transcript.in_spans(words, F.col("start_ms"), c, "from_ms", "to_ms").filter(F.col("end_ms") <= F.col("to_ms"))
    order = Window.partitionBy("clip_id").orderBy("seg_idx", "word_idx")
    shift = lambda name: F.round(F.col(name) - F.col("from_ms")).cast("long").alias(name)
    w = inside.select("clip_id", (F.row_number().over(order) - 1).cast("long").alias("w"), "text", shift("start_ms"), shift("end_ms"))
    lines = captions.caption_lines(w, style)
    events = captions.caption_events(lines, 0, style)
    return events.join(captions.dialogue(events, lines, style), ["clip_id", "w"]).select("clip_id", "w", "start_ms", "end_ms", "dialogue")


def throughput(runs: DataFrame) -> DataFrame:
    """Per project: seconds of media and of work, and how much faster than real time it went."""
    sums = runs.groupBy("project_id").agg(F.sum("duration").alias("media_s"), F.sum("elapsed").alias("work_s"))
    return sums.withColumn("realtime_factor", F.try_divide("media_s", "work_s"))


def failed_checks(checked: DataFrame) -> DataFrame:
    """Per project the indexes of clips that failed their quality check, in order."""
    return checked.filter(~F.col("qc_ok")).groupBy("project_id").agg(F.sort_array(F.collect_list("index")).alias("failed"))


def shown_clip(clips: DataFrame) -> DataFrame:
    """Clips as an API shows them: seconds in hundredths, whether a file exists."""
    at = lambda name: F.round(F.col(f"{name}_ms") / 1000, 2).alias(name)
    return clips.select("*", at("start"), at("end"), F.round((F.col("end_ms") - F.col("start_ms")) / 1000, 2).alias("duration"), (F.length(F.coalesce("render_path", F.lit(""))) > 0).alias("rendered"))


def shown_time(ts: Column) -> Column:
    """A timestamp in ISO 8601 with its zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def new_id(*key: Column) -> Column:
    """Twelve hex digits, fixed by a key, or random without one."""
    return F.left(F.sha2(F.concat_ws("|", *key), 256) if key else F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12))


def prompt_tokens(df: DataFrame) -> DataFrame:
    """The widest prompt of each transcript, by tokens."""
    return df.groupBy("transcript_id").agg(F.max_by("window", F.struct(F.length("prompt"), -F.col("window"))).alias("window"), F.max(estimate_tokens(F.col("prompt"))).alias("tokens"))
