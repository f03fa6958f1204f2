"""Candidate moments: parsing, snapping to words, score normalisation, removal of overlaps, rejection reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.json_recovery import model_items
from ..functions.text import estimate_tokens, stripped
from ..plans.stages import staged
from . import greedy

SNAP_MS, SNAP_STRETCH_MS = 6_000, 60_000
LEAST_ANCHOR_MS = 2_000
SMALL_GROUP = 3


def snap(spans: DataFrame, words: DataFrame, tolerance_ms: int = SNAP_MS) -> DataFrame:
    """spans (transcript_id, ord, start_ms, end_ms) with snapped_start_ms and snapped_end_ms: the nearest word start and
    word end, the first on ties; null where one is farther than the tolerance or the end isn't after the start.

    A stretch of SNAP_STRETCH_MS has its words as one list, and a time takes the nearest one of the lists that it reaches:
    its own stretch and, near an edge, the next one."""
    stretch = max(SNAP_STRETCH_MS, 2 * tolerance_ms)
    at = lambda side, time: F.struct(F.lit(side).alias("side"), F.col(time).cast("double").alias("at"))

    def lists(side: int, time: str) -> DataFrame:
        word = F.struct(F.col(time).alias("time"), "seg_idx", "word_idx")
        dealt = words.filter(F.col(time).isNotNull()).select("transcript_id", F.lit(side).alias("side"), F.floor(F.col(time).cast("double") / stretch).alias("stretch"), word.alias("word"))
        return dealt.groupBy("transcript_id", "side", "stretch").agg(F.collect_list("word").alias("said"))

    asked = spans.select("transcript_id", "ord", F.inline(F.array(at(0, "start_ms"), at(1, "end_ms")))).filter("at is not null")
    asked = asked.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("at") - tolerance_ms) / stretch), F.floor((F.col("at") + tolerance_ms) / stretch))))
    every = lists(0, "start_ms").unionByName(lists(1, "end_ms")).unionByName(asked, allowMissingColumns=True)
    said = F.first("said", True).over(Window.partitionBy("transcript_id", "side", "stretch"))
    met = every.withColumn("said", said).filter("at is not null")
    near = F.filter("said", lambda w: F.abs(w["time"] - F.col("at")) <= tolerance_ms)
    best = F.array_min(F.transform(near, lambda w: F.struct(F.abs(w["time"] - F.col("at")).alias("d"), w["seg_idx"].alias("s"), w["word_idx"].alias("w"), w["time"].alias("time"))))
    met = met.select("transcript_id", "ord", "side", best.alias("best"))
    found = met.groupBy("transcript_id", "ord").agg(*[F.min(F.when(F.col("side") == side, F.col("best")))["time"].alias(f"near_{name}") for side, name in ((0, "start"), (1, "end"))])
    both = spans.join(found, ["transcript_id", "ord"], "left")
    good = F.col("near_end") > F.col("near_start")
    return both.withColumn("snapped_start_ms", F.when(good, F.col("near_start"))).withColumn("snapped_end_ms", F.when(good, F.col("near_end"))).drop("near_start", "near_end")


def parse(responses: DataFrame, words: DataFrame, min_ms: int = 25_000, max_ms: int = 60_000) -> DataFrame:
    """Candidates and rejections (reject_reason) of model answers (transcript_id, window_idx, text), which may be of several
    attempts.

    One row for each item, or for an answer that holds none."""
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(0).alias("attempt")
    read = responses.select("transcript_id", "window_idx", attempt, model_items(F.col("text")).alias("m"))
    items = read.select("transcript_id", "window_idx", "attempt", F.col("m.error").alias("error"), F.explode_outer("m.items").alias("item")).filter(F.col("error").isNotNull() | F.col("item").isNotNull())
    items = items.select("transcript_id", "window_idx", "attempt", "error", "item.*")
    low, high = F.least("start", "end"), F.greatest("start", "end")
    timed = items.withColumn("ord", F.struct("window_idx", "attempt", "n")).withColumn("start_ms", F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.round(low * 1000).cast("long")))
    timed = timed.withColumn("end_ms", F.when(F.col("start_ms").isNotNull(), F.round(high * 1000).cast("long")))
    spans = timed.filter("start_ms is not null").select("transcript_id", "ord", "start_ms", "end_ms")
    snapped = timed.join(snap(spans, words).drop("start_ms", "end_ms"), ["transcript_id", "ord"], "left")
    length = F.col("snapped_end_ms") - F.col("snapped_start_ms")
    # The texts of reasons and issues are part of the result.
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~F.col("is_object"), F.concat(F.lit("not an object: "), F.left("shown", F.lit(60))))
        .when(F.col("start_ms").isNull(), F.concat(F.lit("missing start/end: "), F.col("shown")))
        .when(F.col("snapped_start_ms").isNull(), F.format_string("timestamps %.1f-%.1f do not match the transcript", F.col("start_ms") / 1000, F.col("end_ms") / 1000))
        .when(length < LEAST_ANCHOR_MS, F.format_string("degenerate span (%.1fs) at %.1f", length / 1000, F.col("snapped_start_ms") / 1000))
    )
    category = F.lower(stripped(F.col("category")))
    known = category.isin(lexicon.CATEGORIES)
    issues = F.array_compact(
        F.array(
            F.when(length < min_ms, F.format_string("model proposed %.1fs, below the minimum - the solver will expand it", length / 1000)),
            F.when(length > max_ms, F.format_string("model proposed %.1fs, above the maximum - the solver will trim it", length / 1000)),
            F.when(~known, F.concat(F.lit("unknown category '"), category, F.lit("'"))),
            F.when(F.col("score").isNull(), F.lit("no score returned")),
            F.when(F.col("hook") == "", F.lit("no hook returned")),
        )
    )
    return snapped.select(
        "transcript_id",
        F.col("window_idx").alias("chunk_index"),
        "attempt",
        F.coalesce("n", F.lit(0)).alias("item"),
        F.col("snapped_start_ms").alias("start_ms"),
        F.col("snapped_end_ms").alias("end_ms"),
        "hook",
        "topic",
        F.when(known, category).otherwise("insight").alias("category"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce("score", F.lit(50.0)))).alias("raw_score"),
        "reason",
        F.when(reason.isNull(), issues).alias("issues"),
        reason.alias("reject_reason"),
    )


def normalise(candidates: DataFrame) -> DataFrame:
    """normalized_score and confidence: within a chunk of SMALL_GROUP or more by z-score, else over all small chunks of
    the transcript by range."""
    chunk = Window.partitionBy("transcript_id", "chunk_index")
    whole = Window.partitionBy("transcript_id")
    c = candidates.withColumn("n", F.count(F.lit(1)).over(chunk)).withColumn("mean", F.avg("raw_score").over(chunk)).withColumn("sd", F.stddev_pop("raw_score").over(chunk))
    small = F.when(F.col("n") < SMALL_GROUP, F.col("raw_score"))
    c = c.withColumn("lo", F.min(small).over(whole)).withColumn("hi", F.max(small).over(whole))
    z = F.when(F.col("sd") < 1e-6, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (F.col("raw_score") - F.col("mean")) / F.col("sd") / 4)))
    spread = F.col("hi") - F.col("lo")
    pooled = F.when(spread < 1e-6, F.lit(0.5)).otherwise(0.15 + 0.7 * (F.col("raw_score") - F.col("lo")) / spread)
    big = F.col("n") >= SMALL_GROUP
    confidence = F.when(big & (F.col("sd") < 1e-6), F.lit(0.3)).when(big, F.least(F.lit(1.0), 0.6 + F.col("n") / 20.0)).otherwise(0.4)
    return c.select(*[c[x] for x in candidates.columns], F.round(F.when(big, z).otherwise(pooled), 4).alias("normalized_score"), F.round(confidence, 3).alias("confidence"))


def overlap_conflicts(spans: DataFrame, threshold: float) -> DataFrame:
    """(group, better, worse) of spans (transcript_id, rank, start_ms, end_ms) of which two overlap by the threshold or
    more of the range that both cover.

    Such spans differ in length by 1 / threshold at most, and start near each other, measured by their lengths: they meet
    in one class of lengths, in the same bucket of starts or the next."""
    base = 1.001 / threshold
    size = F.col("end_ms") - F.col("start_ms")
    s = spans.filter(size > 0).select("transcript_id", F.col("rank").cast("long").alias("rank"), "start_ms", "end_ms", F.floor(F.log(size.cast("double")) / F.log(F.lit(base))).cast("int").alias("class"))
    width = lambda c: F.ceil(F.pow(F.lit(base), c + 1) * max(1.0, (1 - threshold) / threshold)) + 1
    dealt = s.withColumn("at", F.explode(F.array(F.col("class"), F.col("class") + 1))).withColumn("bucket", F.floor(F.col("start_ms") / width(F.col("at"))))
    a = dealt.select(*[F.col(c).alias(f"a_{c}") for c in ("rank", "start_ms", "end_ms", "class")], "transcript_id", "at", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    met = a.join(dealt, ["transcript_id", "at", "bucket"]).filter((F.col("a_rank") < F.col("rank")) & (F.col("at") == F.greatest("a_class", "class")))
    shared = F.least("a_end_ms", "end_ms") - F.greatest("a_start_ms", "start_ms")
    whole = F.greatest("a_end_ms", "end_ms") - F.least("a_start_ms", "start_ms")
    return met.filter((shared > 0) & (shared >= threshold * whole)).select(F.col("transcript_id").alias("group"), F.col("a_rank").alias("better"), F.col("rank").alias("worse"))


def drop_overlaps(candidates: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """Candidates without those that overlap a better one that was kept (best score first, then ord); as
    (transcript_id, ord, start_ms, end_ms, normalized_score). threshold is above 0.

    Of equal spans only the best can stay, as whatever it overlaps the others overlap too."""
    spans = candidates.select("transcript_id", "ord", "start_ms", "end_ms", "normalized_score")
    best = F.min(F.struct((-F.col("normalized_score")).alias("key"), "ord")).alias("b")
    some = spans.filter("end_ms > start_ms").groupBy("transcript_id", "start_ms", "end_ms").agg(best)
    some = some.select("transcript_id", "start_ms", "end_ms", "b.ord", (-F.col("b.key")).alias("normalized_score"))
    every = some.unionByName(spans.filter("not coalesce(end_ms > start_ms, false)"))
    ranked = staged(greedy.ranked(every, "transcript_id", F.desc("normalized_score"), F.col("ord")), "ranked")
    kept = greedy.survivors(ranked, "transcript_id", overlap_conflicts(ranked, threshold), **how)
    return kept.select("transcript_id", "ord", "start_ms", "end_ms", "normalized_score")


def rejection_kind(reason: Column) -> Column:
    out = F.lit("other")
    for needle, label in reversed(lexicon.REJECTION_KINDS):
        out = F.when(F.contains(reason, F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def rejection_summary(rejections: DataFrame) -> DataFrame:
    """rejections (transcript_id, ord, reject_reason): per transcript and kind its count, rank (most first, then first
    seen) and first reason."""
    kinds = rejections.withColumn("kind", rejection_kind(F.col("reject_reason")))
    counted = kinds.groupBy("transcript_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "reject_reason")).alias("first"))
    order = Window.partitionBy("transcript_id").orderBy(F.desc("n"), "first.ord")
    return counted.select("transcript_id", "kind", "n", F.row_number().over(order).cast("long").alias("rank"), F.col("first.reject_reason").alias("example"))


def budget_issue(prompt: Column, max_out: int = 768, num_ctx: int = 8192) -> Column:
    """Null, or by how much a prompt and its answer pass nine tenths of the context."""
    need = estimate_tokens(prompt) + max_out
    return F.when(need > 0.9 * num_ctx, F.format_string("needs %d tokens of %d", need, F.lit(num_ctx)))


def best_first(candidates: DataFrame) -> DataFrame:
    """Candidates by final score, else normalised score, else 0; ord decides ties."""
    return candidates.orderBy(F.coalesce("final_score", "normalized_score", F.lit(0.0)).desc(), "ord")
