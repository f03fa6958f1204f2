"""Clip selection: even anchors, anchors joined by fallbacks, the greedy pick of disjoint windows, padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import staged
from . import greedy
from .boundaries import boundary_notes, components_map, pad_into_silence, solve

EDGE = 0.05


def even_anchors(media: DataFrame, count: int, edge: float = EDGE) -> DataFrame:
    """(transcript_id, n, anchor_ms): `count` even points between margins of `edge` at both ends."""
    margin = F.col("media_ms") * edge
    span = F.greatest(margin, F.col("media_ms") - margin) - margin
    each = media.filter("media_ms > 0").select("transcript_id", "media_ms", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("n")) if count > 0 else media.limit(0).withColumn("n", F.lit(0))
    at = F.when(span <= 0, F.lit(0.0)).when(F.lit(count == 1), margin + span / 2).otherwise(margin + span / max(1, count) * F.col("n"))
    return each.select("transcript_id", F.col("n").cast("long").alias("n"), F.round(at, 6).alias("anchor_ms")).filter((F.col("n") == 0) | (F.col("anchor_ms") > 0))


def all_anchors(discovered: DataFrame, media: DataFrame, count: int, min_ms: int) -> DataFrame:
    """Discovered anchors (transcript_id, ord, anchor_ms) in order; where a transcript has fewer than `count`, also the
    even ones that lie more than min_ms from each of them. strategy tells them apart."""
    order = Window.partitionBy("transcript_id").orderBy("ord")
    found = discovered.select("transcript_id", F.row_number().over(order).cast("long").alias("ord"), F.col("anchor_ms").cast("double").alias("anchor_ms"), F.lit("discovered").alias("strategy"))
    held = found.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("held"))
    even = even_anchors(media, count * 3).join(held, "transcript_id", "left").filter(F.coalesce("held", F.lit(0)) < count)
    d = found.select(F.col("transcript_id").alias("t"), F.col("anchor_ms").alias("d"))
    even = even.join(d, (F.col("transcript_id") == F.col("t")) & (F.abs(F.col("anchor_ms") - F.col("d")) <= min_ms), "left_anti")
    return found.unionByName(even.select("transcript_id", (F.lit(1 << 40) + F.col("n")).alias("ord"), "anchor_ms", F.lit("even").alias("strategy")))


def overlaps(windows: DataFrame, cell_ms: int = 60_000) -> DataFrame:
    """(group, better, worse) of windows (transcript_id, rank, start_ms, end_ms) of which two overlap. Each lies in the
    cells of time that it covers; two meet in the cell of the later start."""
    w = windows.filter("end_ms > start_ms").select("transcript_id", "rank", "start_ms", "end_ms")
    cell = lambda c: F.floor(F.col(c) / cell_ms)
    dealt = w.withColumn("cell", F.explode(F.sequence(cell("start_ms"), cell("end_ms"))))
    a = dealt.select("transcript_id", "cell", *[F.col(c).alias(f"a_{c}") for c in ("rank", "start_ms", "end_ms")])
    met = a.join(dealt, ["transcript_id", "cell"]).filter((F.col("a_rank") < F.col("rank")) & (F.col("cell") == F.floor(F.greatest("a_start_ms", "start_ms") / cell_ms)))
    both = met.filter((F.col("a_start_ms") < F.col("end_ms")) & (F.col("start_ms") < F.col("a_end_ms")))
    return both.select(F.col("transcript_id").alias("group"), F.col("a_rank").alias("better"), F.col("rank").alias("worse"))


def disjoint(solved: DataFrame, count: int) -> DataFrame:
    """Of each transcript the first `count` windows by ord that overlap none of those before them that are kept.

    Many anchors end in one window: only the first of equal ones can be kept."""
    own = F.when(F.col("end_ms") <= F.col("start_ms"), F.col("ord"))
    firsts = solved.groupBy("transcript_id", "start_idx", "end_idx", own.alias("own")).agg(F.min("ord").alias("ord")).drop("own", "start_idx", "end_idx")
    ranked = staged(greedy.ranked(solved.join(firsts, ["transcript_id", "ord"], "left_semi"), "transcript_id", F.col("ord")), "windows")
    kept = greedy.survivors(ranked, "transcript_id", overlaps(ranked))
    place = F.row_number().over(Window.partitionBy("transcript_id").orderBy("rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= count).drop("rank", "place")


#: What a clip takes over from the moment whose anchor it was found at.
DISCOVERY = ("hook", "topic", "category", "score")


def with_discovery(clips: DataFrame, discovered: DataFrame) -> DataFrame:
    """clips (transcript_id, anchor_ms, ...) with what is known of the moments at their anchors; of two at one time the
    last counts."""
    columns = [F.col(c) if c in discovered.columns else F.lit(None).cast("double" if c == "score" else "string").alias(c) for c in DISCOVERY]
    if not set(DISCOVERY) & set(discovered.columns):
        return clips.select(*clips.columns, *columns)
    known = discovered.select("transcript_id", "ord", F.col("anchor_ms").cast("double").alias("anchor_ms"), F.struct(*columns).alias("d")).groupBy("transcript_id", "anchor_ms").agg(F.max_by("d", "ord").alias("d"))
    return clips.join(known, ["transcript_id", "anchor_ms"], "left").select(*clips.columns, *[F.col(f"d.{c}").alias(c) for c in DISCOVERY])


def window_texts(clips: DataFrame, features: DataFrame) -> DataFrame:
    """clips (transcript_id, ord, start_idx, end_idx, ...) with `text`: what their segments say, one space between."""
    each = clips.select("transcript_id", "ord", F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).join(features.select("transcript_id", "idx", F.col("text").alias("said")), ["transcript_id", "idx"])
    said = each.groupBy("transcript_id", "ord").agg(F.array_sort(F.collect_list(F.struct("idx", "said"))).alias("s"))  # a clip's segments
    return clips.join(said.select("transcript_id", "ord", F.array_join(F.col("s.said"), " ").alias("text")), ["transcript_id", "ord"])


def select_clips(
    features: DataFrame, words: DataFrame, media: DataFrame, discovered: DataFrame, count: int = 5, min_ms: int = 25_000, max_ms: int = 60_000, padding_ms: int = 350, least_score: float = 0.0, whole: bool = False
) -> DataFrame:
    """At most `count` disjoint clips of each transcript: anchors in order are solved, what falls below least_score or
    overlaps an earlier pick is passed over; then each clip is padded into silence within max_ms. A clip has its text,
    the notes and components of its boundaries, and what is known of the moment it was found at.

    The first 2 * count anchors are solved at once, further ones only where these don't make `count` clips; if whole, all
    anchors are solved at once, by all pairs in their reach."""
    anchors = staged(all_anchors(discovered, media, count, min_ms).withColumn("place", F.row_number().over(Window.partitionBy("transcript_id").orderBy("ord"))), "anchors")

    def solved(some: DataFrame) -> DataFrame:
        found = solve(features, some.select("transcript_id", "ord", "anchor_ms"), min_ms, max_ms, whole=whole).filter(F.col("total") >= least_score)
        return staged(found.join(some.select("transcript_id", "ord", "strategy"), ["transcript_id", "ord"]), "solved")

    first = solved(anchors if whole else anchors.filter(F.col("place") <= 2 * count))
    picked = disjoint(first, count)
    more = anchors.groupBy("transcript_id").agg(F.max("place").alias("n")).filter(F.col("n") > 2 * count)
    if not whole and not more.isEmpty():
        picked = staged(picked, "picked")
        more = more.join(picked.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("picked")), "transcript_id", "left")
        lacking = staged(more.filter(F.coalesce("picked", F.lit(0)) < count).select("transcript_id"), "lacking")
        if not lacking.isEmpty():
            rest = solved(anchors.filter(F.col("place") > 2 * count).join(lacking, "transcript_id", "left_semi"))
            again = disjoint(first.join(lacking, "transcript_id", "left_semi").unionByName(rest), count)
            picked = picked.join(lacking, "transcript_id", "left_anti").unionByName(again)
    headroom = F.lit(max_ms) - (F.col("end_ms") - F.col("start_ms"))
    picked = window_texts(components_map(boundary_notes(with_discovery(picked, discovered), features)), features)
    picked = staged(picked.withColumn("allowance", F.least(F.lit(float(padding_ms)), headroom / 2)), "clips")
    padded = pad_into_silence(picked, words, media, F.col("allowance"))
    grown = F.col("allowance") > 0
    order = Window.partitionBy("transcript_id").orderBy("start_ms", "ord")
    return padded.select(
        "transcript_id",
        (F.row_number().over(order) - 1).cast("long").alias("clip"),
        "strategy",
        "start_idx",
        "end_idx",
        F.when(grown, F.col("padded_start_ms")).otherwise(F.col("start_ms").cast("double")).alias("start_ms"),
        F.when(grown, F.col("padded_end_ms")).otherwise(F.col("end_ms").cast("double")).alias("end_ms"),
        F.col("total").alias("boundary_score"),
        F.left("text", F.lit(5_000)).alias("text"),
        F.array_join("notes", "; ").alias("boundary_notes"),
        "components",
        *DISCOVERY,
    )
