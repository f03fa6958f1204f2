"""Where a clip starts and ends: boundary components of segment pairs, the solver around anchors, silence padding.

Every pair (start segment, end segment) of legal length is scored once per transcript, from prefix sums over its words;
anchors then pick among the pairs. Segment pairs meet in time buckets, so a long transcript is no single cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import clean, ends_sentence, stripped
from ..plans.stages import staged

SEARCH_BACK_MS, SEARCH_FORWARD_MS, MOST_PAIRS = 15_000, 25_000, 400
FORGIVING_PAUSE_MS = 600
NO_GAP_MS = 999_000
PAD_STRETCH_MS = 30_000
COMPONENTS = list(lexicon.BOUNDARY_WEIGHTS)


def opener_class(first: Column, second: Column, third: Column) -> Column:
    """'strong', 'forgivable' or 'unforgivable' for cleaned opening words; phrases of three words come before two."""
    three, two = F.concat_ws(" ", first, second, third), F.concat_ws(" ", first, second)
    phrase = F.when(third.isNotNull() & three.isin(lexicon.WEAK_OPENING_PHRASES), True).when(second.isNotNull() & two.isin(lexicon.WEAK_OPENING_PHRASES), True)
    marker = first.isin(lexicon.DISCOURSE_MARKERS)
    return (
        F.when(phrase, F.when(marker, "forgivable").otherwise("unforgivable"))
        .when(first.isin(lexicon.SUBORDINATORS), "unforgivable")
        .when(marker, "forgivable")
        .otherwise("strong")
    )


def opener_text(first: Column, second: Column, third: Column) -> Column:
    """The words that opener_class() goes by."""
    three, two = F.concat_ws(" ", first, second, third), F.concat_ws(" ", first, second)
    return F.when(third.isNotNull() & three.isin(lexicon.WEAK_OPENING_PHRASES), three).when(second.isNotNull() & two.isin(lexicon.WEAK_OPENING_PHRASES), two).otherwise(first)


def with_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments with `said`, the list of their words in order; words of unknown segments have a row too, without text."""
    word = F.struct("word_idx", "text", "start_ms", "end_ms")
    lists = words.groupBy("transcript_id", "seg_idx").agg(F.sort_array(F.collect_list(word)).alias("said"))  # a segment's words
    known = segments.select("transcript_id", "seg_idx", "start_ms", "end_ms", "text", F.lit(True).alias("known"))
    return lists.join(known, ["transcript_id", "seg_idx"], "left")


def segment_features(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Per segment with words, numbered anew as idx: its bounds, its words' bounds, opener class, sentence ends, and
    prefix sums of words, fillers and filler phrases. Where segments have their words as `said` (with_words()), words are
    not read.

    A segment is one row: its words are counted within it, and only its first ones meet the segment before."""
    s = segments.withColumn("known", F.lit(True)) if "said" in segments.columns else with_words(segments, words)
    s = s.filter(F.size("said") > 0).withColumn("c", F.transform("said", lambda w: clean(w["text"]))).withColumn("n", F.size("c").cast("long"))

    def filler(a: Column, b: Column) -> Column:
        return F.coalesce(F.concat_ws(" ", a, b).isin(lexicon.FILLER_PHRASES) & b.isNotNull(), F.lit(False))

    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), filler)
    s = s.select(
        "transcript_id", "seg_idx", "known", "start_ms", "end_ms", "text", "n",
        F.get("said", F.lit(0))["start_ms"].alias("first_ms"),
        F.element_at("said", -1)["end_ms"].alias("last_ms"),
        *[F.get("c", F.lit(i)).alias(f"c{i + 1}") for i in range(3)],
        F.element_at("c", -1).alias("tail_c"),
        F.when(F.exists("c", lambda c: c.isNotNull()), F.size(F.filter("c", lambda c: c.isin(lexicon.FILLER_WORDS))).cast("long")).alias("singles"),
        F.size(F.filter(pairs, lambda x: x)).cast("long").alias("inner"),
    )
    order = Window.partitionBy("transcript_id").orderBy("seg_idx")
    s = s.withColumn("after", F.lead(F.struct("c1", "c2", "n"), 1).over(order)).withColumn("then", F.lead("c1", 2).over(order)).filter("known")
    second = F.when(F.col("n") > 1, F.col("c2")).otherwise(F.col("after.c1"))
    third = F.when(F.col("n") > 2, F.col("c3")).when(F.col("n") == 2, F.col("after.c1")).when(F.col("after.n") > 1, F.col("after.c2")).otherwise(F.col("then"))
    s = s.withColumn("second", second).withColumn("third", third).withColumn("tail_phrase", filler(F.col("tail_c"), F.col("after.c1")).cast("long"))
    s = s.withColumn("phrases", F.col("inner") + F.col("tail_phrase"))
    by_order = Window.partitionBy("transcript_id").orderBy("seg_idx")
    so_far = by_order.rowsBetween(Window.unboundedPreceding, 0)
    return s.select(
        "transcript_id",
        (F.row_number().over(by_order) - 1).cast("long").alias("idx"),
        "start_ms",
        "end_ms",
        "first_ms",
        "last_ms",
        opener_class(F.col("c1"), F.col("second"), F.col("third")).alias("opener_kind"),
        opener_text(F.col("c1"), F.col("second"), F.col("third")).alias("opener_text"),
        F.col("tail_c").alias("closer_text"),
        F.coalesce(F.greatest(F.lit(0), F.col("start_ms") - F.lag("end_ms").over(by_order)) + 0 * F.lag("end_ms").over(by_order), F.lit(NO_GAP_MS)).alias("pause_ms"),
        F.coalesce(ends_sentence(F.lag("text").over(by_order)), F.lit(True)).alias("starts_sentence"),
        ends_sentence(F.col("text")).alias("ends_sentence"),
        F.col("tail_c").isin(lexicon.DANGLING_ENDINGS).alias("dangling"),
        "tail_phrase",
        stripped(F.col("text")).alias("text"),
        F.sum("n").over(so_far).alias("words_to"),
        F.sum("singles").over(so_far).alias("singles_to"),
        F.sum("phrases").over(so_far).alias("phrases_to"),
        F.col("n"),
        F.col("singles"),
        F.col("phrases"),
    )


def duration_fit(duration_ms: Column, min_ms: int, max_ms: int, gated: bool = True) -> Column:
    """1 in the middle of the allowed range, falling to 0 at its ends (and, gated, outside)."""
    fit = F.greatest(F.lit(0.0), 1.0 - F.abs(duration_ms - (min_ms + max_ms) / 2.0) / max(1e-3, (max_ms - min_ms) / 2.0))
    return F.when((duration_ms < min_ms) | (duration_ms > max_ms), F.lit(0.0)).otherwise(fit) if gated else fit


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, with room for the last bits of a sum: engines that add in another order round alike."""
    return F.floor(x * 10**digits + 0.5000001) / F.lit(10.0**digits)


def weighted_total(weights: dict[str, float], columns: dict[str, str] | None = None) -> Column:
    """The weighted mean of columns by component name, to four digits."""
    total = sum((F.col((columns or {}).get(name, name)) * F.lit(weight) for name, weight in weights.items()), F.lit(0.0))
    return rounded(total / F.lit(max(1e-9, sum(weights.values()))))


def within_reach(pairs: DataFrame, features: DataFrame, max_ms: int) -> DataFrame:
    """The pairs (transcript_id, start_idx, end_idx, a_start_ms, ...) of which no segment from the first to the one before
    the last ends more than max_ms after the first one's start.

    The latest end of a range of segments is that of the two ranges of a power of two that cover it: each segment has
    the latest end of the 1, 2, 4, ... segments from it on, so a pair meets two rows however far apart its ends are."""
    order = Window.partitionBy("transcript_id").orderBy("idx")
    some = features.join(pairs.select("transcript_id").distinct(), "transcript_id", "left_semi").select("transcript_id", "idx", "end_ms")
    most = pairs.agg(F.max(F.col("end_idx") - F.col("start_idx"))).first()[0] or 0
    # A level's ranges are two of the level below.
    widths, levels = some.withColumn("level_0", F.col("end_ms")), most.bit_length()
    for level in range(1, levels):
        below = F.col(f"level_{level - 1}")
        widths = widths.withColumn(f"level_{level}", F.greatest(below, F.lead(below, 1 << (level - 1)).over(order)))
    listed = F.array(*[F.col(f"level_{level}") for level in range(max(1, levels))])
    rows = widths.select("transcript_id", "idx", F.posexplode(listed).alias("level", "latest"))
    n = F.greatest(F.col("end_idx") - F.col("start_idx"), F.lit(0))  # of rows that a plan may look at before it drops them, too
    p = pairs.withColumn("level", F.length(F.bin(n)) - 1).withColumn("second", F.col("end_idx") - F.expr("shiftleft(1L, level)"))
    near = p.filter(n > 0)
    for at, name in (("start_idx", "x"), ("second", "y")):
        near = near.join(rows.select("transcript_id", F.col("idx").alias(at), "level", F.col("latest").alias(name)), ["transcript_id", at, "level"])
    near = near.filter(F.greatest("x", "y") <= F.col("a_start_ms") + max_ms)
    return near.select(*pairs.columns).unionByName(p.filter(n == 0).select(*pairs.columns))


def scored_pairs(features: DataFrame, min_ms: int = 25_000, max_ms: int = 60_000, weights: dict[str, float] | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Every pair of segments whose span is of legal length, with six components and their weighted total; with starts
    (transcript_id, start_idx) the pairs that start there.

    An end is out of reach once an earlier one, from the start segment on, has passed the longest length."""
    weights = weights or lexicon.BOUNDARY_WEIGHTS
    before = Window.partitionBy("transcript_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    f = features.withColumn("top_ms", F.coalesce(F.max("end_ms").over(before), F.lit(-(1 << 62))))
    a = f.select("transcript_id", F.col("idx").alias("start_idx"), *[F.col(c).alias(f"a_{c}") for c in ("start_ms", "first_ms", "opener_kind", "pause_ms", "starts_sentence", "words_to", "singles_to", "phrases_to", "n", "singles", "phrases", "top_ms")])
    a = a if starts is None else a.join(starts.select("transcript_id", "start_idx").distinct(), ["transcript_id", "start_idx"], "left_semi")
    b = f.select(
        "transcript_id", F.col("idx").alias("end_idx"), F.col("top_ms").alias("b_top_ms"), *[F.col(c).alias(f"b_{c}") for c in ("end_ms", "last_ms", "ends_sentence", "dangling", "tail_phrase", "words_to", "singles_to", "phrases_to")]
    )
    # The running maximum at an end tells whether it is in reach, but where a segment before the start ends that late
    # already.
    odd = F.col("a_top_ms") > F.col("a_start_ms") + max_ms
    width = max(1, max_ms)
    a = a.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("a_start_ms") + min_ms) / width), F.floor((F.col("a_start_ms") + max_ms) / width))))
    b = b.withColumn("bucket", F.floor(F.col("b_end_ms") / width))
    span = F.col("b_end_ms") - F.col("a_start_ms")
    pairs = a.join(b, ["transcript_id", "bucket"]).filter((F.col("end_idx") >= F.col("start_idx")) & (span >= min_ms) & (span <= max_ms))
    sound = pairs.filter(F.col("b_top_ms") <= F.col("a_start_ms") + max_ms)
    if not a.filter(odd).isEmpty():
        sound = sound.filter(~odd).unionByName(within_reach(pairs.filter(odd), features, max_ms))
    pairs = sound
    n_words = F.col("b_words_to") - F.col("a_words_to") + F.col("a_n")
    singles = F.col("b_singles_to") - F.col("a_singles_to") + F.col("a_singles")
    phrases = F.col("b_phrases_to") - F.col("a_phrases_to") + F.col("a_phrases") - F.col("b_tail_phrase")
    ratio = F.least(F.lit(1.0), (singles + 2 * phrases) / n_words)
    opener = (
        F.when(F.col("a_opener_kind") == "strong", 1.0)
        .when((F.col("a_opener_kind") == "forgivable") & (F.col("a_pause_ms") >= FORGIVING_PAUSE_MS), 0.75)
        .when(F.col("a_opener_kind") == "forgivable", 0.15)
        .otherwise(0.0)
    )
    scored = pairs.select(
        "transcript_id",
        "start_idx",
        "end_idx",
        F.col("a_start_ms").alias("origin_ms"),
        F.col("a_first_ms").alias("start_ms"),
        F.col("b_last_ms").alias("end_ms"),
        opener.alias("opener"),
        F.col("a_starts_sentence").cast("double").alias("starts_sentence"),
        F.col("b_ends_sentence").cast("double").alias("ends_sentence"),
        (~F.col("b_dangling")).cast("double").alias("not_dangling"),
        F.greatest(F.lit(0.0), 1.0 - ratio * 4).alias("low_filler"),
        duration_fit(F.col("b_last_ms") - F.col("a_first_ms"), min_ms, max_ms).alias("duration_fit"),
        ratio.alias("filler_ratio"),
    )
    return scored.withColumn("total", weighted_total(weights))


def components_map(pairs: DataFrame) -> DataFrame:
    """pairs with their components as one map from name to score."""
    return pairs.withColumn("components", F.create_map(*[c for name in COMPONENTS for c in (F.lit(name), F.col(name))]))


def opener_penalty(components: Column) -> Column:
    """Whether a map of components tells of a weak opening; one that doesn't say has none."""
    return F.coalesce(F.element_at(components, F.lit("opener")), F.lit(1.0)) < 1.0


def boundary_notes(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """pairs of scored_pairs() or solve() with notes: what speaks against a boundary, as a list."""
    opens = features.select("transcript_id", F.col("idx").alias("start_idx"), "opener_text", (F.col("pause_ms") / 1000).alias("pause"))
    closes = features.select("transcript_id", F.col("idx").alias("end_idx"), "closer_text")
    met = pairs.join(opens, ["transcript_id", "start_idx"]).join(closes, ["transcript_id", "end_idx"])
    # The texts of notes are part of the result.
    notes = F.array(
        F.when(F.col("opener") == 0.75, F.format_string("opens on '%s', forgiven by %.1fs pause", "opener_text", "pause")),
        F.when(F.col("opener") == 0.15, F.format_string("opens on '%s' with only %.1fs before it", "opener_text", "pause")),
        F.when(F.col("opener") == 0.0, F.format_string("opens on subordinate '%s' — refers to unseen context", "opener_text")),
        F.when(F.col("starts_sentence") == 0.0, F.lit("starts mid-sentence")),
        F.when(F.col("ends_sentence") == 0.0, F.lit("does not end on a sentence")),
        F.when(F.col("not_dangling") == 0.0, F.format_string("ends on '%s'", "closer_text")),
        F.when(F.col("filler_ratio") > 0.12, F.format_string("%.0f%% filler words", F.col("filler_ratio") * 100)),
    )
    return met.withColumn("notes", F.array_compact(notes)).drop("opener_text", "closer_text", "pause")


def starts_near(features: DataFrame, anchors: DataFrame) -> DataFrame:
    """(transcript_id, ord, anchor_ms, start_idx): the segments that start within reach of an anchor, or the nearest one.

    Both meet in buckets of the reach. The nearest is the last start before or the first after an anchor that has none."""
    reach_ms = SEARCH_BACK_MS + SEARCH_FORWARD_MS
    starts = features.select("transcript_id", F.col("idx").alias("start_idx"), F.col("start_ms").alias("origin"))
    points = anchors.select("transcript_id", "ord", "anchor_ms")
    low, high = F.col("anchor_ms") - SEARCH_BACK_MS, F.col("anchor_ms") + SEARCH_FORWARD_MS
    dealt = points.withColumn("bucket", F.explode(F.sequence(F.floor(low / reach_ms), F.floor(high / reach_ms))))
    met = dealt.join(starts.withColumn("bucket", F.floor(F.col("origin") / reach_ms)), ["transcript_id", "bucket"])
    reach = met.filter((F.col("origin") >= low) & (F.col("origin") <= high)).select("transcript_id", "ord", "anchor_ms", "start_idx")
    lost = points.join(reach.select("transcript_id", "ord").distinct(), ["transcript_id", "ord"], "left_anti")
    # Of segments that start at one time the first counts.
    firsts = starts.join(lost.select("transcript_id").distinct(), "transcript_id", "left_semi").groupBy("transcript_id", "origin").agg(F.min("start_idx").alias("start_idx"))
    none = F.lit(None)
    line = firsts.select("transcript_id", F.col("origin").cast("double").alias("at"), none.cast("long").alias("ord"), none.cast("double").alias("anchor_ms"), F.struct("origin", "start_idx").alias("s")).unionByName(
        lost.select("transcript_id", F.col("anchor_ms").cast("double").alias("at"), "ord", F.col("anchor_ms").cast("double").alias("anchor_ms"), none.cast("struct<origin:bigint,start_idx:bigint>").alias("s"))
    )
    # Anchors stand behind the segments of their time in both directions: a pass each, as nothing may look ahead.
    order = lambda at: Window.partitionBy("transcript_id").orderBy(at, F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    before, after = (F.last("s", True).over(order(at)) for at in (F.col("at").asc(), F.col("at").desc()))
    both = line.select("*", before.alias("before"), after.alias("after")).filter("ord is not null")
    each = F.transform(F.array_compact(F.array("before", "after")), lambda s: F.struct(F.abs(s["origin"] - F.col("anchor_ms")).alias("d"), s["start_idx"].alias("start_idx")))
    nearest = both.select("transcript_id", "ord", "anchor_ms", F.array_min(each)["start_idx"].alias("start_idx")).filter("start_idx is not null")
    kind = dict(reach.dtypes)["anchor_ms"]
    return reach.unionByName(nearest.withColumn("anchor_ms", F.col("anchor_ms").cast(kind)))


def solve(features: DataFrame, anchors: DataFrame, min_ms: int = 25_000, max_ms: int = 60_000, weights: dict[str, float] | None = None, whole: bool = False) -> DataFrame:
    """The best pair near each anchor (transcript_id, ord, anchor_ms): of the pairs whose start lies within reach of the
    anchor (else at the nearest segment), the first of the highest total by start and end index. Unless whole, the first
    MOST_PAIRS pairs by start and end index are tried only.

    Anchors share their starts: each start has the number of its pairs and the best of them, and only the start in
    which the last pair tried falls is looked at pair by pair. features are read several times: stage them."""
    tried = staged(starts_near(features, anchors), "tried")
    pairs = staged(scored_pairs(features, min_ms, max_ms, weights, tried), "pairs")
    start = ["transcript_id", "start_idx"]
    # The best pair of a start comes with all its columns, so that the pairs needn't be met again.
    rest = [c for c in pairs.columns if c not in (*start, "end_idx")]
    per = staged(pairs.groupBy(*start).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("total")).alias("key"), "end_idx", *rest)).alias("b")), "starts")
    tops = per.select(*start, "b.end_idx", *[F.col(f"b.{c}").alias(c) for c in rest])
    if whole:
        met = tried.join(per.select(*start, F.struct("b.key", "start_idx", "b.end_idx").alias("c")), start)
        found = met.groupBy("transcript_id", "ord").agg(F.min("c").alias("c"), F.first("anchor_ms").alias("anchor_ms"))
        return found.select("transcript_id", "ord", "anchor_ms", "c.start_idx", "c.end_idx").join(tops, [*start, "end_idx"])
    so_far = Window.partitionBy("transcript_id", "ord").orderBy("start_idx").rowsBetween(Window.unboundedPreceding, 0)
    met = tried.join(per.select(*start, "n", F.struct("b.key", "b.end_idx").alias("b")), start).withColumn("left", MOST_PAIRS - (F.sum("n").over(so_far) - F.col("n"))).filter("left > 0")
    best = met.filter("n <= left").select("transcript_id", "ord", "anchor_ms", F.struct("b.key", "start_idx", "b.end_idx").alias("c"))
    cut = staged(met.filter("n > left").select("transcript_id", "ord", "anchor_ms", "start_idx", "left"), "cut-starts")
    if not cut.isEmpty():
        by_end = Window.partitionBy(*start).orderBy("end_idx")
        placed = pairs.join(cut.select(*start).distinct(), start, "left_semi").select(*start, "end_idx", "total", F.row_number().over(by_end).alias("place"))
        last = cut.join(placed, start).filter("place <= left").select("transcript_id", "ord", "anchor_ms", F.struct((-F.col("total")).alias("key"), "start_idx", "end_idx").alias("c"))
        best = best.unionByName(last)
    found = best.groupBy("transcript_id", "ord").agg(F.min("c").alias("c"), F.first("anchor_ms").alias("anchor_ms"))
    found = found.select("transcript_id", "ord", "anchor_ms", "c.start_idx", "c.end_idx")
    if cut.isEmpty():
        return found.join(tops, [*start, "end_idx"])
    found = staged(found, "found")
    others = found.join(tops.select(*start, "end_idx"), [*start, "end_idx"], "left_anti")
    return found.join(tops, [*start, "end_idx"]).unionByName(others.join(pairs, [*start, "end_idx"]))


def pad_into_silence(spans: DataFrame, words: DataFrame, media: DataFrame, max_pad_ms: Column | int = 350) -> DataFrame:
    """spans (transcript_id, ord, start_ms, end_ms) with padded_start_ms and padded_end_ms: up to half of the gap to the
    neighbouring word, 80 ms at least, max_pad_ms at most; 80 ms where there is no gap; within [0, media_ms]."""
    most = F.lit(max_pad_ms) if isinstance(max_pad_ms, int) else max_pad_ms
    # Lists of word times, by stretches of time, and spans in one order: the last list before a span has what is nearest,
    # or else the lists before that one.
    held = spans.select("transcript_id", F.struct(*spans.columns).alias("span"))
    stretch = lambda c: F.floor(F.col(c) / PAD_STRETCH_MS).alias("stretch")

    def neighbour(rows: DataFrame, time: str, word_time: str, name: str, ahead: bool) -> DataFrame:
        lists = words.filter(F.col(word_time).isNotNull()).groupBy("transcript_id", stretch(word_time)).agg(F.collect_list(word_time).alias("times"))
        every = lists.withColumn("k", F.lit(0)).unionByName(rows.select("*", stretch(f"span.{time}"), F.lit(1).alias("k")), allowMissingColumns=True)
        window = Window.partitionBy("transcript_id").orderBy(F.col("stretch").desc() if ahead else F.col("stretch").asc(), "k")
        nearest, all_of = (F.array_min, F.min) if ahead else (F.array_max, F.max)
        earlier = all_of(nearest("times")).over(window.rowsBetween(Window.unboundedPreceding, -1))
        last = F.last(F.when(F.col("k") == 0, F.struct("times", "earlier")), True).over(window.rowsBetween(Window.unboundedPreceding, 0))
        met = every.withColumn("earlier", earlier).withColumn("last", last).filter("k = 1")
        inside = F.filter("last.times", lambda t: t >= F.col(f"span.{time}") if ahead else t <= F.col(f"span.{time}"))
        return met.select(*rows.columns, F.coalesce(nearest(inside), "last.earlier").alias(name))

    met = neighbour(held, "start_ms", "end_ms", "before", False)
    met = neighbour(met, "end_ms", "start_ms", "after", True).join(media, "transcript_id")
    met = met.select("before", "after", "media_ms", "span.*")

    def pad(gap: Column) -> Column:
        return F.when(gap <= 0, F.lit(80.0)).otherwise(F.least(most, F.greatest(F.lit(80.0), gap / 2)))

    gap_before = F.col("start_ms") - F.coalesce("before", F.lit(0))
    gap_after = F.coalesce("after", F.col("media_ms")) - F.col("end_ms")
    return met.select(
        *[met[c] for c in spans.columns],
        F.greatest(F.lit(0.0), F.col("start_ms") - pad(gap_before)).alias("padded_start_ms"),
        F.least(F.col("media_ms").cast("double"), F.col("end_ms") + pad(gap_after)).alias("padded_end_ms"),
    )
