"""Greedy removal in rounds, chains of jumps, similar pairs, the solver with faulty segments: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza import catalog
from cadenza.functions.text import lexical_similarity
from cadenza.operators import boundaries, candidates, captions, chains, greedy, ranking, selection, windows
from cadenza.sources import tables

CONFLICT = "group long, better long, worse long"


def plain_removed(edges):
    gone = set()
    for b in sorted({b for _, b in edges}):
        if any(a not in gone for a, x in edges if x == b):
            gone.add(b)
    return gone


@pytest.mark.parametrize("finish", [0, 1_000_000])
def test_rounds_equal_the_fold(spark, finish):
    rng = random.Random(finish)
    graphs = {g: sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(rng.choice([0, 3, 40, 90]))}) for g in range(12)}
    graphs[99] = [(i, i + 1) for i in range(16)]  # a chain settles one item a round
    rows = [(g, a, b) for g, edges in graphs.items() for a, b in edges]
    got = greedy.removed(spark.createDataFrame(rows, CONFLICT), finish=finish)
    assert sorted(map(tuple, got.collect())) == sorted((g, b) for g, edges in graphs.items() for b in plain_removed(edges))
    assert greedy.removed(spark.createDataFrame([], CONFLICT), finish=finish).count() == 0


def test_overlaps_of_one_chain_of_spans(spark):
    """Each of 100,000 spans overlaps the next by two thirds: in order of time, every other one stays."""
    n = 100_000
    spans = spark.range(n).select(F.lit(1).cast("long").alias("transcript_id"), F.col("id").alias("ord"), (F.col("id") * 200).alias("start_ms"), (F.col("id") * 200 + 1_000).alias("end_ms"), (1 - F.col("id") / n).alias("normalized_score"))
    kept = candidates.drop_overlaps(spans)  # neighbours share 800 of 1,200, the next ones 600 of 1,400
    assert {r.ord for r in kept.collect()} == set(range(0, n, 2))


@pytest.mark.parametrize(("threshold", "finish"), [(0.5, 0), (0.5, 1_000_000), (0.3, 1_000_000), (1.0, 1_000_000)])
def test_overlaps_equal_the_fold(spark, threshold, finish):
    rng = random.Random(7)
    rows = []
    for t in range(3):
        for i in range(120):
            start = rng.randrange(0, 30_000)
            rows.append((t, i, start, start + rng.choice([-50, 0, 1, 900, 1_000, 2_000, 2_001, 4_000, 9_000]), rng.choice([0.1, 0.5, 0.9])))
    rows += [(0, 500 + i, 5_000, 7_000, 0.5) for i in range(4)]
    got = candidates.drop_overlaps(spark.createDataFrame(rows, "transcript_id long, ord long, start_ms long, end_ms long, normalized_score double"), threshold, finish=finish)
    want = []
    for t in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == t), key=lambda r: (-r[4], r[1])):
            clash = lambda k: min(k[3], r[3]) > max(k[2], r[2]) and min(k[3], r[3]) - max(k[2], r[2]) >= threshold * (max(k[3], r[3]) - min(k[2], r[2]))  # noqa: B023, E731
            if not any(map(clash, kept)):
                kept.append(r)
        want += [(t, r[1]) for r in kept]
    assert sorted((r.transcript_id, r.ord) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("least", [0.05, 0.27, 0.6])
def test_similar_pairs_equal_all_pairs(spark, least):
    rng = random.Random(3)
    vocabulary = ["the", "story", "stories", "telling", "money", "habit", "habits", "a", "of", "growth", "founder", "rare%d", "coffee", "walk"]
    rows = [(g, i, " ".join(rng.choice(vocabulary).replace("%d", str(rng.randrange(9))) for _ in range(rng.choice([0, 1, 2, 5, 9])))) for g in range(3) for i in range(40)]
    rows += [(0, 900, None), (0, 901, "..."), (0, 902, "..."), (1, 903, "aaaa bbbb"), (1, 904, "aaaabbbb")]
    df = spark.createDataFrame(rows, "g long, k long, text string")
    got = ranking.similar_pairs(df, "g", "k", "text", least)
    f = ranking.text_features(df)
    side = lambda n: f.select("g", F.col("k").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("tokens", "grams")])
    s = F.round(lexical_similarity(F.col("tokens_a"), F.col("tokens_b"), F.col("grams_a"), F.col("grams_b")), 6)
    want = side("a").join(side("b"), "g").filter("a < b").select("g", "a", "b", s.alias("similarity")).filter(F.col("similarity") >= least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_similarity_notes_name_the_best_that_stays(spark):
    rows = [(1, 0, 0.9, 0.5, "money habits of founders", "a", 1_000), (1, 1, 0.8, 0.5, "money habits of founders", "b", 2_000), (1, 2, 0.7, 0.5, "habits of money", "c", 3_000), (1, 3, 0.6, 0.5, "walking dogs", "d", 4_000)]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, rerank_score double, normalized_score double, text string, hook string, start_ms long")
    assert sorted(r.ord for r in ranking.drop_similar(c).collect()) == [0, 3]
    notes = {r.ord: r.note for r in ranking.similarity_notes(c).collect()}
    assert set(notes) == {1, 2} and notes[1] == "dropped 'b' at 2s — 100% similar to 'a' at 1s"
    assert sorted(r.ord for r in ranking.drop_similar(c, finish=0).collect()) == [0, 3]


def plain_chain(after):
    at, out = 0, []
    while at is not None:
        out.append(at)
        at = after[at]
    return out


@pytest.mark.parametrize("block", [1, 4, 1 << 15])
def test_chains_cross_blocks(spark, block):
    rng = random.Random(block)
    keys = {"a": [min(i + rng.choice([1, 2, 9]), 99) if i < 99 else None for i in range(100)], "b": [None], "c": [i + 1 if i < 40 else None for i in range(60)], "d": [17] + [None] * 20}
    rows = [(k, i, n) for k, after in keys.items() for i, n in enumerate(after)]
    got = chains.follow(spark.createDataFrame(rows, "key string, idx long, next long"), block)
    assert sorted(map(tuple, got.collect())) == sorted((k, at, step) for k, after in keys.items() for step, at in enumerate(plain_chain(after)))


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_token_windows_equal_a_loop(spark, block):
    rng = random.Random(11)
    texts = {t: ["x" * rng.choice([0, 1, 40, 400, 4_000]) for _ in range(n)] for t, n in ((1, 70), (2, 1), (3, 25))}
    rows = [(t, i, i * 10, i * 10 + 5, s) for t, ss in texts.items() for i, s in enumerate(ss)]
    got = windows.token_windows(spark.createDataFrame(rows, "transcript_id long, seg_idx long, start_ms long, end_ms long, text string"), 120, 2, block)
    want = []
    for t, ss in texts.items():
        kept = [(i, max(1, len(s) // 4) + 8) for i, s in enumerate(ss) if s]
        p, w = 0, 0
        while kept:
            c, total = p, 0
            while c < len(kept) and (c == p or total + kept[c][1] <= 120):
                total += kept[c][1]
                c += 1
            want.append((t, w, p, c - 1, kept[p][0] * 10, kept[c - 1][0] * 10 + 5))
            if c >= len(kept):
                break
            p, w = max(p + 1, c - 2), w + 1
    assert sorted((r.transcript_id, r.window, r.first_idx, r.last_idx, r.start_ms, r.end_ms) for r in got.collect()) == sorted(want)


def test_a_transcript_of_a_million_segments(spark):
    """Windows and lines of one very long transcript: blocks hold 32,768 positions each, and windows repeat two segments."""
    n = 1_000_000
    segs = spark.range(n).select(F.lit(1).alias("transcript_id"), F.col("id").alias("seg_idx"), (F.col("id") * 1_000).alias("start_ms"), (F.col("id") * 1_000 + 900).alias("end_ms"), F.lit("x" * 48).alias("text"))
    w = windows.token_windows(segs, 1_800).agg(F.count(F.lit(1)).alias("n"), F.max("last_idx").alias("last"), F.max("window").alias("w"), F.max(F.col("last_idx") - F.col("first_idx")).alias("size")).first()
    assert (w.last, w.size, w.w) == (n - 1, 89, w.n - 1) and w.n == -(-(n - 90) // 88) + 1
    words, n = segs.filter("seg_idx < 100000"), 100_000
    words = words.select(F.col("transcript_id").alias("clip_id"), F.col("seg_idx").alias("w"), F.lit("four").alias("text"), (F.col("seg_idx") * 300).alias("start_ms"), (F.col("seg_idx") * 300 + 200).alias("end_ms"))
    lines = captions.caption_lines(words).agg(F.max("line").alias("last"), F.count(F.lit(1)).alias("n")).first()
    assert (lines.n, lines.last) == (n, -(-n // 5) - 1)  # five words and four spaces fill 24 of 28 characters, six 29


def features_of(spark, segments):
    rows = [(1, i, a, b, f"well said {i}.") for i, (a, b) in enumerate(segments)]
    words = [(1, i, k, w, a + 10 * k, a + 10 * k + 5, 90) for i, a, w, k in ((i, a, w, k) for i, (a, _) in enumerate(segments) for k, w in enumerate(("well", "said", f"{i}.")))]
    return boundaries.segment_features(
        spark.createDataFrame(rows, "transcript_id long, seg_idx long, start_ms long, end_ms long, text string"), spark.createDataFrame(words, "transcript_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, probability_pct long")
    )


def test_pairs_with_wrong_segment_ends(spark):
    rng = random.Random(5)
    segments = [(i * 4_000, i * 4_000 + 3_800) for i in range(60)]
    for i in (0, 7, 23, 41):
        segments[i] = (segments[i][0], segments[i][0] + rng.choice([-5_000, 200_000, 70_000, 900_000]))
    got = boundaries.scored_pairs(features_of(spark, segments))
    want = set()
    for a, (start, _) in enumerate(segments):
        for b in range(a, len(segments)):
            span = segments[b][1] - start
            if 25_000 <= span <= 60_000:
                want.add((a, b))
            if span > 60_000:
                break
    assert {(r.start_idx, r.end_idx) for r in got.collect()} == want


@pytest.mark.parametrize("most", [7, 400])
def test_solver_tries_the_first_pairs_only(spark, most, monkeypatch):
    monkeypatch.setattr(boundaries, "MOST_PAIRS", most)
    segments = [(i * 2_500, i * 2_500 + 2_000 + 37 * (i % 5)) for i in range(60)]
    features = features_of(spark, segments)
    anchors = spark.createDataFrame([(1, i, at) for i, at in enumerate((0, 30_000, 61_000, 500_000))], "transcript_id long, ord long, anchor_ms long")
    pairs = sorted((r.start_idx, r.end_idx, r.total) for r in boundaries.scored_pairs(features).collect())
    near = {(r.ord, r.start_idx) for r in boundaries.starts_near(features, anchors).collect()}
    want = []
    for ord_ in range(4):
        tried = [p for p in pairs if (ord_, p[0]) in near][:most]
        want += [(ord_, *min(tried, key=lambda p: (-p[2], p[0], p[1])))] if tried else []
    assert sorted((r.ord, r.start_idx, r.end_idx, r.total) for r in boundaries.solve(features, anchors).collect()) == want


def test_the_whole_solver_tries_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(boundaries, "MOST_PAIRS", 7)
    segments = [(i * 2_500, i * 2_500 + 2_000 + 37 * (i % 5)) for i in range(60)]
    features = features_of(spark, segments)
    anchors = spark.createDataFrame([(1, i, at) for i, at in enumerate((0, 30_000, 61_000, 100_000, 500_000))], "transcript_id long, ord long, anchor_ms long")
    pairs = [(r.start_idx, r.end_idx, r.total) for r in boundaries.scored_pairs(features).collect()]
    near = [(r.ord, r.start_idx) for r in boundaries.starts_near(features, anchors).collect()]
    want = [(o, *min(tried, key=lambda p: (-p[2], p[0], p[1]))) for o in range(5) if (tried := [p for p in pairs if (o, p[0]) in near])]
    best = {whole: sorted((r.ord, r.start_idx, r.end_idx, r.total) for r in boundaries.solve(features, anchors, whole=whole).collect()) for whole in (True, False)}
    assert best[True] == want and best[False] != want


def test_sound_clips_look_at_all_anchors_and_pairs(spark, tmp_path):
    """Short sentences, of which many pairs start weakly before one that starts well; no anchor's number is divisible by
    five. Beside it a fold over all anchors and pairs in Python."""
    rng = random.Random(4)
    said = {t: " ".join("Because then." if i % 60 < 25 else rng.choice(["Cats sleep.", "Dogs run far.", "Uh, um."]) for i in range(200)) for t in (0, 1)}
    events = [(e, e % 2, rng.randrange(1_000, 1_180)) for e in range(1, 40) if e % 5]
    spark.createDataFrame([(t, 0, s) for t, s in said.items()], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    segs = tables.segments(spark, str(tmp_path))
    features = boundaries.segment_features(segs, tables.words(segs)).cache()
    anchors = selection.all_anchors(tables.anchors(spark, str(tmp_path)), catalog.media_of(segs), 5, 25_000).collect()
    start = {(r.transcript_id, r.idx): r.start_ms for r in features.collect()}
    pairs = [(r.transcript_id, r.start_idx, r.end_idx, r.total, r.start_ms, r.end_ms) for r in boundaries.scored_pairs(features).collect()]
    want, most = [], 0
    for t in said:
        kept = []
        for a in sorted((a for a in anchors if a.transcript_id == t), key=lambda a: a.ord):
            near = [p for p in pairs if p[0] == t and -15_000 <= start[t, p[1]] - a.anchor_ms <= 25_000]
            most = max(most, len(near))
            best = min(near, key=lambda p: (-p[3], p[1], p[2]), default=None)
            if best and best[3] >= 0.8 and len(kept) < 5 and all(k[5] <= best[4] or best[5] <= k[4] for k, _ in kept):
                kept.append((best, a.strategy))
        want += [(t, k[1], k[2], k[3], strategy) for k, strategy in kept]
    got = catalog.queries()["sound_clips"](spark, str(tmp_path)).collect()
    assert most > 400 and sorted((r.transcript_id, r.start_idx, r.end_idx, r.boundary_score, r.strategy) for r in got) == sorted(want)
    assert len(want) >= 4 and {w[4] for w in want} == {"discovered"}
    assert "k <= 400" not in catalog.oracle_sql()["sound_clips"] and "ord % 5" not in catalog.oracle_sql()["sound_clips"]


def test_clips_carry_text_notes_components_and_discovery(spark):
    segments = [(i * 5_000, i * 5_000 + 4_800) for i in range(80)]
    features = features_of(spark, segments)
    words = spark.createDataFrame([(1, i, 0, "w", a, a + 5, 90) for i, (a, _) in enumerate(segments)], "transcript_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, probability_pct long")
    media = spark.createDataFrame([(1, 400_000)], "transcript_id long, media_ms long")
    found = spark.createDataFrame([(1, 1, 100_000.0, "first", 0.4), (1, 2, 100_000.0, "last", 0.6), (1, 3, 101_000.0, "near", 0.7)], "transcript_id long, ord long, anchor_ms double, hook string, score double")
    clips = selection.select_clips(features, words, media, found, count=4).orderBy("clip").collect()
    assert len(clips) == 4
    hit = next(c for c in clips if c.strategy == "discovered")
    assert (hit.hook, hit.score, hit.topic) == ("last", 0.6, None)
    assert all(c.hook is None for c in clips if c.strategy == "even")
    for c in clips:
        assert c.text == " ".join(f"well said {i}." for i in range(c.start_idx, c.end_idx + 1))
        assert set(c.components) == set(boundaries.COMPONENTS) and "opens on 'well'" in c.boundary_notes
