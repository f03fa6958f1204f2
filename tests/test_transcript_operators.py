"""Invariants of the transcript operators on small literal tables, whatever the order of the input."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import boundaries, candidates, captions, ranking, selection, transcript, windows

SENTENCES = ["This is a complete sentence about growth.", "So the thing is we tried everything twice.", "And then it failed because nobody listened.", "What would you do in that place?"]


def grid(total_s=300, step=420, word=300, gap=300, tid=1):
    segs, words, at, i = [], [], 0, 0
    while at < total_s * 1000:
        text = SENTENCES[i % 4]
        ws = text.split()
        segs.append((tid, i, at, at + step * len(ws), text, len(ws)))
        words += [(tid, i, k, w, at + step * k, at + step * k + word, 95) for k, w in enumerate(ws)]
        at += step * len(ws) + gap
        i += 1
    return segs, words


SEG = "transcript_id long, seg_idx long, start_ms long, end_ms long, text string, n_words long"
WORD = "transcript_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, probability_pct long"


@pytest.fixture(scope="module")
def data(spark):
    segs, words = grid()
    random.Random(1).shuffle(segs)
    random.Random(2).shuffle(words)
    return spark.createDataFrame(segs, SEG).cache(), spark.createDataFrame(words, WORD).cache()


def media(segs):
    return segs.groupBy("transcript_id").agg(F.max("end_ms").alias("media_ms"))


def test_chunks_tile_and_overlap(data):
    chunks = sorted(transcript.plan_chunks(media(data[0]), 60_000, 2_000).collect(), key=lambda r: r.chunk)
    assert chunks[0].commit_start_ms == 0 and chunks[-1].is_last
    for a, b in zip(chunks, chunks[1:]):
        assert a.commit_end_ms == b.commit_start_ms
        assert a.read_end_ms == min(b.commit_start_ms + 2_000, chunks[-1].commit_end_ms) and b.read_start_ms == b.commit_start_ms - 2_000


@pytest.mark.parametrize("chunk,overlap", [(7_000, 1_500), (13_000, 2_000)])
def test_merge_loses_and_doubles_nothing(data, chunk, overlap):
    segs, words = data
    chunks = transcript.plan_chunks(media(segs), chunk, overlap)
    heard = words.join(chunks.select("transcript_id", "chunk", "read_start_ms", "read_end_ms"), "transcript_id").filter("start_ms >= read_start_ms - 300 and start_ms < read_end_ms")
    merged = transcript.merge_chunks(chunks, heard).select("seg_idx", "word_idx").collect()
    assert len(merged) == len(set(merged)) == words.count()


def test_a_sound_transcript_has_no_issues(data):
    segs, words = data
    assert transcript.validate(segs, words, media(segs)).collect() == []


def test_issue_kinds(spark):
    segs = spark.createDataFrame([(1, 0, 0, 5000, "a", 2), (1, 1, 4000, 3000, "b", 1)], SEG)
    words = spark.createDataFrame([(1, 0, 0, "x", 100, 9000, 90), (1, 0, 1, "y", 200, 100, 90), (1, 1, 0, "z", 3000, 9900, 90)], WORD)
    found = {r.kind for r in transcript.validate(segs, words, spark.createDataFrame([(1, 9000)], "transcript_id long, media_ms long")).collect()}
    assert found == {"segment_reversed", "segment_overlap", "word_reversed", "word_overlap", "word_too_long", "word_before_segment", "word_after_segment", "beyond_media"}


def test_nested_round_trip(data):
    row = transcript.nested(*data).first()
    assert len(row.segments) == data[0].count() and sum(len(s.words) for s in row.segments) == data[1].count()


def brute_windows(costs, target, overlap):
    out, p = [], 0
    while p < len(costs):
        c, used = p, 0
        while c < len(costs) and (c == p or used + costs[c] <= target):
            used += costs[c]
            c += 1
        out.append((p, c - 1))
        if c >= len(costs):
            break
        p = max(p + 1, c - overlap)
    return out


@pytest.mark.parametrize("target", [5, 18, 40, 100, 10_000])
def test_token_windows_are_the_greedy_ones(spark, target):
    rng = random.Random(target)
    texts = ["x" * rng.choice([1, 8, 40, 200]) for _ in range(60)]
    segs = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 900, t, 1) for i, t in enumerate(texts)], SEG)
    got = [(r.first_idx, r.last_idx) for r in windows.token_windows(segs, target).orderBy("window").collect()]
    assert got == brute_windows([max(1, len(t) // 4) + 8 for t in texts], target, 2)


def test_solver_prefers_sentences_and_legal_lengths(data):
    segs, words = data
    f = boundaries.segment_features(segs, words)
    anchors = f.sparkSession.createDataFrame([(1, i, 40_000 * i) for i in range(5)] + [(1, 9, 10**7)], "transcript_id long, ord long, anchor_ms long")
    best = boundaries.solve(f, anchors).collect()
    assert {r.ord for r in best} >= {0, 1, 2, 3, 4}
    for r in best:
        assert 24_000 <= r.end_ms - r.start_ms <= 60_000 and r.total > 0.8


def test_selected_clips_are_disjoint_sorted_and_short_enough(data):
    segs, words = data
    f = boundaries.segment_features(segs, words)
    none = f.sparkSession.createDataFrame([], "transcript_id long, ord long, anchor_ms long")
    clips = selection.select_clips(f, words, media(segs), none, count=4).orderBy("clip").collect()
    assert 1 <= len(clips) <= 4 and all(c.strategy == "even" for c in clips)
    for a, b in zip(clips, clips[1:]):
        assert a.end_ms <= b.start_ms
    assert all(c.end_ms - c.start_ms <= 60_000 for c in clips)


def test_padding_takes_half_of_a_gap(spark):
    words = spark.createDataFrame([(1, 0, 0, "a", 0, 1000, 9), (1, 0, 1, "b", 3000, 4000, 9), (1, 0, 2, "c", 6000, 7000, 9)], WORD)
    spans = spark.createDataFrame([(1, 0, 3000, 4000)], "transcript_id long, ord long, start_ms long, end_ms long")
    m = spark.createDataFrame([(1, 9000)], "transcript_id long, media_ms long")
    r = boundaries.pad_into_silence(spans, words, m, 5000).first()
    assert (r.padded_start_ms, r.padded_end_ms) == (2000.0, 5000.0)


def test_normalised_scores_per_chunk_and_pool(spark):
    rows = [(1, i, 0, 10, c, s, "x") for i, (c, s) in enumerate([(0, 10.0), (0, 50.0), (0, 90.0), (1, 20.0), (2, 30.0), (3, 70.0), (3, 70.0), (3, 70.0)])]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, start_ms long, end_ms long, chunk_index long, raw_score double, category string")
    got = {r.ord: (r.normalized_score, r.confidence) for r in candidates.normalise(c).collect()}
    assert got[1] == (0.5, 0.75) and got[0][0] < 0.5 < got[2][0]
    assert got[3] == (0.15, 0.4) and got[4] == (0.85, 0.4)
    assert got[5] == (0.5, 0.3)


def test_overlaps_go_greedily(spark):
    # b falls to a; c would fall to b, but b is gone.
    rows = [(1, 0, 0, 100, 0.9), (1, 1, 30, 130, 0.8), (1, 2, 60, 160, 0.7)]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, start_ms long, end_ms long, normalized_score double")
    assert sorted(r.ord for r in candidates.drop_overlaps(c).collect()) == [0, 2]


def test_similar_texts_go(spark):
    rows = [(1, 0, 0.9, 0.5, "He quit his job to build a startup in his garage"), (1, 1, 0.8, 0.5, "Why he quit the job and built a startup in a garage"), (1, 2, 0.7, 0.5, "Cats sleep most of the day")]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, rerank_score double, normalized_score double, text string")
    assert sorted(r.ord for r in ranking.drop_similar(c).collect()) == [0, 2]


def test_rankings(spark):
    text = '```json\n[{"id": 2, "rank": 1}, {"id": 0, "rank": 2}, {"id": 2, "rank": 5}, {"id": 9, "rank": 1}]\n```'
    rows = spark.createDataFrame([(1, text, 4), (2, "no idea", 3), (3, "[]", 2)], "transcript_id long, text string, candidate_count int")
    got = ranking.parse_rankings(rows)
    assert {(r.transcript_id, r.id, r["rank"]) for r in got.collect()} == {(1, 2, 1), (1, 0, 2), (1, 1, 3), (1, 3, 4), (3, 0, 1), (3, 1, 2)}
    scores = {(r.transcript_id, r.id): r.rerank_score for r in ranking.rank_scores(got, F.col("rank"), F.col("n")).collect()}
    assert scores[1, 2] == 1.0 and scores[1, 3] == 0.0


def test_parsed_candidates(spark, data):
    good = '[{"start": "0.1 s", "end_time": 30, "hook": "Look", "category": "Story", "score": 9000}, {"start": 40, "end": 5, "hook": ""}, 7, {"start": 5}, {"start": 90000, "end": 90010}, {"start": 0, "end": 0.4}]'
    answers = spark.createDataFrame([(1, 0, good), (1, 1, "nothing here")], "transcript_id long, window_idx long, text string")
    rows = sorted(candidates.parse(answers, data[1]).collect(), key=lambda r: (r.chunk_index, r.item))
    assert [r.reject_reason is None for r in rows] == [True, True, False, False, False, False, False]
    assert rows[0].start_ms == 0 and rows[0].raw_score == 100.0 and rows[0].category == "story"
    assert rows[1].start_ms < rows[1].end_ms and rows[1].category == "insight" and "no hook returned" in rows[1].issues
    assert [r.reject_reason.split(":")[0].split(" (")[0] for r in rows[2:4]] == ["not an object", "missing start/end"]
    assert rows[6].reject_reason.startswith("No valid JSON")


def test_caption_events_never_overlap(spark):
    rng = random.Random(3)
    at, rows = 0, []
    for i in range(150):
        rows.append((1, i, rng.choice(["a", "word", "considerable", " "]), at, at + rng.choice([0, 180, 300])))
        at += rng.choice([180, 300, 1200])
    words = spark.createDataFrame(rows, "clip_id long, w long, text string, start_ms long, end_ms long").repartition(3)
    lines = captions.caption_lines(words)
    per = {}
    for r in lines.orderBy("w").collect():
        per.setdefault(r.line, []).append(r)
    assert all(len(v) <= 6 and sum(len(x.text) for x in v) + len(v) - 1 <= 28 for v in per.values())
    events = captions.caption_events(lines).orderBy("start_ms").collect()
    assert all(a.end_ms <= b.start_ms for a, b in zip(events, events[1:])) and all(e.end_ms > e.start_ms for e in events)
    doc = captions.documents(captions.dialogue(captions.caption_events(lines), lines), "[Events]\n").first().document
    assert doc.count("Dialogue:") == len(events)
