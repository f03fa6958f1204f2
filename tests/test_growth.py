"""Steps whose cost per row mustn't grow: what is shuffled, broadcast or held at once."""

import contextlib
import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cadenza.operators import boundaries, candidates, ranking, transcript
from cadenza.plans.stages import staged
from cadenza.sources import speech_source, tables


def plan(df) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("extended")
    return out.getvalue()


def words_of(spark, rows):
    return spark.createDataFrame(rows, "transcript_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long")


def test_small_files_of_many_rows_are_not_broadcast(spark):
    many = staged(spark.range(1000).selectExpr("id as transcript_id", "id % 7 as n"), "many")
    assert "BroadcastHashJoin" not in plan(many.join(spark.range(1000).withColumnRenamed("id", "transcript_id"), "transcript_id"))
    words = tables.words(tables.segments(spark, "/root/testdata/sf0.001"))
    spans = tables.anchors(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" not in plan(words.join(spans.select("transcript_id", "ord"), "transcript_id"))


def test_most_alike_by_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)] + [(40, None), (41, [1.0, None, 0.0, 0.0]), (42, [0.0] * 4), (43, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["similarity"]) for r in ranking.most_alike(v, v.filter("vec_id % 3 = 0"), 3, tile=(7, 4)).collect()}

    def like(a, b):
        if not a or not b or None in a or None in b or len(a) != len(b):
            return 0.0
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return max(0.0, round(float(np.dot(a, b) / n), 6)) if n else 0.0

    for i, a in rows:
        if i % 3 == 0:
            best = sorted((-like(a, b), j) for j, b in rows if j != i)[:3]
            assert [got[i, k + 1] for k in range(3)] == [(j, -s) for s, j in best]


def test_products_at_a_half_are_rounded_as_written():
    q, v = np.array([[1.0, 0.0]]), np.array([[0.0000005, 0.0], [0.0000015, 1.0], [-1.0, 0.0], [np.nan, 0.0]])
    assert ranking._millionths(q, v).tolist() == [[1, 2, 0, 2_000_000]]


def test_speech_batches_go_by_words(spark, tmp_path):
    pq.write_table(pa.table({"transcript_id": [str(i) for i in range(50)], "path": pa.nulls(50, pa.string()), "duration_ms": [400_000] * 50}), tmp_path / "list.parquet")
    reader = speech_source.SpeechReader({"path": str(tmp_path), "backend": "stub"}, speech_source.BACKENDS)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    sizes = [sum(len(s["words"]) for row in b.column("segments").to_pylist() for s in row) for b in batches]
    assert sum(b.num_rows for b in batches) == 50 and sum(sizes) == 50 * 1040  # 80 segments of 13 words
    assert max(sizes) < speech_source.BATCH_WORDS + 1040


def test_excerpts_across_buckets(spark):
    rows = [(1, i // 10, i % 10, f"w{i}", 400 * i, 400 * i + 300) for i in range(600)]
    spans = spark.createDataFrame([(1, 1, 0, 5_000), (1, 2, 59_000, 62_000), (1, 3, 10_000, 200_000), (1, 4, 60_000, 60_001), (1, 5, 9, 9)], "transcript_id long, span_id long, from_ms long, to_ms long")
    found = transcript.excerpt(words_of(spark, rows), spans, 30)
    for r in found.collect():
        low, high = {1: (0, 5_000), 2: (59_000, 62_000), 3: (10_000, 200_000), 4: (60_000, 60_001)}[r["span_id"]]
        text = " ".join(w[3] for w in rows if low <= w[4] < high)
        assert r["excerpt"] == (text[:30] + "…" if len(text) > 30 else text)
    assert found.count() == 4
    # Lists of words meet spans, not words one by one.
    assert "flatten(collect_list(part" in plan(found)


def test_nearest_words_in_one_line_of_time(spark):
    rows = [(1, 0, 0, "a", 0, 300), (1, 0, 1, "b", 0, 300), (1, 1, 0, "c", 299_000, 299_500), (1, 1, 1, "d", 303_000, 303_500), (1, 2, 0, "e", 10_000, None), (1, 9, 0, "f", 307_000, 309_000)]
    spans = [(1, 1, 3_000, 301_500), (1, 2, 301_000, 305_500), (1, 3, 305_000, 309_000), (1, 4, 20_000, 303_500), (1, 5, None, 300), (2, 6, 0, 300)]
    found = candidates.snap(spark.createDataFrame(spans, "transcript_id long, ord long, start_ms long, end_ms long"), words_of(spark, rows))

    def nearest(t, i):
        met = [(abs(w[i] - t), w[1], w[2], w[i]) for w in rows if t is not None and w[i] is not None and abs(w[i] - t) <= 6_000]
        return min(met)[3] if met else None

    for r in found.collect():
        a, b = (nearest(r["start_ms"], 4), nearest(r["end_ms"], 5)) if r["transcript_id"] == 1 else (None, None)
        good = a is not None and b is not None and b > a
        assert (r["snapped_start_ms"], r["snapped_end_ms"]) == ((a, b) if good else (None, None)), r
    # Words aren't joined with times.
    assert plan(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("Join ") == 1


def test_lost_anchors_take_the_nearest_start_without_looking_ahead(spark):
    features = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 200_000), (1, 3, 200_000)], "transcript_id long, idx long, start_ms long")
    anchors = spark.createDataFrame([(1, 1, 90_000), (1, 2, 110_000), (1, 3, 100_000), (1, 4, 900_000)], "transcript_id long, ord long, anchor_ms long")
    near = boundaries.starts_near(features, anchors)
    assert {(r["ord"], r["start_idx"]) for r in near.collect()} == {(1, 0), (2, 2), (3, 0), (4, 2)}
    assert "unboundedfollowing" not in plan(near).lower()


def test_stage_tables_are_written_once(spark):
    made = staged(spark.range(5), "once")
    assert staged(made, "again") is made


def test_features_count_words_within_segments(spark):
    """Rows for segments, not for words."""
    segs = tables.segments(spark, "/root/testdata/sf0.001")
    words = tables.words(segs)
    of_words, of_lists = boundaries.segment_features(segs, words), boundaries.segment_features(tables.with_words(segs), words)
    assert of_words.exceptAll(of_lists).isEmpty() and of_words.count() == of_lists.count() > 0
    assert not any("word_idx" in line for line in plan(of_lists).splitlines() if "Window [" in line or "Join" in line)
    few = [(1, 0, 0, "so", 0, 300), (1, 1, 0, "you", 400, 700), (1, 2, 0, "know", 800, 1100), (1, 2, 1, "Um,", 1200, 1500), (1, 3, 0, None, 1600, 1900), (1, 3, 1, "of", 2000, 2300)]
    segments = spark.createDataFrame([(1, i, 400 * i, 400 * i + 300, "x.") for i in (0, 1, 2, 3)], "transcript_id long, seg_idx long, start_ms long, end_ms long, text string")
    got = boundaries.segment_features(segments, words_of(spark, few)).orderBy("idx").collect()
    assert [(r["opener_text"], r["closer_text"], r["n"], r["singles"], r["phrases"], r["tail_phrase"]) for r in got][1][1:] == ("you", 1, 0, 1, 1)  # "you know" across segments
    assert [(r["closer_text"], r["n"], r["first_ms"], r["last_ms"]) for r in got] == [("so", 1, 0, 300), ("you", 1, 400, 700), ("um", 2, 800, 1500), ("of", 2, 1600, 2300)]


def test_padding_and_snapping_meet_lists_of_words(spark):
    rows = [(1, i, 0, "w", 20_000 * i, 20_000 * i + 300) for i in range(10)]
    spans = spark.createDataFrame([(1, 1, 100_000, 100_300), (1, 2, 5, 199_000), (1, 3, 61_000, 70_000)], "transcript_id long, ord long, start_ms long, end_ms long")
    media = spark.createDataFrame([(1, 200_000)], "transcript_id long, media_ms long")
    padded = boundaries.pad_into_silence(spans, words_of(spark, rows), media, 50_000)
    got = {r["ord"]: (r["padded_start_ms"], r["padded_end_ms"]) for r in padded.collect()}
    assert got == {1: (90_150.0, 110_150.0), 2: (0.0, 199_500.0), 3: (60_650.0, 75_000.0)}
    for df in (padded, candidates.snap(spans, words_of(spark, rows))):
        assert "collect_list" in plan(df)
