"""Merged segments, spans, caption lines, ranking problems, projects, strict loading, job tags: small tables, plain versions."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from cadenza.functions import media
from cadenza.operators import boundaries, captions, ranking, transcript
from cadenza.plans import pipelines
from cadenza.sources import readers, schemas
from cadenza.streaming import jobs

WORD = "transcript_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, probability_pct long"


def test_spans_meet_their_words_however_long(spark):
    rng = random.Random(1)
    words = [(t, 0, i, "w", at, at + 100, 90) for t in (1, 2) for i, at in enumerate(rng.choices(range(400_000), k=300))]
    spans = [(rng.choice([1, 2, 3]), i, at, at + rng.choice([0, -5, 1, 500, 59_999, 60_000, 350_000])) for i, at in enumerate(rng.choices(range(-1_000, 400_000), k=60))]
    got = transcript.words_between(spark.createDataFrame(words, WORD), spark.createDataFrame(spans, "transcript_id long, span_id long, from_ms long, to_ms long"))
    want = sorted((s[0], s[1], w[2]) for s in spans for w in words if w[0] == s[0] and s[2] <= (w[4] + w[5]) / 2 < s[3])
    assert sorted((r.transcript_id, r.span_id, r.word_idx) for r in got.collect()) == want


def plain_lines(words, style):
    line, held, out = -1, [], []
    for text, start, end in words:
        if not held or sum(map(len, held)) + len(held) + len(text) > style.max_chars or len(held) >= style.max_words or end - first > style.max_line_ms:  # noqa: F821
            line, held, first = line + 1, [], start
        held.append(text)
        out.append(line)
    return out


def test_caption_lines_of_many_clips(spark):
    rng = random.Random(2)
    style, rows, want = captions.Style(), [], {}
    for clip in range(30):
        at, words = 0, []
        for _ in range(rng.choice([1, 5, 300])):
            at += rng.choice([200, 400, 1_500])
            words.append(("x" * rng.choice([1, 3, 8, 30]), at, at + 180))
        want |= {(f"c{clip}", i): n for i, n in enumerate(plain_lines(words, style))}
        rows += [(f"c{clip}", i, f" {w} ", a, b) for i, (w, a, b) in enumerate(words)]
    rng.shuffle(rows)
    got = captions.caption_lines(spark.createDataFrame([*rows, ("c0", 9_999, " ", 0, 1)], "clip_id string, w long, text string, start_ms long, end_ms long"), style)
    assert {(r.clip_id, r.w): r.line for r in got.collect()} == want


def test_subtitle_header():
    head = captions.header(captions.Style(), 720, 1280).split("\n")
    assert head[0] == "[Script Info]" and "PlayResX: 720" in head and "PlayResY: 1280" in head and head[-1] == ""
    fields, values = (next(x for x in head if x.startswith(k)).split(": ", 1)[1].split(",") for k in ("Format: Name", "Style: "))
    style = dict(zip((f.strip() for f in fields), values, strict=True))
    assert style["Fontname"] == "Helvetica" and style["Alignment"] == "2" and style["MarginV"] == "180"


def test_ends_out_of_reach(spark):
    """An end behind one that has passed the longest length isn't seen, but one that ended before the start doesn't count."""
    rng = random.Random(3)
    rows = []
    for t in range(6):
        for i in range(40):
            start = i * 5_000
            rows.append((t, i, start, start + rng.choice([4_000, 4_000, 9_000, 70_000, 200_000])))
    cols = {"first_ms": F.col("start_ms"), "last_ms": F.col("end_ms"), "opener_kind": F.lit("strong"), "pause_ms": F.lit(0), "starts_sentence": F.lit(True), "ends_sentence": F.lit(True), "dangling": F.lit(False), "tail_phrase": F.lit(0)}
    cols |= {"words_to": F.col("idx") + 1, "singles_to": F.lit(0), "phrases_to": F.lit(0), "n": F.lit(1), "singles": F.lit(0), "phrases": F.lit(0)}
    features = spark.createDataFrame(rows, "transcript_id long, idx long, start_ms long, end_ms long").withColumns(cols)
    want = set()
    for t in range(6):
        own = [r for r in rows if r[0] == t]
        for a in own:
            for b in own[a[1] :]:
                span = b[3] - a[2]
                if span > 60_000:
                    break
                if span >= 25_000:
                    want.add((t, a[1], b[1]))
    got = boundaries.scored_pairs(features)
    assert {(r.transcript_id, r.start_idx, r.end_idx) for r in got.collect()} == want
    few = features.filter("idx % 7 = 0").select("transcript_id", F.col("idx").alias("start_idx"))
    some = boundaries.scored_pairs(features, starts=few).select("transcript_id", "start_idx", "end_idx").collect()
    assert {tuple(r) for r in some} == {x for x in want if x[1] % 7 == 0}


def test_nearest_starts(spark):
    rng = random.Random(4)
    starts = [(t, i, at) for t in (1, 2) for i, at in enumerate(sorted(rng.choices(range(0, 2_000_000, 1_000), k=25)))]
    anchors = [(t, i, rng.randrange(-100_000, 2_200_000)) for t in (1, 2, 3) for i in range(60)]
    got = boundaries.starts_near(spark.createDataFrame(starts, "transcript_id long, idx long, start_ms long"), spark.createDataFrame(anchors, "transcript_id long, ord long, anchor_ms long"))
    want = set()
    for t, i, at in anchors:
        own = [(abs(s - at), k, s) for x, k, s in starts if x == t]
        near = [k for _, k, s in own if at - 15_000 <= s <= at + 25_000] or [min(own)[1]] if own else []
        want |= {(t, i, at, k) for k in near}
    assert {tuple(r) for r in got.select("transcript_id", "ord", "anchor_ms", "start_idx").collect()} == want


def test_ranking_problems(spark):
    answers = [(1, '[{"id": 0}, {"id": 0}, {"id": 7}, 3]', 3), (2, "no", 2), (3, '[{"index": 1, "rank": 1}, {"id": 0, "rank": 2}]', 2), (4, "[]", 1)]
    got = ranking.ranking_problems(spark.createDataFrame(answers, "transcript_id long, text string, candidate_count int")).orderBy("transcript_id", "n").collect()
    assert [(r.transcript_id, r.problem) for r in got if r.transcript_id != 2] == [
        (1, "candidate 0 ranked twice"), (1, "rank refers to unknown candidate 7"), (1, "2 candidate(s) left unranked"), (4, "1 candidate(s) left unranked"),
    ]
    assert [r.problem.startswith("No valid JSON") for r in got if r.transcript_id == 2] == [True]


def test_similarity_backends(spark):
    rows = [(1, 1, "cats purr softly", [1.0, 0.0], 0.9), (1, 2, "dogs bark loudly", [0.99, 0.1], 0.8), (1, 3, "cats purr softly today", [0.0, 1.0], 0.7)]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, text string, embedding array<double>, rerank_score double").withColumn("normalized_score", F.lit(0.5))
    assert sorted(r.ord for r in ranking.drop_similar(c).collect()) == [1, 2]
    assert sorted(r.ord for r in ranking.drop_similar(c, 0.85, backend="embedding").collect()) == [1, 3]
    assert sorted(r.ord for r in ranking.drop_similar(c.drop("embedding"), backend="embedding").collect()) == [1, 2]
    with pytest.raises(ValueError):
        ranking.drop_similar(c, backend="other")


def test_similarity_notes(spark):
    rows = [(1, 1, "cats purr softly", 0, 0.9), (1, 2, "dogs bark loudly", 7_000, 0.8), (1, 3, "cats purr softly today", 61_000, 0.7)]
    c = spark.createDataFrame(rows, "transcript_id long, ord long, hook string, start_ms long, rerank_score double").withColumn("normalized_score", F.lit(0.5)).withColumn("text", F.col("hook"))
    notes = ranking.similarity_notes(c).collect()
    assert [(r.ord, r.note[:38], r.note.endswith("similar to 'cats purr softly' at 0s")) for r in notes] == [(3, "dropped 'cats purr softly today' at 61", True)]


def test_stored_tables(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "p1", 0.5)], "clip_id string, project_id string, score double")
    schemas.store(rows, str(tmp_path), "clips")
    found = schemas.stored(spark, str(tmp_path), "clips").first()
    assert (found.clip_id, found.score, found.topic) == ("c1", 0.5, None) and len(found) == 20


def test_stage_tables_can_be_dropped(spark):
    from pyspark.errors import AnalysisException

    from cadenza.plans.stages import drop_stages, staged

    made = staged(spark.range(3), "kept")
    path = made.inputFiles()[0].rpartition("/")[0]
    assert made.count() == 3
    drop_stages(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_components(spark):
    pairs = spark.createDataFrame([tuple([0.15, *[1.0] * 5])], ", ".join(f"{c} double" for c in boundaries.COMPONENTS))
    mapped = boundaries.components_map(pairs).select("components", boundaries.opener_penalty(F.col("components")).alias("weak")).first()
    assert mapped.weak and mapped.components["opener"] == 0.15 and len(mapped.components) == 6


def test_reframing(spark):
    one = lambda s: spark.range(1).select(media.reframe(s, F.lit(1920), F.lit(1080)).alias("c")).first().c
    assert tuple(one("center")) == (607, 1080, 656, 0) and tuple(one("fit")) == (1080, 607, 0, 656)
    with pytest.raises(ValueError):
        media.reframe("zoom", F.lit(1), F.lit(1))


def test_projects_jobs_and_previews(spark):
    projects = spark.createDataFrame([(1, 10, "a.wav"), (2, 20, None), (3, 20, "")], "project_id long, created_at long, audio_path string")
    clips = spark.createDataFrame([(1,), (1,), (9,)], "project_id long")
    assert [(r.project_id, r.clip_count, r.has_extracted_audio) for r in readers.list_projects(projects, clips).collect()] == [(2, 0, False), (3, 0, False), (1, 2, True)]
    job = spark.createDataFrame([(1, 0.123456, "2024-05-01 10:00:00")], "job_id long, progress double, created_at string")
    assert tuple(readers.shown_jobs(job).first()) == (1, 0.1235, "2024-05-01T10:00:00.000000Z")
    issues = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0)], "transcript_id long, ord long")
    assert sorted(tuple(r) for r in pipelines.previews(issues, 2).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_rerank_prompt(spark):
    words = spark.createDataFrame([(1, 0, i, f"w{i}", i * 500, i * 500 + 300, 90) for i in range(10)], WORD)
    short = spark.createDataFrame([(1, 1, 0, 1_000, "", None, "story"), (1, 0, 2_000, 3_000, "hook", "topic", "debate")], "transcript_id long, place long, start_ms long, end_ms long, hook string, topic string, category string")
    assert pipelines.rerank_prompts(short, words).first().prompt == (
        "Rank these 2 moments, the best first.\n\n[0] hook: hook\n     topic: topic | category: debate\n     says: w4 w5\n\n[1] hook: (none)\n     topic: (none) | category: story\n     says: w0 w1"
    )


def test_strict_loading(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"transcript_id": "a", "segments": []}\n')
    assert readers.load_transcript(spark, str(good)).first().transcript_id == "a"
    (tmp_path / "bad.json").write_text('{"transcript_id": "a", "segm\n')
    for name in ("bad.json", "none.json"):
        with pytest.raises(Exception):
            readers.load_transcript(spark, str(tmp_path / name)).collect()


def test_cancelled_jobs(spark):
    assert jobs.run_job(spark, 1, lambda: spark.range(5).count()) == ("COMPLETED", 5)
    assert jobs.run_job(spark, 2, lambda: 1 / 0)[0] == "FAILED"
    slow = lambda: spark.range(0, 4, 1, 4).mapInArrow(lambda bs: (time.sleep(30) or b for b in bs), "id long").count()
    timer = threading.Timer(3, jobs.cancel_job, (spark, 3))
    timer.start()
    assert jobs.run_job(spark, 3, slow)[0] == "CANCELLED"
