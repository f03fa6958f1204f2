"""The pipeline, stage by stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[5] >= counts[4] > 0
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "secrets", "mixing", "packing"]


def odd_documents(spark):
    """Nulls in any column, blank and very long texts, repeated rows and ids, ties, and columns named as those within."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    base, long_one = text(60), text(20_000)
    rows = [(i, text(40), "en", "abc"[i % 3], 0) for i in range(40)]
    rows += [(100, base, "en", "a", 1), (101, base, None, "b", None), (102, base + " tail", "en", None, 1), (100, base, "en", "a", 1), (100, text(30), "en", "a", 1)]
    rows += [(None, None, None, None, None), (None, text(20), None, None, None), (103, None, "en", "a", 0), (104, "", "en", "a", 0), (105, " \n ", "en", "a", 3), (106, long_one, "en", "b", 5)]
    rows += [(107, "password = hunter2222 " + text(30), "en", "b", 5)]
    rows += [(i, f"{text(10)} you vile scum {text(10)} vile scum", "en", "c", 5) for i in range(200, 240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in ("node", "drop", "s", "passes", "below", "copy", "score", "spans", "size", "piece", "length", "component_id")})


def odd_labels(spark, folder):
    rows = [(i, int(i >= 200)) for i in (*range(40), *range(200, 240))] + [(None, 1), (3, None), (999, 1)]
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents_through_all_stages(spark, tmp_path):
    docs = odd_documents(spark)
    sf = odd_labels(spark, tmp_path / "sf")
    kept = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        kept.append(docs.collect())
        assert name == "packing" or docs.columns == columns
    clean, toxic, lone, masked, mixed = ([(r.doc_id, r.text) for r in rows] for rows in kept[:-1])
    words = lambda t: (t or "").split()
    assert set(toxic) <= set(clean) and sum((d or 0) >= 200 for d, _ in toxic) <= 2
    assert sorted(map(str, (x for x in clean if (x[0] or 0) < 200))) == sorted(map(str, (x for x in toxic if (x[0] or 0) < 200)))
    base = words(next(t for d, t in clean if d == 101))
    assert sum(words(t)[:60] == base for _, t in lone) == 1  # of four near copies one
    assert set(lone) <= set(toxic) and {d for d, _ in lone} >= {d for d, t in toxic if d not in (101, 102)}
    assert sum(d == 100 for d, _ in lone) == 2  # its other text is no copy
    assert len(masked) == len(lone) and next(t for d, t in masked if d == 107).startswith("[SECRET] ")
    assert all(words(t) for _, t in mixed) and set(mixed) <= set(masked)
    assert len({(r.sequence_id, r.offset) for r in kept[-1]}) == len(kept[-1])


def test_empty_table_through_all_stages(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    sf = odd_labels(spark, tmp_path / "sf")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        assert docs.count() == 0
