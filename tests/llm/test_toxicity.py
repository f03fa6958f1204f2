"""Toxicity: held-out accuracy on the small tables, edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import toxicity
from cadenza.llm.queries import op1_kneser_ney_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = op1_kneser_ney_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) >= 0.93
    every = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("k")).first()
    assert every.n == every.k == spark.read.parquet(f"{SF}/documents.parquet").count() and 0 <= every.lo <= every.hi <= 1


def test_edges(spark):
    words = ["good day sir", "fine weather today", "lovely garden path", "calm river bank"]
    rows = [(i, " ".join(words[(i + j) % 4] for j in range(6)) + (" you vile scum" if i % 2 else ""), "en", "s", 0, "x") for i in range(120)]
    rows += [(None, None, None, None, None, None), (900, "", None, None, None, None), (900, "", None, None, None, None), (901, "VILE scum " * 20_000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert sum(by[i] == i % 2 for i in range(120)) >= 114 and by[901] == 1 and by[900] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 901").count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def plain_model(texts):
    """P(byte | those before, class) by dictionaries: the last byte of an n-gram of any order up to ORDER."""
    counts = [Counter(), Counter()]
    for label, text in texts:
        padded = b" " * (toxicity.ORDER - 1) + text.encode() + b" "
        for i in range(len(padded) - toxicity.ORDER + 1):
            counts[label][padded[i : i + toxicity.ORDER]] += 1
    levels = {toxicity.ORDER: counts}
    for order in range(toxicity.ORDER - 1, 0, -1):
        levels[order] = [Counter(g[1:] for g in c) for c in levels[order + 1]]
    for order in range(1, toxicity.SHARED_ORDER + 1):
        levels[order] = [levels[order][0] + levels[order][1]] * 2

    def p(gram, label):
        if not gram:
            return 1 / 256
        c = levels[len(gram)][label]
        mass = [max(1, sum(x.values())) for x in levels[len(gram)]]
        prior = toxicity.PRIOR * mass[label] / min(mass)
        beside = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        held = sum(max(n - toxicity.DISCOUNT, 0) for n in beside)
        return (max(c[gram] - toxicity.DISCOUNT, 0) + (sum(beside) - held + prior) * p(gram[1:], label)) / (sum(beside) + prior)

    return p


def test_model_against_a_plain_one():
    rng = random.Random(9)
    texts = [(rng.randrange(2), "".join(rng.choices("abc", k=rng.randrange(12)))) for _ in range(14)]
    p = plain_model(texts)
    codes, sizes = toxicity.windows(pa.array([t for _, t in texts]))
    toxic = np.repeat([label for label, _ in texts], sizes)
    keys, at = np.unique(codes, return_inverse=True)
    model = toxicity.Model(keys, np.c_[np.bincount(at, toxic), np.bincount(at, 1 - toxic)])
    for _ in range(40):
        gram = "".join(rng.choices("abc d", k=toxicity.ORDER)).encode()
        code = np.array([int.from_bytes(gram, "big")], dtype=np.uint64)
        assert model.evidence(code)[0] == pytest.approx(np.log(p(gram, 1)) - np.log(p(gram, 0)), abs=1e-5)
    for label in (0, 1):
        for head in (b"", b"a", b"  ab", b"abcab", b"zzzzz"):
            assert sum(p(head + bytes([b]), label) for b in range(256)) == pytest.approx(1)


def test_rare_grams_count(spark):
    letters = random.Random(7)
    text = lambda i: "".join(letters.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) + (" wretchling" if i == 41 else "")
    docs = spark.createDataFrame([(i, text(i)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)[0].value
    learned = labels.filter(toxicity.learnable(F.col("doc_id"))).filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(toxicity.FOLDS)) > 0)
    rows = docs.join(learned, "doc_id").select("text", "toxic").collect()
    codes, sizes = toxicity.windows(pa.array([r.text for r in rows]))
    toxic = np.repeat([r.toxic for r in rows], sizes)
    keys, at = np.unique(codes, return_inverse=True)
    assert len(keys) > 600_000
    whole = toxicity.Model(keys, np.c_[np.bincount(at, toxic), np.bincount(at, 1 - toxic)])
    assert model.grams[toxicity.ORDER].get(keys)[1].all()
    assert np.allclose(model.evidence(keys), whole.evidence(keys), atol=1e-6)


def test_sample_is_bounded_where_ids_repeat(spark):
    """Rows that share an id count once, and texts that pass the byte bound are left out whole."""
    docs = spark.createDataFrame([(i % 40, f"some words {i % 40} here", "en", "s", 0) for i in range(4_000)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    (model, _), (less, _) = toxicity.train(docs, labels, most_rows=10), toxicity.train(docs.filter("doc_id < 40").dropDuplicates(["doc_id"]), labels, most_rows=10)
    assert sorted(model.value.__dict__) == sorted(less.value.__dict__)
    rows = [{"doc_id": i, "toxic": i % 2, "h": -i, "size": 10 * i} for i in range(20)]
    kept = [i for (i,) in toxicity._within(rows, 400)]
    assert sum(10 * i for i in kept if i % 2) <= 400 and sum(10 * i for i in kept if not i % 2) <= 400 and len(kept) > 4
