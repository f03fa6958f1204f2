"""Source mixing: targets against plain resharing, words taken, reruns."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm.mixing import mix, mix_sizes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def resharing(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words(spark, seed):
    rng = random.Random(seed)
    sources = ["src1", "src10", "src2", "Z", "é", None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])) + " \t", "en", sources[min(5, int(rng.expovariate(0.7)))], 0) for i in range(1500)]
    rows += [(9001, None, None, "src1", None), (9001, None, None, "src1", None), (None, "x y", None, "lone", None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mix_sizes(docs).collect()
    sizes, taken = {}, {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    by_id = {r[0]: r[3] for r in rows}
    want = resharing(sizes)
    for r in got:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] = taken.get(source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= (21 if source != "lone" else 2)
    assert sorted(map(str, mix_sizes(docs.repartition(2)).collect())) == sorted(map(str, got))
    kept = mix(docs)
    assert kept.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in kept.collect()) == sum(r.taken for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix_sizes(docs).collect() == [] and mix(docs).collect() == []


def test_long_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000, "en", "a", 0), (2, "w " * 10, "en", "a", 0), (3, "x " * 50, "en", "b", 0)], SCHEMA)
    clash = docs.withColumns({c: F.lit("clash") for c in ("s", "passes", "below", "copy", "h", "size", "target", "source_size", "taken", "held", "budget", "prefix")})
    rows = {r.doc_id: r for r in mix_sizes(clash).collect()}
    assert rows == {r.doc_id: r for r in mix_sizes(docs).collect()}
    assert [rows[i].size for i in (1, 2, 3)] == [300_000, 10, 50] and rows[3].target == 150.0 and rows[3].taken == 150
    kept = mix(clash)
    assert kept.columns == clash.columns and kept.filter("doc_id = 3 and s = 'clash'").count() == 3


@pytest.mark.parametrize(("alike", "other"), [(1_000, 0), (1_000, 250), (37, 11), (2, 1)])
def test_rows_alike_come_near_the_target(spark, alike, other):
    """Rows of one id and text share a hash: a part of them is taken, however they are dealt."""
    rows = [(7, "five words stand here now", "en", "a", 0)] * alike + [(100 + i, "w w w", "en", "a", 0) for i in range(other)] + [(8, "x y z " * 30, "en", "b", 0)] * 10 + [(9, "u v", "en", "c", 0)] * 30
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sizes(docs.repartition(7)).collect()
    by_id = {r[0]: r[3] for r in rows}
    taken, target, largest = {}, {}, {}
    for r in got:
        s = by_id[r.doc_id]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r.taken, r.target, max(largest.get(s, 0), r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken), (taken, target)
    assert sorted(map(tuple, mix_sizes(docs.repartition(2)).collect())) == sorted(map(tuple, got))
    assert sum(len(r.text.split()) for r in mix(docs).collect()) == sum(taken.values())
