"""The Jaccard join against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm.jaccard_join import _crossing, one_of_each_group, signatures, similar_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, k=5, percent=75, each=False, named=False):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w]

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    found = [(d, len(sets[i]), least[find(i)], find(i))[: 4 if named else 3] for i, (d, _) in enumerate(rows)]
    return found if each else set(found)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 80, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.2:
            w += passage
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows + [(1, None), (2, ""), (4, " \n"), (5, "one"), (7, "ONE"), (8, "one two"), (10, "é x a b c d"), (11, "x " * 5000)]


def test_matches_all_pairs(spark):
    for seed in (1,):
        rows = corpus(seed, 320)
        docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect()}
        assert got == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3])):
            w[rng.randrange(60)] = f"r{rng.random()}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect()} == brute(rows)


def test_nulls_and_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None), (3, 0, 3)], key=str)
    kept = one_of_each_group(docs.withColumn("node", F.lit("clash")))
    assert kept.columns == [*docs.columns, "node"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def test_rows_that_share_an_id(spark):
    """Ids of several texts each, against all pairs; one row of each component stays, and no other text goes."""
    rng = random.Random(8)
    rows = [(rng.randrange(30), t) for _, t in corpus(4, 200)] + [(None, "w1 w2 w3 w4 w5"), (None, None)]
    rows += [(500, "a b c d e f g h i j k l m n"), (500, "o p q r s t u v w x y z"), (500, "O P q r s t u v w x y z"), (501, "o p q r s t u v w x y z aa")]
    docs = spark.createDataFrame([(d, t, "en", "s", i, "x", "y") for i, (d, t) in enumerate(rows)], SCHEMA + ", node string, component_id string")
    own = [(d, t) for d, t in rows if d is not None]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect() if r.doc_id is not None)
    assert got == sorted(brute(own, each=True))
    groups = {}
    for (d, t), (_, size, _, group) in zip(own, brute(own, each=True, named=True), strict=True):
        if size:
            groups.setdefault(group, []).append((d, t))
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    for members in groups.values():
        assert sum((r.doc_id, r.text) in members for r in kept) >= 1
        assert sum(r.n_chars in [i for i, row in enumerate(rows) if row in members] for r in kept) == 1
        assert any((r.doc_id, r.text) in members and r.doc_id == min(d for d, _ in members) for r in kept)
    assert len(kept) == len(groups) + sum(d is None or not (t or "").strip() for d, t in rows)


def test_crossing_pairs_are_those_that_pass_the_filters():
    rng = np.random.default_rng(5)
    rows = []
    for token in range(40):
        for node in rng.choice(60, rng.integers(2, 20), replace=False):
            size = int(rng.integers(3, 40)) if node % 3 else 20
            rows.append((token, 0, 0, node, node % 7, node % 4, node % 7 == 1, size, int(rng.integers(0, min(size, 9)))))
    rows += [(t, s, 1, n, c, b, big, size, place) for t, s, _, n, c, b, big, size, place in rows if not big]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[7]))
    names = ("token", "slice", "probe", "node", "comp", "blk", "big", "size", "place")
    c = {n: np.array([r[i] for r in rows]).astype(np.int64) for i, n in enumerate(names)}
    cuts = np.flatnonzero(c["token"][1:] != c["token"][:-1]) + 1
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[2] and not y[2] and x[4] != y[4] and (y[6] or x[3] < y[3]):
                s, t, i, j = x[7], y[7], x[8], y[8]
                most = min(min(i, j) + 1 + min(s - i - 1, t - j - 1), s, t)
                if 100 * min(s, t) >= 75 * max(s, t) and 175 * most >= 75 * (s + t):
                    want.add((x[3], y[5], y[3]))
    for most in (1, 7, 1 << 20):
        got = np.concatenate(list(_crossing(c, cuts, 75, most)), axis=1)
        assert {tuple(map(int, v)) for v in got.T} == {tuple(map(int, v)) for v in want}


def test_signatures_differ_by_seed():
    hashes, sizes = np.array([1, 2, 3, 1, 2, 3, 9], np.uint64), np.array([3, 3, 1])
    found = [signatures(hashes, sizes, seed) for seed in range(4)]
    assert all(f[0] == f[1] != f[2] for f in found) and len({f[0] for f in found}) == 4


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], SCHEMA)).collect() == []
