"""The filter audit against applying every order of filters row by row."""

import random
import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from cadenza.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    out |= {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def brute(rows, labels):
    good, toxic = defaultdict(bool), defaultdict(bool)
    for d, q, t in labels:
        good[d] |= q == 1
        toxic[d] |= t == 1
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    parts = defaultdict(list)
    for d, text, lang, *_ in rows:
        own = fails(text or "") | ({"E"} if d is not None and d > least[text or ""] else set())
        parts[lang or ""].append((own, d is not None and good[d], d is not None and toxic[d]))
    out = []
    for part, docs in parts.items():
        removed = defaultdict(int)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            alive = docs
            for i, f in enumerate(order):
                gone = [d for d in alive if f in d[0]]
                kept = [d for d in alive if f not in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(gone)
                steps.append((part, order, i + 1, len(kept), len(gone), redundant, sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
                removed[f] += len(gone)
                alive = kept
        out += [(*s, removed[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_equals_every_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = [rng.choice(["UP", "low", "é", "x#y", f"w{rng.randrange(500)}", f"W{rng.randrange(500)}"][: rng.choice([4, 6, 6])]) for _ in range(rng.choice([0, 1, 50, 99, 100, 160]))] if rng.random() < 0.5 else [f"v{i}-{k}" for k in range(rng.choice([99, 100, 140]))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words), rng.choice(["en", "fr", "", None]), "s", 0))
    rows += [(500 + i, rows[rng.randrange(20)][1], rng.choice(["en", "de"]), "s", 0) for i in range(40)]
    rows += [(None, rows[0][1], "en", "s", None), (None, None, None, "s", None), (900, None, "en", "s", None), (901, "", "en", "s", 0), (3, rows[3][1], "en", "s", 0), (3, rows[4][1], "en", "s", 0)]
    labels = [(rng.randrange(-5, 160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit(1) for c in ("part", "mask", "n", "digest", "first", "good", "toxic", "quality")})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash")))
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_many_copies_long_texts_and_empty_tables(spark):
    copies = spark.range(3_000).select("id", F.lit("same words here").alias("text"), F.lit("en").alias("lang"))
    long = spark.createDataFrame([(9_000, "word " * 400_000, "en")], "id long, text string, lang string")
    docs = copies.unionByName(long).withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = {r.filter_order: r for r in filter_audit.audit(docs, labels).filter("step = 1").collect()}
    assert (first["EABCD"].removed, first["ABCDE"].removed, first["BACDE"].removed, first["EABCD"].redundant) == (2_999, 3_000, 1, 0)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []


def test_survivors_of_subsets():
    counts = list(range(32))
    want = [sum(c for m, c in enumerate(counts) if not m & s) for s in range(32)]
    within = counts
    for bit in range(5):
        within = [x + (within[i - (1 << bit)] if i >> bit & 1 else 0) for i, x in enumerate(within)]
    assert within[::-1] == want
