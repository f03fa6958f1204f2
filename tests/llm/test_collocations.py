"""Collocations against counting every n-gram, exact scores, buckets and bit fields, odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import collocations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, least, most):
    count, total = Counter(), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, 6):
                count.update((lang, tuple(ws[i : i + n])) for i in range(len(ws) - n + 1))
    cands = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    held = set()
    for (lang, ws), f in cands.items():
        for n in range(2, len(ws)):
            for i in range(len(ws) - n + 1):
                if 100 * f >= 100 * cands[lang, ws[i : i + n]]:
                    held.add((lang, ws[i : i + n]))
    out = []
    for (lang, ws), a in cands.items():
        if (lang, ws) not in held:
            cuts = [(1000 * a * total[lang] // (count[lang, ws[:k]] * count[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.append((lang, " ".join(ws), a, count[lang, ws[:k]], count[lang, ws[k:]], total[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        result += [(lang, i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(result)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "San", "é", "ÉTÉ", "x-y", "🙂", "a", " b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!?"]) for _ in range(rng.choice([0, 1, 3, 30, 90])))
        rows.append((i, text, rng.choice(["en", "fr", None]), "s", 0))
    return rows + rows[:20] + [(None, None, "en", "s", None), (7, "new york city new york city", "en", "s", 0)] * 3


@pytest.mark.parametrize(("seed", "least", "most"), [(1, 5, 2_000), (2, 12, 7)])
def test_phrases_equal_counting_all(spark, seed, least, most):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("piece", "gram", "f", "n", "words")})
    got = collocations.collocations(docs, most, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, most)


def test_small_slices_and_a_full_field_change_nothing(spark, monkeypatch):
    """Slices of few bytes, and a field so small that nearly everything passes, give the same phrases."""
    rows = corpus(3, 60)
    want = brute(rows, 6, 50)
    field = np.full(collocations.FIELD_BITS // 64, np.uint64((1 << 64) - 1))
    monkeypatch.setattr(collocations, "field_of", lambda grams, words: grams.sparkSession.sparkContext.broadcast(field))
    assert sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, SCHEMA), 50, 6).collect())) == want


def test_scores_pass_64_bits(spark):
    grams = spark.createDataFrame([("en", "p", 4_000_000_000_000, 1), ("en", "q", 3_000_000_000_007, 1), ("en", "p q", 2_999_999_999_999, 2)], "lang string, gram string, f long, words int")
    totals = spark.createDataFrame([("en", 900_000_000_000_000_001)], "lang string, n long")
    a, n, l, r = 2_999_999_999_999, 900_000_000_000_000_001, 4_000_000_000_000, 3_000_000_000_007
    assert [tuple(x) for x in collocations.scored(grams, totals).collect()] == [("en", "p q", a, l, r, n, 1000 * a * n // (l * r))]


def test_one_long_piece_and_empty_tables(spark):
    rows = [(1, "a b " * 60_000, "en", "s", 0)]
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    # "a b a b a" stands 119,996 / 2 times; shorter phrases that start alike stand more often.
    assert sorted(map(tuple, got)) == brute(rows, 100, 2_000)
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "s", None)], SCHEMA)).collect() == []
