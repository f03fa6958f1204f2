"""Syncmer fingerprints: edited texts, neighbours, likeness."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from cadenza.llm.fingerprints import fingerprints

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_edits_neighbours_and_ties(spark):
    rng = random.Random(1)
    vocab = [f"wörd{i}🙂" for i in range(500)]
    texts = {i * 7: " ".join(rng.choices(vocab, k=rng.choice([1, 4, 5, 30, 400, 3000]))) for i in range(60)}
    texts[3 * 7], texts[10 * 7], texts[11 * 7], texts[20 * 7], texts[21 * 7] = None, "", " \n ", texts[22 * 7], texts[22 * 7]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts.items()], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    ids = sorted(texts)
    near, far = [], []
    for d, after in zip(ids, ids[1:] + ids[:1]):
        text, following = texts[d] or "", texts[after] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == got[after].fingerprint) == (text.split() == following.split())
        if text.split() == following.split():
            assert r.near_next == 1.0
        elif len(text.split()) > 100:
            near.append(r.near_edited)
            far.append(r.near_next)
    assert min(near) > 0.35 and max(far) < 0.1


def test_repeated_null_and_lone_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", None, None, None), (1, "x", None, None, None), (None, "n", None, None, None), (2, "b", None, None, None)], SCHEMA)
    rows = sorted((str(r.doc_id), r.n_chars, r.near_next) for r in fingerprints(docs).collect())
    assert [(d, n) for d, n, _ in rows] == [("1", 1), ("1", 15), ("2", 1), ("None", 1)]
    assert fingerprints(docs.filter("doc_id = 2")).first().near_next == 1.0
    assert fingerprints(docs.limit(0)).collect() == []


def chained(*values):
    """Spark's xxhash64 of longs, ints and strings one after the other, nulls left out."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
        seed -= (seed >> 63) << 64
    return seed


def plain_anchors(text):
    h = [chained(w) for w in re.findall(r"[^ \t\n\x0b\x0c\r]+", text)]
    if len(h) < 5:
        return [(chained(*h), 0)] if h else []
    pair = [chained(a, b) for a, b in zip(h, h[1:])]
    found = []
    for i in range(len(h) - 4):
        inner = pair[i : i + 4]
        if min(inner) in (inner[0], inner[3]):
            found.append((chained(inner[0], inner[2], inner[3]), i))
    return found or [(chained(*h), 0)]


def plain_links(found):
    return {chained(a[0], b[0], (b[1] - a[1],)) for a, b in zip(found, found[1:])} | {chained(a[0]) for a in found[-1:]}


def test_anchors_and_likeness_by_brute_force(spark):
    rng = random.Random(11)
    vocab = ["a", "b", "ü", "🙂", "word", "x-y", "Word"]
    texts = [rng.choice([" ", "\n ", "\t"]).join(rng.choices(vocab, k=n)) for n in range(21) for _ in range(3)] + [" ".join(rng.choices(vocab + [f"w{i}" for i in range(900)], k=9_000)), "", "  "]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, next_id string, before string").repartition(3)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    show = lambda found: ",".join(f"{h & (1 << 64) - 1:016x}:{p}" for h, p in found)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        q = len(text) // 4
        own, other, after = (plain_anchors(t) for t in (text, text[: len(text) - q] + following[:q], following))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (show(own), show(other))
        assert got[i].near_edited == pytest.approx(like(plain_links(own), plain_links(other)))
        assert got[i].near_next == pytest.approx(like(plain_links(own), plain_links(after)))
        assert bool(got[i].fingerprint) == bool(text.split())


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, None)], SCHEMA)
    plan = fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_long_texts_keep_all_anchors_and_places(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**9)}" for _ in range(12_000)]
    changed = words[:6_000] + [f"v{i}" for i in range(40)] + words[6_040:]
    lone = [f"u{i}" for i in range(6_000)] + words[3_000:3_060] + [f"t{i}" for i in range(6_000)]
    moved = [w for i in range(600) for w in words[20 * (599 - i) : 20 * (600 - i)]]
    docs = spark.createDataFrame([(i, " ".join(t), None, None, None) for i, t in enumerate((words, changed, lone, words, moved))], SCHEMA)
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    places = [int(a.split(":")[1]) for a in got[0].fingerprint.split(",")]
    assert places == sorted(set(places)) and len(places) > 4_000 and places[-1] > 11_900
    assert got[0].fingerprint == got[3].fingerprint
    assert 0.98 < got[0].near_next < 1  # a paragraph of 12,000 words
    assert 0 < got[2].near_next < 0.02  # a shared passage of 60
    assert 0.5 < got[3].near_next < 0.95  # passages in another order
