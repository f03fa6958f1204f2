"""Packing: the reduction against optimal packings, token ids, places."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import packing
from cadenza.llm.packing import pack, reduce_and_pack
from cadenza.llm.queries import tokenizer_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def bins(lengths, capacity):
    counts = Counter(lengths)
    runs, n = reduce_and_pack(counts, capacity)
    held, used = {}, Counter()
    for length, first, k, sequence, offset in runs:
        assert first == used[length]
        used[length] += k
        for j in range(k):
            held.setdefault(sequence + j, []).append((offset, length))
    assert used == counts and len(held) == n
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return n


def optimum(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for r in {r for r in room if r >= lengths[i]}:
            j = room.index(r)
            place(i + 1, room[:j] + [r - lengths[i]] + room[j + 1 :])
        place(i + 1, [*room, capacity - lengths[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for t in range(300):
        capacity = rng.choice([10, 20, 37])
        low = capacity // 3 if t % 2 else 1
        lengths = [rng.randint(low, capacity) for _ in range(rng.randint(0, 9))]
        assert bins(lengths, capacity) == optimum(lengths, capacity)


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 2048), lambda r: min(2048, 1 + int(r.expovariate(1 / 700))), lambda r: r.choice([700, 701, 1347, 2048])])
def test_large_instances_are_near_their_bound(draw):
    rng = random.Random(2)
    lengths = [draw(rng) for _ in range(20_000)]
    assert bins(lengths, 2048) <= 1.13 * sum(lengths) / 2048 + 1


def test_pieces_ids_and_places(spark):
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", "Hello world", "a<|endoftext|>b <|endoftext|> <|endoftext", "é ü ß 中文 🙂\n\n  x", "one two three " * 1500, "y " * 2047, "Hello world"]
    docs = spark.createDataFrame([(i if i != 6 else None, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    docs = docs.withColumns({c: F.lit("clash") for c in ("piece", "start", "length", "slice", "position", "offset")})
    rows = pack(docs, *tokenizer_files()).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by[i if i != 6 else None], key=lambda r: r.piece)
        assert [p.start for p in parts] == [0, *[p.start + p.length for p in parts[:-1]]]
        assert sum(p.length for p in parts) == len(ids) and all(p.length == 2048 for p in parts[1:])
        for p in parts:
            part = ids[p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack(docs.limit(0), *tokenizer_files()).collect() == []


def odd_texts():
    rng = random.Random(3)
    spaces = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f ", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u180e", "\u200b", "\ufeff"]
    words = ["don't", "we'll've", "'s", "'S", "x'", "a1b2", "½", "٣", "中文字", "é", "e\u0301", "🙂👍🏽", "%%%", "...", "<|endoftext|>", "<|endof", "text|>", "\x00", "\x07", "ﬁ", "İ", "ǅ", "_", "a_b", "http://x.y/z?q=1#f"]
    found = ["".join(rng.choice(words) + rng.choice(spaces) * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    found += ["".join(rng.choice(spaces) + rng.choice([*words, ""]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    points = [*range(0xD800), *range(0xE000, 0x11000)]
    return found + ["".join(map(chr, rng.choices(points, k=200))) for _ in range(300)]


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    """Whole texts of a table, and odd ones, with a memory so small that it is emptied again and again."""
    (path,) = tokenizer_files()
    plain = Tokenizer.from_file(path)
    texts = odd_texts() + [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    monkeypatch.setattr(packing, "MEMO_CHARS", 20_000)
    got = list(packing.TokenEncoder(path).encode(texts))  # one tokenizer after the other: they share a cache, which a change empties
    for text, found in zip(texts, got, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_parts_of_a_long_text():
    encoder = packing.TokenEncoder(*tokenizer_files())
    text = "ab  c\n\n d\t" * 40 + " "
    for most in (1, 2, 3, 7):
        parts = [c for part in encoder.stretches(text, most) for c in part]
        assert parts == [c for part in encoder.stretches(text) for c in part] and "".join(parts) == text


def test_repeated_sets_dominate_each_time():
    """Sets fixed many times at once pack as well as the same pieces one by one."""
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([12, 20, 37])
        few = [rng.randint(max(2, capacity // 5), capacity) for _ in range(rng.randint(1, 3))]
        lengths = [k for k in few for _ in range(rng.randint(1, 5))][:11]
        assert bins(lengths, capacity) == optimum(lengths, capacity)
        # Ten times as many pieces take at most ten times as many sequences.
        assert bins(lengths * 10, capacity) <= 10 * bins(lengths, capacity)


def test_rows_alike_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    rows = [(None, "same text")] * 300 + [(5, "one"), (5, "another " * 3_000), (5, "one")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *tokenizer_files()).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got) and sum(r.doc_id is None for r in got) == 300
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(p)[i][0] + sorted(p)[i][1] == sorted(p)[i + 1][0] for p in filled.values() for i in range(len(p) - 1))


def test_few_runs():
    rng = random.Random(5)
    for most in (2048, 700, 100):
        counts = Counter(min(2048, 1 + int(rng.expovariate(1 / most))) for _ in range(300_000))
        runs, _ = reduce_and_pack(counts)
        assert len(runs) <= 16 * 2048


def test_an_idle_worker_forgets_its_stretches():
    encoder = packing.TokenEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    with encoder.task(0.05):
        first = list(encoder.encode(["some words, remembered"]))
        assert encoder.memo
        time.sleep(0.2)
        assert encoder.memo
    for _ in range(100):
        if not encoder.memo:
            break
        time.sleep(0.05)
    assert not encoder.memo and not encoder.older and encoder.chars == 0
    with encoder.task():
        assert list(encoder.encode(["some words, remembered"])) == first
        encoder.forget(0)
        assert encoder.memo


def test_new_stretches_are_encoded_together(monkeypatch):
    """Stretches that a worker meets for the first time take one call of the tokenizer, not one each, and have the ids
    that they have alone; where tokens don't end with stretches each is encoded alone."""
    encoder = packing.TokenEncoder(*tokenizer_files())
    some = sorted({s for text in odd_texts() for s in packing._STRETCH.findall(text)} - {""})
    whole = [s for s in some if not any(w in s for w in encoder.whole)]
    alone = encoder.exact(whole)
    calls = []
    exact = encoder.exact
    monkeypatch.setattr(encoder, "exact", lambda texts: calls.append(len(texts)) or exact(texts))
    assert encoder.ids_of(whole) == alone
    assert list(encoder.encode(["some new words,here"] * 3 + ["and newer (ones)"])) == exact(["some new words,here"] * 3 + ["and newer (ones)"])
    calls.clear()
    list(encoder.encode([f"unseen{i} stretch{i}" for i in range(200)]))
    assert sum(calls) <= 2
    encoder.sizes[:] = 2
    assert encoder.joined(whole[:50]) == alone[:50]
