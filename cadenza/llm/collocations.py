"""Phrases of two to five words that stand together more often than their parts would by chance.

Texts are cut into pieces at punctuation; equal pieces of a language are kept once, with their number. N-grams are
counted over the distinct pieces, weighted by that number: a task adds up those of a slice of pieces, a shuffle by
hash brings the sums of one n-gram together, and duckdb counts each hash bucket, out of core. Only n-grams whose own
parts are frequent can be: single words first, then pairs of frequent words, then longer ones all of whose pairs are
frequent. Tasks know these by a bit field of fixed size, broadcast; a bit set by another n-gram lets some pass in vain,
and none is lost. Each candidate then asks for the counts of its parts: requests go by a shuffle to where the part's
count is, and no table of counts is broadcast. Requests for single words, of which one may be asked for very often, are
spread over SPREAD copies of the word's count.

Defined cases: a null text is empty; a null lang is `und`; A-Z are lower-cased, other letters not; blanks are spaces and
tabs, and a piece's blanks count as one; texts and pieces may be of any length; equal rows count each; other columns than
text and lang, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, mixed, stage_table, text_bytes, text_slices, word_hashes

LEAST, LONGEST, MOST = 100, 5, 2_000
#: Bits of the field of frequent n-grams: 8 MB whatever the input.
FIELD_BITS = 1 << 26
SPREAD = 16
#: Bytes of pieces that a task adds up at a time, n-grams that it writes out at a time, and memory of a bucket's count.
SLICE, GRAMS, BUCKET_MEMORY = 1 << 22, 1 << 18, "384MB"
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytearray(_LOWER.tobytes())
for _c in _ENDS:
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
_P = np.uint64(0x9E3779B97F4A7C15)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of texts, words joined by single spaces; equal ones of a slice once, with their number."""
    for whole in batches:
        for batch in text_slices(whole, "text"):
            langs, pieces = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = [b" ".join(p.split()) for p in (text or b"").translate(_TABLE).split(b"\n")]
                found = [p for p in found if p]
                pieces += found
                langs += [lang] * len(found)
            if pieces:
                table = pa.table({"lang": pa.array(langs, pa.string()), "piece": pa.array(pieces, pa.binary()).cast(pa.string())})
                yield from table.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "n"]).combine_chunks().to_batches()


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): each distinct piece of a language and how often it stands."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(_cut, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = np.array([hash_of(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def hash_of(lang: str) -> int:
    data = np.frombuffer((lang + ".").encode(), np.uint8)
    return int(mixed(np.bitwise_xor.reduce(mixed(data.astype(np.uint64) + _P * np.arange(1, len(data) + 1, dtype=np.uint64)))[None])[0])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, by the words' hashes."""
    acc = words[: len(words) - n + 1]
    for j in range(1, n):
        acc = mixed(acc * _P + words[j : len(words) - n + 1 + j])
    return acc


def _in_field(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(FIELD_BITS)
    return (field[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _grams(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], known: int, field) -> Iterator[pa.RecordBatch]:
    """The n-grams of these lengths whose parts of `known` words are in the field, added up by slices of pieces."""
    for whole in batches:
        for batch in text_slices(whole, "piece", SLICE):
            data, offsets = text_bytes(batch.column("piece"))
            spaces = np.flatnonzero(data == 32)
            starts, ends = np.sort(np.r_[offsets[:-1], spaces + 1]), np.sort(np.r_[offsets[1:], spaces])
            hashes, rows = word_hashes(data, offsets)
            hashes = mixed(hashes ^ _lang_hashes(batch.column("lang"))[rows])
            weights = batch.column("n").to_numpy(zero_copy_only=False)
            for n in lengths:
                if len(rows) < n:
                    continue
                good = rows[: len(rows) - n + 1] == rows[n - 1 :]
                if known:
                    parts = _in_field(field.value, gram_hashes(hashes, known))
                    for j in range(n - known + 1):
                        good = good & parts[j : j + len(good)]
                chosen = np.flatnonzero(good)
                for low in range(0, len(chosen), GRAMS):
                    first = chosen[low : low + GRAMS]
                    yield _summed(data, starts[first], ends[first + n - 1], batch.column("lang").take(pa.array(rows[first])), weights[rows[first]], n)


def _summed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: pa.Array, weights: np.ndarray, n: int) -> pa.RecordBatch:
    sizes = ends - starts
    to = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(starts - to[:-1], sizes) + np.arange(to[-1])
    grams = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(to.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])
    table = pa.table({"lang": langs, "gram": grams.cast(pa.string()), "f": pa.array(weights, pa.int64())}).group_by(["lang", "gram"]).aggregate([("f", "sum")]).rename_columns(["lang", "gram", "f"])
    table = table.append_column("words", pa.array(np.full(table.num_rows, n), pa.int32()))
    return table.combine_chunks().to_batches()[0]


_GRAM = "lang string, gram string, f long, words int"


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of a hash bucket that stand `least` times or more, counted by duckdb out of core. What it spills is
    scratch of this task, in its own folder, as Spark's own spills are."""
    import duckdb

    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64()), ("words", pa.int32())])
    with tempfile.TemporaryDirectory(prefix="cadenza-") as scratch:
        con = duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
        bucket = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches))  # noqa: F841 - read by name
        found = con.sql(f"SELECT lang, gram, sum(f)::BIGINT AS f, words FROM bucket GROUP BY lang, gram, words HAVING sum(f) >= {int(least)}")
        yield from (b.cast(schema) for b in found.to_arrow_reader(1 << 16))
        con.close()


def frequent(distinct: DataFrame, lengths: tuple[int, ...], known: int = 0, field=None, least: int = LEAST) -> DataFrame:
    """(lang, gram, f, words) of the n-grams of these lengths that stand `least` times or more."""
    parts = distinct.mapInArrow(partial(_grams, lengths=lengths, known=known, field=field), _GRAM)
    return stage_table(parts.repartition("lang", "gram").mapInArrow(partial(_counted, least=least), _GRAM), f"grams-{lengths[0]}")


def _bits(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            data, offsets = text_bytes(batch.column("gram"))
            hashes, rows = word_hashes(data, offsets)
            hashes = gram_hashes(mixed(hashes ^ _lang_hashes(batch.column("lang"))[rows]), words)[::words]
            at = hashes % np.uint64(FIELD_BITS)
            bits = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"])


def field_of(grams: DataFrame, words: int):
    """The bit field of n-grams of this many words, as a broadcast: FIELD_BITS, however many they are."""
    rows = grams.mapInArrow(partial(_bits, words=words), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()  # FIELD_BITS / 64 rows at most
    field = np.zeros(FIELD_BITS // 64, dtype=np.uint64)
    field[found.column("place").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(field)


def counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, gram, f, words) of all frequent n-grams of one to LONGEST words, (lang, n) of all words)."""
    distinct = stage_table(pieces(docs), "pieces")
    n_words = F.char_length("piece") - F.char_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = stage_table(distinct.groupBy("lang").agg(F.sum(F.col("n") * n_words).alias("n")), "words")
    single = frequent(distinct, (1,), least=least)
    pairs = frequent(distinct, (2,), 1, field_of(single, 1), least)
    longer = frequent(distinct, tuple(range(3, LONGEST + 1)), 2, field_of(pairs, 2), least)
    return single.unionByName(pairs).unionByName(longer), totals


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases that no longer one of equal count holds."""
    phrase = grams.filter("words > 1").withColumn("ws", F.split("gram", " "))
    inner = lambda start, size: F.array_join(F.slice("ws", start, size), " ")
    # A phrase within a longer one of equal count is also within one that is a word longer, of that count.
    wider = phrase.filter("words > 2").select("lang", "f", F.explode(F.array(inner(F.lit(1), F.col("words") - 1), inner(F.lit(2), F.col("words") - 1))).alias("gram")).distinct()
    kept = phrase.join(wider, ["lang", "gram", "f"], "left_anti")
    cuts = kept.select("lang", "gram", F.col("f").alias("a"), "ws", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), inner(F.lit(1), F.col("k")).alias("part"), F.col("k").alias("size")), F.struct(F.lit("r").alias("side"), inner(F.col("k") + 1, F.col("words")).alias("part"), (F.col("words") - F.col("k")).alias("size")))
    asked = cuts.select("lang", "gram", "a", "k", F.explode(sides).alias("q")).select("lang", "gram", "a", "k", "q.*")
    asked = asked.withColumn("copy", F.when(F.col("size") == 1, F.pmod(F.xxhash64("gram", "k"), F.lit(SPREAD))).otherwise(0).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("words") == 1, SPREAD - 1).otherwise(0)))
    known = grams.select("lang", F.col("gram").alias("part"), "f", copies.alias("copy"))
    answers = asked.join(known.hint("shuffle_hash"), ["lang", "part", "copy"])
    both = answers.groupBy("lang", "gram", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("top div under"))
    least = both.groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("c"))
    return least.select("lang", F.col("gram").alias("phrase"), "a", "c.l", "c.r", "c.n", "c.score")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(*counts(docs, least)).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
