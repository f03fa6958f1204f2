"""Licence scans by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form - lower case, without copyright lines, one spelling of each variant, words with
single spaces between - and its SHA-256 is hash-joined to the digests of known licences, brought to the same form. The
lines that mention a licence are looked up likewise among known notices. Known texts are a parameter; the table of
their digests holds a row for each and is small beside the documents, so Spark broadcasts it below its threshold.

Defined cases: a null text is empty; a text without words has the digest of the empty text and no licence; equal rows
get a row each, a null doc_id too; a licence inside a longer text isn't that text's licence; of known texts with one
digest the first name counts; other columns than doc_id and text, whatever their names, play no part; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, LICENSES, NOTICES, TITLES

# Spellings taken as one, written as the second.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("favour", "favor"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labour", "labor"), ("modelling", "modeling"), ("non-commercial", "noncommercial"),
    ("optimisation", "optimization"), ("organisation", "organization"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("sub-license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("https:", "http:"), ("&", " and "),
]
#: Lines that name a holder: a sign or year behind the word, or the sign alone. Lines that go on about copyright stay.
COPYRIGHT_LINE = r"(^|\n)[ \t/*#;%-]*((copyright[ \t]*)+(\(c\)|©|[0-9<\[]|by[ \t])|\(c\)[ \t]*[0-9<\[]|©|all rights reserved[.]?[ \t\r]*(\n|$))[^\n]*"
NOT_WORDS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    for variant, kept in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(kept))
    return F.btrim(F.regexp_replace(out, NOT_WORDS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def titled(texts=tuple(LICENSES), titles: dict[str, str] = TITLES) -> list[tuple[str, str]]:
    """(name, text) of each licence as it stands, and behind its title."""
    return [(name, form) for name, text in texts for form in ((text, f"{titles[name]}\n{text}") if name in titles else (text,))]


def known_digests(spark: SparkSession, texts, digests=()) -> DataFrame:
    """(digest, name) of named texts, and of texts that are known by (name, digest) alone."""
    named = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(texts)], "n int, name string, text string").select("n", "name", digest(F.col("text")).alias("digest"))
    ready = spark.createDataFrame([(1_000_000 + i, name, found) for i, (name, found) in enumerate(digests)], "n int, name string, digest string")
    return named.unionByName(ready).groupBy("digest").agg(F.min_by("name", "n").alias("name"))


def scan(docs: DataFrame, licenses: DataFrame, notices: DataFrame) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (names of the notices in its lines, by name)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"), "text")
    mentions = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.lower(line).rlike("licen[cs]e|licensed|spdx"))
    rows = rows.select("doc_id", "digest", F.array_distinct(F.transform(F.coalesce(mentions, F.array().cast("array<string>")), digest)).alias("lines"))
    # Rows of one doc_id and digest are alike, so notices are found once for them.
    lines = rows.filter(F.size("lines") > 0).select("doc_id", "digest", F.explode("lines").alias("line"))
    met = lines.join(notices.select(F.col("digest").alias("line"), "name"), "line").groupBy("doc_id", "digest").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices"))
    met = met.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "notices")
    whole = rows.select("doc_id", "digest").join(licenses.withColumnRenamed("name", "license"), "digest", "left")
    found = whole.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    return found.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def license_scan(docs: DataFrame, licenses: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """scan() for known licences and notices, by default the built-in ones, given as (digest, name)."""
    spark = docs.sparkSession
    return scan(docs, known_digests(spark, titled(), DIGESTS) if licenses is None else licenses, known_digests(spark, NOTICES) if notices is None else notices)
