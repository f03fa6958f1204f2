"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is its words. Every run of K words is a k-mer; its inner substrings are the runs of two words in it, by hash. It
is an anchor when the least of them stands first or last: a property of the k-mer alone, so an edit moves no anchor that
it doesn't touch. A fingerprint is all anchors in text order, each with the number of the word it starts at. Two texts
match by places: an anchor of one matches where the other has the same anchor, followed by the same next anchor at the
same distance in words, wherever that stands. The likeness is the Jaccard likeness of these matches over all anchors;
a passage that a text repeats counts once.

Defined cases: a null text is empty; a text without words has an empty fingerprint, like only to another such; words of
which no k-mer is an anchor, or fewer than K, are one anchor, the whole sequence; a document whose doc_id is null is in no order and has no next; rows
that share a doc_id have the same next document, and where that id is repeated it is the row of least links, then
text; the last document's next is the first, so a lone document is its own next; other columns than doc_id and text,
whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

K = 5
ROWS_PER_RANGE = 500_000
ANCHORS = "array<struct<hash:bigint,place:int>>"
_BLANK = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """All anchors of a text as (hash, place), in text order."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def edge(g: Column) -> Callable[[Column, Column], Column]:
        def chosen(x: Column, i: Column) -> Column:
            last = F.get(g, i + (K - 2))
            inner = F.least(F.get(g, i + 1), F.get(g, i + 2))
            return F.when((i <= F.size(g) - K) & (F.least(x, last) <= inner), F.struct(F.xxhash64(x, F.get(g, i + 2), last).alias("hash"), i.alias("place")))

        return chosen

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        found = let(pairs, lambda g: F.array_compact(F.transform(g, edge(g))))
        whole = F.when(F.size(h) == 0, F.array().cast(ANCHORS)).otherwise(F.array(F.struct(F.xxhash64(h).alias("hash"), F.lit(0).alias("place"))))
        return F.when(F.size(h) >= K, let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))).otherwise(whole)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def links(found: Column) -> Column:
    """The distinct links of anchors(): each anchor with the next one and its distance, the last with none."""
    return F.array_distinct(F.transform(found, lambda x, i: F.xxhash64(x["hash"], F.get(found, i + 1)["hash"], F.get(found, i + 1)["place"] - x["place"])))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lit(":"), x["place"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of links(); two empty ones are alike."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def next_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """((doc_id, next_id, n_chars) of each doc_id, whether one is repeated). n_chars: the most of its rows."""
    ids = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.char_length(F.coalesce("text", F.lit("")))).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    ids = stage_table(ids, "fingerprint-ids")
    size = ids.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    ranges = max(1, size["ids"] // ROWS_PER_RANGE, min(64, size["ids"] // 1_000))
    placed = stage_table(ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()), "fingerprint-ranges")
    firsts = placed.groupBy("part").agg(F.min("doc_id").alias("first"))  # a row for each range
    order = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("after"))
    leads = placed.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))).join(after, "part")
    return stage_table(leads.select("doc_id", F.coalesce("next_id", "after").alias("next_id"), "n_chars"), "fingerprint-next"), size["rows"] > size["ids"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs."""
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    every = docs.select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
    # Both joins read the texts by doc_id; as they ask for the same rows, these are dealt out once.
    base = every.filter(F.col("doc_id").isNotNull())
    follows, repeated = next_documents(base)
    heads = base.join(follows.select("next_id", F.col("doc_id").alias("before"), F.floor(F.col("n_chars") / 4).cast("int").alias("q")), F.col("doc_id") == F.col("next_id"))
    heads = heads.select("before", let(anchors(F.col("text")), links).alias("next_links"), F.left("text", F.col("q")).alias("head"))
    if repeated:
        heads = heads.groupBy("before").agg(F.min(F.struct("next_links", "head")).alias("least")).select("before", "least.*")
    joined = base.join(heads, F.col("doc_id") == F.col("before"), "left").select("doc_id", "text", "head", "next_links")
    apart = every.filter(F.col("doc_id").isNull()).select("doc_id", "text", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("next_links"))
    joined = joined.unionByName(apart).withColumn("n_chars", F.char_length("text").cast("long"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.left("text", (F.col("n_chars") - q).cast("int")), F.coalesce(F.left("head", q), F.lit("")))
    marked = joined.select("doc_id", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), anchors(F.col("text")).alias("own"), anchors(edited).alias("other"), "next_links")
    marked = marked.withColumns({"own_links": links(F.col("own")), "other_links": links(F.col("other"))})
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_links"), F.col("other_links")).alias("near_edited"),
        F.when(F.col("next_links").isNull(), F.lit(0.0)).otherwise(likeness(F.col("own_links"), F.col("next_links"))).alias("near_next"),
    )
