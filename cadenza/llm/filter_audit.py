"""How filters interact: what each of them removes in every order, by part, from counts of masks.

Every row fails a set of the five filters, its mask. Per part the rows of each mask are counted, and of these the good
and the toxic ones; a subset-zeta transform turns the 32 counts into the survivors of every subset of filters. What a
filter removes as a step of an order is then the difference of two neighbouring subsets, whatever the order before it,
so the 600 steps of the 120 orders come from the counts, not from the rows. Filter E needs the least doc_id of each
text: one row a text, found by a digest, that meets only rows of that text and that doc_id, so many copies of a text
are never in one task; rows alike in all that counts are first added up.

Defined cases: a null text is empty, and empty texts are copies of each other; a null lang and an empty one are one
part; a row without doc_id is a copy of none, and has no labels; rows of one doc_id and text are no copies of each
other; a document with several labels is good (toxic) if one of them says so, without a label neither; other columns
than doc_id, text and lang, whatever their names, play no part; an empty table has no parts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table
from .fingerprints import let

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT, SIGNS = 100, 80, 10, "[#$%&*|]"
_ALL = (1 << len(FILTERS)) - 1
_CAPITALS, _BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\x0b\x0c\r"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    trimmed = F.btrim(text, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, _CAPITALS, ""))
    few = lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PERCENT * F.size(w), 2).otherwise(0)
    loud = F.when(100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.char_length(text), 4).otherwise(0)
    return let(words, few) + loud + F.when(text.rlike(SIGNS), 8).otherwise(0)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a doc_id and part fail which filters."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask"))
    rows = stage_table(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    met = rows.join(firsts, ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return met.groupBy("doc_id", "part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, every, good, toxic): arrays of the rows of each mask, and of those that are labelled good or toxic."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    met = masks(docs).join(known, "doc_id", "left")
    rows = met.groupBy("part", "mask").agg(F.sum("n").alias("every"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    per = rows.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("every", "good", "toxic").alias("c")))).alias("m"))  # 32 at most
    listed = lambda name: F.transform(F.sequence(F.lit(0), F.lit(_ALL)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0)).cast("long")).alias(name)
    return per.select("part", listed("every"), listed("good"), listed("toxic"))


def survivors(counts: Column) -> Column:
    """Of counts by mask, an array by subset of filters: the rows that fail none of the subset.

    A zeta transform adds up the masks within each subset, one filter at a time; rows survive a subset if their mask
    lies within its complement."""

    def added(bit: int):
        return lambda c: F.transform(c, lambda x, i: x + F.when(F.getbit(i, F.lit(bit)) == 1, F.get(c, i - (1 << bit))).otherwise(0))

    within = counts
    for bit in range(len(FILTERS)):
        within = let(within, added(bit))
    return F.reverse(within)


def steps() -> Column:
    """Every order's steps as an array of (filter_order, step, before, bit)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    step = lambda o: lambda i: F.struct(o.alias("filter_order"), i.alias("step"), bits(F.left(o, i - 1)).alias("before"), bits(F.substring(o, i, F.lit(1))).alias("bit"))
    return F.flatten(F.transform(orders, lambda o: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), step(o))))


def shapley(alive: Column) -> Column:
    """By filter, what it removes, summed over all orders: each subset before it stands for as many orders as its filters
    and those after it have."""
    n = len(FILTERS)

    def of(i: int) -> Column:
        free = [s for s in range(_ALL + 1) if not s >> i & 1]
        return sum((factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (F.get(alive, F.lit(s)) - F.get(alive, F.lit(s | 1 << i))) for s in free), F.lit(0).cast("long"))

    return F.array(*[of(i) for i in range(n)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley."""
    counts = mask_counts(docs, labels)
    alive = counts.select("part", *[survivors(F.col(c)).alias(c) for c in ("every", "good", "toxic")])
    alive = alive.withColumn("each", shapley(F.col("every")))
    rows = alive.select("*", F.explode(steps()).alias("s")).select("part", "every", "good", "toxic", "each", "s.*")
    at = lambda name, subset: F.get(F.col(name), subset)
    before, after, bit = F.col("before"), F.col("before") + F.col("bit"), F.col("bit")
    removed = lambda name: at(name, before) - at(name, after)
    place = F.substring(F.bin(bit), 2, 5)
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("every", after).alias("kept"),
        removed("every").alias("removed"),
        (at("every", F.lit(0)) - at("every", bit) - removed("every")).alias("redundant"),
        (at("every", _ALL - bit) - at("every", F.lit(_ALL))).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.get(F.col("each"), F.length(place)).alias("shapley"),
    )
