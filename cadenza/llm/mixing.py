"""Mixing sources to target weights by hash-threshold histograms.

Every row has a size and a hash. A source that is to give `target` of its `source_size` words gives whole passes
of itself plus the rows whose hash lies below a threshold. The threshold comes from histograms: sizes are summed by
source and leading hash bits, the bucket in which the running sum crosses the budget is found, and only the rows of that
bucket are summed again by the next bits, until a bucket holds a single hash. Rows are never sorted, and a row's copies
depend on its hash alone, so reruns agree. Rows of one doc_id and text share a hash: where the threshold falls on it, as
many of them are taken as come nearest to the budget, by an ordinal counted over the parts in which they lie.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own, last in order;
of rows alike in doc_id and text a part may be taken once more than the others, and which ones is open; a document that alone is larger than its source's
budget is taken or not, whichever comes nearer; other columns than doc_id, text and source, whatever their names, play no
part, and mix() keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_names, stage_table

#: Hash bits that one histogram resolves; five rounds cover a hash.
ROUND_BITS = 12
HASH_BITS = 60


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """HASH_BITS bits, as a long of at least 0: the first fifteen hex digits of SHA-1 of "id:text"."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.left(F.sha1(whole.cast("binary")), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def water_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target): shares of the sum by weight, none above most * source_size.

    sizes is one row per source. The excess that is reshared by weight until no source is above its cap ends at
    min(cap, level * weight), with one level for all: sources fill in the order of cap / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % n + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    # The level rises while sources fill up to their caps and falls after the first that doesn't: its peak is the one that holds.
    return levels.withColumn("held", F.max("level").over(everything)).select("source", "source_size", F.least("cap", F.col("held") * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target, passes, below, edge, some): a row is taken passes times, and once more if its hash is
    below, or if it is one of the first `some` rows whose hash is edge (null: there are none such).

    rows: (source, size, h)."""
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        water_targets(sized, weights, most)
        .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0).cast("int"))
        .withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    plan = stage_table(plan, "mix-plan")
    bits = HASH_BITS
    while bits > 0:
        step = min(ROUND_BITS, bits)
        bits -= step
        # Only rows of the boundary bucket: those whose bits above agree with the prefix found so far.
        inside = rows.alias("r").join(
            plan.select(F.col("source").alias("s"), "prefix", "budget").alias("p"),
            F.col("r.source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", bits + step) == F.col("prefix")) & (F.col("budget") > 0) & (F.col("size") > 0),
        )
        sums = inside.groupBy("r.source", F.shiftrightunsigned("h", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.count(F.lit(1)).alias("rows"))
        running = Window.partitionBy("source").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("size").over(running))
        crossing = (
            upto.filter(F.col("upto") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("under"), F.col("size").alias("held"), "rows")).alias("c"))
            .select(F.col("source").alias("s"), "c.*")
        )
        found = plan.select("source", "source_size", "target", "passes", "budget", "prefix").join(crossing, F.col("source").eqNullSafe(F.col("s")), "left")
        # No crossing: the whole bucket fits, and the budget stays open beyond it.
        plan = found.select(
            "source",
            "source_size",
            "target",
            "passes",
            F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.col("budget") - F.col("under")).alias("budget"),
            F.coalesce(F.col("bucket"), F.when(F.col("budget") > 0, (F.col("prefix") + 1) * (1 << step)).otherwise(F.col("prefix") * (1 << step))).alias("prefix"),
            F.coalesce("held", F.lit(0)).alias("held"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
        )
        plan = stage_table(plan, "mix-plan")
        if plan.filter((F.col("budget") > 0) & (F.col("rows") > 1)).isEmpty():
            break
    # The boundary bucket is now one row, or alike rows of one hash: as many are taken as come nearest to the budget.
    some = F.when(F.col("held") > 0, F.floor(F.col("budget") * F.col("rows") / F.col("held") + 0.5)).otherwise(0)
    whole = F.col("some") >= F.col("rows")
    below = F.shiftleft("prefix", bits) + F.when((F.col("held") > 0) & whole, F.shiftleft(F.lit(1).cast("long"), bits)).otherwise(0)
    edge = F.when((F.col("some") > 0) & ~whole, F.col("prefix"))  # only when all bits are resolved
    return stage_table(plan.withColumn("some", some).select("source", "source_size", "target", "passes", below.alias("below"), edge.alias("edge"), F.col("some").cast("long").alias("some")), "mix-thresholds")


def copies(passes: Column, h: Column, below: Column, size: Column) -> Column:
    return F.when(size > 0, passes + (h < below).cast("int")).otherwise(F.lit(0))


def with_copies(rows: DataFrame, plan: DataFrame, source: Column, h: Column, size: Column, name: str) -> DataFrame:
    """rows joined to their source's plan, with the number of times each is taken as `name`. plan: thresholds()."""
    columns = free_names(rows, *plan.columns, "ordinal", "part")
    s, passes, below, edge, some, ordinal, part = (columns[i] for i in (0, 3, 4, 5, 6, 7, 8))
    met = rows.join(plan.toDF(*columns[:7]), source.eqNullSafe(F.col(s)), "left")
    n = copies(F.col(passes), h, F.col(below), size)
    if plan.filter("edge is not null").isEmpty():
        return met.withColumn(name, n)
    # Rows on the edge are numbered by where they lie: their table's parts are counted, and places follow from the counts.
    alike = stage_table(met.filter((h == F.col(edge)) & (size > 0)).withColumn(ordinal, F.monotonically_increasing_id()), "mix-edge")
    alike = alike.withColumn(part, F.shiftrightunsigned(ordinal, 33))
    held = alike.groupBy(s, part).agg(F.count(F.lit(1)).alias("n"))  # a row for each part and source
    so_far = held.withColumn("before", F.sum("n").over(Window.partitionBy(s).orderBy(part)) - F.col("n"))
    # Places within a part count rows of several sources; a source's rows of a part are numbered anew.
    order = Window.partitionBy(s, part).orderBy(ordinal)
    numbered = alike.withColumn(ordinal, F.row_number().over(order) - 1)
    b, p = free_names(numbered, "before", "other_part")
    ends = so_far.select(F.col(s).alias("_" + s), F.col(part).alias(p), F.col("before").alias(b))
    numbered = numbered.join(ends, F.col(s).eqNullSafe(F.col("_" + s)) & (F.col(part) == F.col(p)))
    extra = (F.col(ordinal) + F.col(b) < F.col(some)).cast("int")
    rest = met.filter(~F.coalesce((h == F.col(edge)) & (size > 0), F.lit(False)))
    return rest.withColumn(name, n).unionByName(numbered.withColumn(name, F.col(passes) + extra).select(*met.columns, name))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs."""
    thin = stage_table(docs.select("doc_id", F.col("source").alias("of"), text_size(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    plan = thresholds(thin.select(F.col("of").alias("source"), "size", "h"), weights, most)
    joined = with_copies(thin, plan, F.col("of"), F.col("h"), F.col("size"), "n")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("n") * F.col("size")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with the columns of docs."""
    thin = stage_table(docs.select("source", text_size(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-sizes")
    n, copy = free_names(docs, "n_copies", "copy")
    joined = with_copies(docs, thresholds(thin, weights, most), F.col("source"), row_hash(F.col("doc_id"), F.col("text")), text_size(F.col("text")), n)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n).cast("int")))).select(*docs.columns)
