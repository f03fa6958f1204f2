"""Greedy removal over a sparse graph of conflicts: in order of rank an item stays unless a better one that stays
conflicts with it.

Rounds of joins: an item without a better open neighbour stays, and its neighbours go; both leave the graph, and what is
left is a smaller one. Where the graph is small, or long chains let a round settle little, the rest is one ordered pass
over each group's conflicts, sorted by Spark, which remembers only the items that went."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import staged

#: Conflicts that the ordered pass takes over at once; rounds before it takes over whatever is left.
FINISH, MOST_ROUNDS = 1_000_000, 12


def _passes_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The items that go, of conflicts sorted by (group, worse)."""
    group, worse, gone, hit = object(), None, set(), False
    for batch in batches:
        groups, ranks = [], []
        for g, a, b in zip(*(batch.column(c).to_pylist() for c in ("group", "better", "worse")), strict=True):
            if g != group:
                group, worse, gone = g, None, set()
            if b != worse:
                worse, hit = b, False
            if not hit and a not in gone:
                hit = True
                gone.add(b)
                groups.append(g)
                ranks.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(groups, batch.schema.field("group").type), pa.array(ranks, pa.int64())], ["group", "worse"])


def _ordered_pass(conflicts: DataFrame) -> DataFrame:
    rows = conflicts.repartition("group").sortWithinPartitions("group", "worse")
    return rows.mapInArrow(_passes_over, f"group {dict(conflicts.dtypes)['group']}, worse long")


def removed(conflicts: DataFrame, finish: int = FINISH, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(group, worse): the items that a greedy pass by rank removes. conflicts: (group, better, worse), each pair once,
    better < worse; groups don't meet. Items without a conflict aren't in it, and stay."""
    left, gone, rounds = staged(conflicts.select("group", F.col("better").cast("long").alias("better"), F.col("worse").cast("long").alias("worse")), "conflicts"), None, 0
    while rounds < most_rounds and left.count() > finish:
        stays = left.select("group", "better").distinct().join(left.select("group", F.col("worse").alias("better")).distinct(), ["group", "better"], "left_anti")
        goes = staged(left.join(stays, ["group", "better"], "left_semi").select("group", "worse").distinct(), "removed")
        gone = goes if gone is None else gone.unionByName(goes)
        open_ = left.join(goes, ["group", "worse"], "left_anti").join(goes.select("group", F.col("worse").alias("better")), ["group", "better"], "left_anti")
        left, rounds = staged(open_.select("group", "better", "worse"), "conflicts"), rounds + 1
    last = _ordered_pass(left)
    return last if gone is None else gone.unionByName(last)


def ranked(items: DataFrame, group: str, *order) -> DataFrame:
    """items with `rank`, their place in the group's order from 0; order must end in what tells items apart."""
    return items.withColumn("rank", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))


def survivors(items: DataFrame, group: str, conflicts: DataFrame, **how) -> DataFrame:
    """The items (group, rank, ...) that stay; conflicts: (group, better, worse) by rank."""
    gone = removed(conflicts, **how).select(F.col("group").alias(group), F.col("worse").alias("rank"))
    return items.join(gone, [group, "rank"], "left_anti")
