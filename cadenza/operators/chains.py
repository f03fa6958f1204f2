"""Chains of jumps: from position 0 of each key, each position's edge to the next one, to the end.

Positions lie in blocks. A block's task finds for each of its positions where the chain through it leaves the block, and
after how many steps; these exits are jumps from block to block, and doubling them finds where the chain enters each
block in a number of joins that is the logarithm of the blocks. Then each block is walked once from its entry. No
task holds more than a block, however long a key's positions are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import staged

BLOCK = 1 << 15


def _exits(table: pa.Table) -> pa.Table:
    """Of each position of a block where its chain goes on outside, and after how many steps; -1 where it ends."""
    idx, after = table.column("idx").to_numpy(), table.column("next").fill_null(-1).to_numpy()
    order = np.argsort(idx, kind="stable")
    idx, after = idx[order], after[order]
    first, stop = int(idx[0]), int(idx[-1]) + 1
    leaves, steps = after.tolist(), [1] * len(idx)
    for i in range(len(idx) - 1, -1, -1):
        n = leaves[i]
        if 0 <= n < stop:
            leaves[i], steps[i] = leaves[n - first], steps[n - first] + 1
    known = pa.array(leaves, pa.int64())
    return pa.table({"key": table.column("key"), "idx": pa.array(idx), "exit": known, "steps": pa.array(steps, pa.int64())})


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows on the chain from their block's entry, numbered from the entry's step on; rows sorted by (key, idx)."""
    here, at, step = object(), None, 0
    for batch in batches:
        keys, blocks, found, steps = batch.column("key"), batch.column("block").to_pylist(), [], []
        columns = (batch.column(c).to_pylist() for c in ("idx", "next", "entry", "step"))
        for row, (key, block, idx, after, entry, first) in enumerate(zip(keys.to_pylist(), blocks, *columns, strict=True)):
            if (key, block) != here:
                here, at, step = (key, block), entry, first
            if idx == at:
                found.append(row)
                steps.append(step)
                at, step = after, step + 1
        rows = pa.array(found, pa.int64())
        yield pa.RecordBatch.from_arrays([keys.take(rows), batch.column("idx").take(rows), pa.array(steps, pa.int64())], ["key", "idx", "step"])


def follow(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, idx, step): the positions on each key's chain from position 0, numbered from 0. edges: (key, idx, next), a
    row for each position 0, 1, 2, ... of a key; next is a later position, or null at the end. They are read several
    times: stage them."""
    kind = dict(edges.dtypes)["key"]
    e = edges.select("key", F.col("idx").cast("long").alias("idx"), F.col("next").cast("long").alias("next"), F.floor(F.col("idx") / block).cast("long").alias("block"))
    entries = e.filter("idx = 0").select("key", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("step"))
    if not e.filter("block > 0").isEmpty():
        long_keys = staged(e.filter("block > 0").select("key").distinct(), "long-keys")
        parts = e.join(long_keys, "key", "left_semi")
        exits = parts.groupBy("key", "block").applyInArrow(_exits, f"key {kind}, idx long, exit long, steps long").filter("exit >= 0")
        jumps = staged(exits, "jumps")
        # Only positions that a chain enters a block at are jumped from.
        heads = jumps.select("key", F.col("exit").alias("idx")).unionByName(entries.select("key", F.col("entry").alias("idx"))).distinct()
        jumps = staged(jumps.join(heads, ["key", "idx"], "left_semi"), "jumps")
        met = staged(entries.join(long_keys, "key", "left_semi"), "entries")
        while True:
            further = met.join(jumps, (met["key"] == jumps["key"]) & (met["entry"] == jumps["idx"])).select(met["key"], jumps["exit"].alias("entry"), (met["step"] + jumps["steps"]).alias("step"))
            grown = staged(met.unionByName(further).distinct(), "entries")
            if grown.count() == met.count():
                break
            met = grown
            a, b = jumps.alias("a"), jumps.alias("b")
            twice = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.exit") == F.col("b.idx"))).select(F.col("a.key").alias("key"), F.col("a.idx").alias("idx"), F.col("b.exit").alias("exit"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
            jumps = staged(twice, "jumps")
        entries = entries.join(long_keys, "key", "left_anti").unionByName(grown)
    entries = entries.withColumn("block", F.floor(F.col("entry") / block).cast("long"))
    rows = e.join(entries, ["key", "block"]).repartition("key", "block").sortWithinPartitions("key", "block", "idx")
    return rows.select("key", "block", "idx", "next", "entry", "step").mapInArrow(_walk, f"key {kind}, idx long, step long")
