"""Exact top-k inner products by no-random-access aggregation.

Every component is a list of candidates in falling order of their contribution: read from its top where the query's
component is positive, from its bottom where it is negative. Lists are read one after the other, those that can
contribute most first, each in order, for a tile of queries at a time. What has been read of a candidate gives its lower
bound (unread lists at their worst value) and its upper bound (unread lists at their head). A candidate goes when its
upper bound can't reach the query's k-th lower bound, or the k-th score of the candidates that the query has met before.
The first list is read only to the depth at which that holds for all that stand below: these are never looked at. Lists
that are left are read for the remaining candidates alone; when few are left their scores are resolved exactly.

Tiles of queries meet ranges of candidates. A task holds its tile, and its candidates stream by in batches, so a range
may be of any length; a tile and a range yield k rows a query, of which the k best stay. All vectors meet all queries:
queries are copied to N / RANGE ranges and candidates to Q / QUERIES tiles, whatever the vectors.

Scores are exact integers; beyond 64 bits they stop at the ends of the range. Defined cases: vectors that are null,
empty, or hold null or non-finite components take no part; vectors of another length than the query's aren't its
candidates; equal scores go to the smaller vec_id; repeated vec_ids are candidates each, none for their own query, whose
vector is the least of them; a query with fewer than k candidates has all of them; other columns than vec_id and
embedding, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

#: Vectors of a range and queries of a tile, about. Small tables have LEAST_RANGE vectors a range, for the cores' sake.
RANGE, QUERIES, LEAST_RANGE = 1 << 20, 1 << 14, 6_000
#: Lists that are read before bounds are first looked at (then twice as many, and so on), and cells of a tile and a batch that are held at a time.
LISTS, CELLS = 8, 1 << 22
OUT = "query_id long, vec_id long, score long"
_MOST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component) of the vectors that take part."""
    e = F.col("embedding")
    good = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("x"))
    return scaled.filter(F.col("vec_id").isNotNull())


class Tile:
    """Queries of one length, and the k best of the candidates that they have met."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.scores = np.zeros((len(ids), k), dtype=np.int64)
        self.found = np.zeros((len(ids), k), dtype=np.int64)
        self.held = np.zeros(len(ids), dtype=np.int64)
        self.reads = 0  # of components, for all queries

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """All queries meet the candidates x, some at a time."""
        most = max(1, CELLS // max(1, len(ids)))
        for lo in range(0, len(self.ids), most):
            self._meet(np.arange(lo, min(len(self.ids), lo + most)), ids, x)

    def _meet(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.q[own].astype(np.float64)
        low, high = x.min(axis=0).astype(np.float64), x.max(axis=0).astype(np.float64)
        sums = max(1.0, np.abs(self.q[own].astype(np.float64)).max() * max(np.abs(low).max(), np.abs(high).max()) * x.shape[1])
        # Whole numbers below 2**53 are exact as floats, whatever order they are summed in.
        exact, slack = sums < 2.0**52, 0.0 if sums < 2.0**52 else sums * 2.0**-46
        heads, worst = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        lists = np.argsort(-(heads - worst).sum(axis=0), kind="stable")
        heads, worst, q = heads[:, lists], worst[:, lists], q[:, lists]
        # What the lists from each one on can contribute at most, and at least.
        heads, worst = (np.c_[np.cumsum(v[:, ::-1], axis=1)[:, ::-1], np.zeros(len(own))] for v in (heads, worst))
        first = x[:, lists[0]]
        order = np.argsort(-first, kind="stable")
        falling = -first[order].astype(np.float64)
        # A query is no candidate of its own.
        by_id = np.argsort(ids, kind="stable")
        begins, ends = (np.searchsorted(ids[by_id], self.ids[own], side) for side in ("left", "right"))
        for down in (True, False):
            sign = np.flatnonzero((q[:, 0] >= 0) == down)
            if not len(sign):
                continue
            floor = self._floor(own[sign]) - slack
            # The first list, to the depth at which what stands below can't qualify for any query.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = (floor - heads[sign, 1]) / q[sign, 0]
            if not np.isfinite(least).all():
                rows = order
            elif down:
                rows = order[: np.searchsorted(falling, -least.min() + 0.5, "right")]
            else:
                rows = order[np.searchsorted(falling, -least.max() - 0.5, "left") :]
            part, read, step = np.zeros((len(sign), len(rows))), 0, LISTS
            place = np.full(len(ids), -1)
            place[rows] = np.arange(len(rows))
            for i in np.flatnonzero(ends[sign] > begins[sign]):
                at = place[by_id[begins[sign[i]] : ends[sign[i]]]]
                part[i, at[at >= 0]] = -np.inf
            while len(sign) and len(rows):
                more = lists[read : read + step]
                part += q[sign, read : read + step] @ x[np.ix_(rows, more)].astype(np.float64).T
                step *= 2
                self.reads += len(sign) * len(rows) * len(more)
                read += len(more)
                floor = self._floor(own[sign])
                new = np.flatnonzero(np.isneginf(floor))
                if len(new) and len(rows) >= self.k:
                    floor[new] = np.partition(part[new], len(rows) - self.k, axis=1)[:, len(rows) - self.k] + worst[sign[new], read]
                open_ = part >= np.maximum(floor - slack - heads[sign, read], -1e300)[:, None]
                left = open_.sum(axis=1)
                done = (left <= max(4 * self.k, len(ids) // 64)) | (read == len(lists))
                for i in np.flatnonzero(done):
                    at = np.flatnonzero(open_[i])
                    self._resolve(own[sign[i]], ids, x, rows[at], part[i, at], lists[read:], exact)
                if done.any():
                    sign, part, open_ = sign[~done], part[~done], open_[~done]
                keep = open_.any(axis=0)
                if keep.mean() < 0.8:
                    rows, part = rows[keep], part[:, keep]

    def _floor(self, own: np.ndarray) -> np.ndarray:
        """The scores that candidates of these queries must reach."""
        return np.where(self.held[own] == self.k, self.scores[own, self.k - 1].astype(np.float64), -np.inf)

    def _resolve(self, i: int, ids: np.ndarray, x: np.ndarray, rows: np.ndarray, part: np.ndarray, unread: np.ndarray, exact: bool) -> None:
        """The scores of these candidates of a query, and its k best of them and those it had."""
        if not len(rows):
            return
        if exact:
            scores = (part + x[np.ix_(rows, unread)].astype(np.float64) @ self.q[i, unread].astype(np.float64)).astype(np.int64)
            self.reads += len(rows) * len(unread)
        else:
            scores = np.array([max(-_MOST - 1, min(_MOST, int(v))) for v in x[rows].astype(object) @ self.q[i].astype(object)], dtype=np.int64)
        n, own = self.held[i], ids[rows]
        if n == self.k:  # of many ties most go here
            keep = (scores > self.scores[i, -1]) | (scores == self.scores[i, -1]) & (own < self.found[i, -1])
            scores, own = scores[keep], own[keep]
        scores, found = np.r_[self.scores[i, :n], scores], np.r_[self.found[i, :n], own]
        best = np.lexsort((found, ~scores))[: self.k]  # ~ turns the order round for every whole number
        self.held[i] = len(best)
        self.scores[i, : len(best)], self.found[i, : len(best)] = scores[best], found[best]


def _run(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (d, tile, part, is_candidate): each tile's queries, then its candidates, batch by batch."""
    key, tile, asked = None, None, []

    def best(tile: Tile | None) -> Iterator[pa.RecordBatch]:
        if tile is not None and tile.held.any():
            at = np.arange(k)[None] < tile.held[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.repeat(tile.ids, tile.held), tile.found[at], tile.scores[at])], ["query_id", "vec_id", "score"])

    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("d", "tile", "part", "is_candidate")])
        starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi == lo:
                continue
            own = tuple(keys[:3, lo].tolist())
            if own != key:
                yield from best(tile)
                key, tile, asked = own, None, []
            ids = batch.column("vec_id").slice(lo, hi - lo).to_numpy()
            x = batch.column("x").slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
            if not keys[3, lo]:
                asked.append((ids, x))
                continue
            if tile is None and asked:
                tile = Tile(np.concatenate([i for i, _ in asked]), np.concatenate([v for _, v in asked]), k)
            if tile is not None:
                tile.meet(ids, x)
    yield from best(tile)


def topk(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row whose vec_id is divisible by `every`."""
    x = stage_table(quantised(vectors, scale), "topk-vectors")
    is_query = F.col("vec_id") % every == 0
    sizes = x.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("m")).first()
    parts = max(1, -(-sizes["n"] // RANGE), min(64, -(-sizes["n"] // LEAST_RANGE)))
    tiles = max(1, -(-sizes["m"] // QUERIES))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = x.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    queries = asked.select("vec_id", "x", block(tiles, 2).alias("tile"), each(parts).alias("part"), F.lit(False).alias("is_candidate"))
    candidates = x.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).cast("int").alias("part"), each(tiles).alias("tile"), F.lit(True).alias("is_candidate"))
    rows = queries.unionByName(candidates).withColumn("d", F.size("x"))
    dealt = rows.repartition(parts * tiles, "tile", "part").sortWithinPartitions("d", "tile", "part", "is_candidate")
    met = stage_table(dealt.mapInArrow(lambda batches: _run(batches, k), OUT), "topk-met")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
