"""Ranking of candidates: parsed rankings, rank scores, text duplicates, diversity, final scores, shortlists."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.json_recovery import model_ranks
from ..functions.text import cosine, lexical_similarity, tokens, trigrams, unit
from ..plans.stages import staged
from . import greedy
from .boundaries import duration_fit, weighted_total

SIMILAR = 0.27
SHORTLIST = 20


def parse_rankings(responses: DataFrame) -> DataFrame:
    """(transcript_id, id, rank) of ranking answers (transcript_id, text, candidate_count): the first entry of each
    candidate counts, unknown ones go, those left out follow the worst rank in order. An answer that doesn't parse
    ranks nothing."""
    read = responses.select("transcript_id", "candidate_count", model_ranks(F.col("text")).alias("m")).filter("m.error is null")
    entries = read.select("transcript_id", "candidate_count", F.explode("m.items").alias("e")).select("transcript_id", "candidate_count", "e.*")
    known = entries.filter((F.col("id") >= 0) & (F.col("id") < F.col("candidate_count")))
    firsts = known.groupBy("transcript_id", "id").agg(F.min(F.struct("n", "rank")).alias("e")).select("transcript_id", "id", "e.n", "e.rank")
    order = Window.partitionBy("transcript_id").orderBy("n")
    firsts = firsts.withColumn("rank", F.coalesce("rank", F.row_number().over(order)))
    every = read.filter("candidate_count > 0").select("transcript_id", F.explode(F.sequence(F.lit(0), F.col("candidate_count") - 1)).alias("id"))
    missing = every.join(firsts.select("transcript_id", "id"), ["transcript_id", "id"], "left_anti")
    worst = read.select("transcript_id").join(firsts.groupBy("transcript_id").agg(F.max("rank").alias("worst")), "transcript_id", "left")
    behind = missing.join(worst, "transcript_id").withColumn("rank", F.coalesce("worst", F.lit(0)) + F.row_number().over(Window.partitionBy("transcript_id").orderBy("id")))
    return firsts.select("transcript_id", F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"), F.col("n").cast("long").alias("n")).unionByName(
        behind.select("transcript_id", F.col("id").cast("long").alias("id"), F.col("rank").cast("long").alias("rank"), (F.lit(1 << 20) + F.col("id")).cast("long").alias("n"))
    )


def ranking_problems(responses: DataFrame) -> DataFrame:
    """(transcript_id, n, problem) of ranking answers: one that doesn't parse, entries of unknown or repeated candidates,
    how many are left out. n: the entry's place, the count of left-out ones last."""
    read = responses.select("transcript_id", "candidate_count", model_ranks(F.col("text")).alias("m"))
    unread = read.filter("m.error is not null").select("transcript_id", F.lit(-1).alias("n"), F.col("m.error").alias("problem"))
    e = read.filter("m.error is null").select("transcript_id", "candidate_count", F.posexplode_outer("m.items").alias("pos", "e"))
    known = F.col("e.id").between(0, F.col("candidate_count") - 1)
    seen = F.row_number().over(Window.partitionBy("transcript_id", "e.id").orderBy("pos"))
    e = e.withColumn("seen", seen).select("transcript_id", "candidate_count", F.col("pos").alias("n"), F.col("e.id").alias("id"), known.alias("known"), "seen")
    # The texts of problems are part of the result.
    entry = F.when(~F.col("known"), F.format_string("rank refers to unknown candidate %d", F.col("id"))).when(F.col("seen") > 1, F.format_string("candidate %d ranked twice", F.col("id")))
    entries = e.withColumn("problem", entry).filter("problem is not null").select("transcript_id", "n", "problem")
    left = e.groupBy("transcript_id", "candidate_count").agg((F.col("candidate_count") - F.count_distinct(F.when(F.col("known"), F.col("id")))).alias("left"))
    out = left.filter("left > 0").select("transcript_id", F.lit((1 << 31) - 1).alias("n"), F.format_string("%d candidate(s) left unranked", F.col("left")).alias("problem"))
    return unread.unionByName(entries).unionByName(out)


def rank_scores(ranked: DataFrame, *order: Column) -> DataFrame:
    """rerank_score from 1 for the first to 0 for the last of each transcript; a lone one has 1."""
    w = Window.partitionBy("transcript_id")
    n = F.count(F.lit(1)).over(w)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return ranked.withColumn("rerank_score", F.when(n == 1, F.lit(1.0)).otherwise(1.0 - place / F.greatest(n - 1, F.lit(1))))


def shortlist(candidates: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """The best `most` candidates of each transcript by normalised score."""
    order = Window.partitionBy("transcript_id").orderBy(F.desc("normalized_score"), "ord")
    return candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def diversity(candidates: DataFrame) -> DataFrame:
    """diversity: 1 for the best of a category, less for each after it."""
    order = Window.partitionBy("transcript_id", "category").orderBy(F.desc("rerank_score"), "ord")
    return candidates.withColumn("diversity", 1.0 / (1.0 + 0.75 * (F.row_number().over(order) - 1)))


def final_scores(candidates: DataFrame, min_ms: int = 25_000, max_ms: int = 60_000, weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates with duration_fit, diversity and final_score, the weighted mean of five components."""
    weights = weights or lexicon.SCORING_WEIGHTS
    c = diversity(candidates).withColumn("duration_fit", duration_fit(F.col("end_ms") - F.col("start_ms"), min_ms, max_ms, gated=False))
    parts = {"llm_score": "normalized_score", "rerank": "rerank_score", "boundary": "boundary_hint", "duration_fit": "duration_fit", "diversity": "diversity"}
    return c.withColumn("final_score", weighted_total(weights, parts))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("tokens", tokens(F.col(text))).withColumn("grams", trigrams(F.col(text)))


#: Where trigrams reach this share (or half of what is asked for, if less), pairs meet by trigrams; else by words, which
#: must then make up the rest.
GRAM_SHARE = 0.5


def _rarest_first(f: DataFrame, group: str, key: str, column: str, least: float, name: str) -> DataFrame:
    """(group, key, item, size, place): a row's set items, those of the fewest rows of its group first.

    place counts from 0; an item is one of the prefix where place <= size - ceil(size * least)."""
    each = f.select(group, key, F.size(column).alias("size"), F.explode(column).alias("item"))
    seen = each.groupBy(group, "item").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # What no other row has links nothing, but counts among a row's first ones.
    each = each.join(seen, [group, "item"], "left")
    place = F.row_number().over(Window.partitionBy(group, key).orderBy(F.coalesce("rows", F.lit(0)), "item")) - 1
    dealt = each.withColumn("place", place).withColumn("prefix", F.col("place") <= F.col("size") - F.ceil(F.col("size") * least))
    return staged(dealt.filter("rows is not null").select(group, key, "item", "size", "prefix"), name)


def _met(dealt: DataFrame, group: str, key: str, both: bool) -> DataFrame:
    """Pairs (a < b) of rows that share an item in the prefix of the one with fewer items (`both`: of either one)."""
    a = dealt.filter("prefix").select(group, "item", F.col(key).alias("x"), F.col("size").alias("nx"))
    b = (dealt.filter("prefix") if both else dealt).select(group, "item", F.col(key).alias("y"), F.col("size").alias("ny"))
    met = a.join(b, [group, "item"]).filter((F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny")))
    return met.select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(items: DataFrame, group: str, key: str, text: str, least: float = SIMILAR, digits: int | None = 6) -> DataFrame:
    """(group, a, b, similarity) of the pairs a < b of each group of texts with a similarity of `least` (above 0) or more,
    after rounding to digits (None: as it is).

    Either trigrams alone are alike by GRAM_SHARE, or words make up for what then lacks. The first share a trigram among
    the rarest of each, the second a word among the rarest ones of the text with fewer words: what is frequent in a group
    brings no pairs together but those of texts that have little else. Each pair is scored once."""
    f = staged(text_features(items.select(group, key, text), text).select(group, key, "tokens", "grams"), "similar-features")
    slack = least - 10.0 ** -(digits or 9)
    grams = min(GRAM_SHARE, slack / 0.6)
    # 0.7 * (0.45 * jaccard + 0.55 * overlap) <= 0.7 * overlap: the least overlap that words need beside the trigrams.
    share = (slack - 0.3 * grams) / 0.7
    words = _met(_rarest_first(f, group, key, "tokens", share - 1e-9, "similar-tokens"), group, key, False)
    pairs = words.unionByName(_met(_rarest_first(f, group, key, "grams", grams - 1e-9, "similar-grams"), group, key, True)).distinct()
    side = lambda n: f.select(group, F.col(key).alias(n), F.col("tokens").alias(f"tokens_{n}"), F.col("grams").alias(f"grams_{n}"))
    scored = pairs.join(side("a"), [group, "a"]).join(side("b"), [group, "b"])
    s = lexical_similarity(F.col("tokens_a"), F.col("tokens_b"), F.col("grams_a"), F.col("grams_b"))
    return scored.select(group, "a", "b", (s if digits is None else F.round(s, digits)).alias("similarity")).filter(F.col("similarity") >= least)


#: How alike two items are, by backend: of their words and letters, or of their vectors.
SIMILARITY = {
    "lexical": lambda a, b: lexical_similarity(a["tokens"], b["tokens"], a["grams"], b["grams"]),
    "embedding": lambda a, b: cosine(a["embedding"], b["embedding"]),
}


def similarity_backend(name: str, columns: list[str]) -> str:
    """The backend of a name; "embedding" falls back to "lexical" where there are no vectors."""
    if name not in SIMILARITY:
        raise ValueError(f"unknown similarity backend {name!r}: {' or '.join(SIMILARITY)}")
    return "lexical" if name == "embedding" and "embedding" not in columns else name


def similar_conflicts(ranked: DataFrame, threshold: float, text: str, backend: str) -> DataFrame:
    """(group, better, worse, similarity) of ranked candidates (transcript_id, rank, ...) alike by the threshold or more.

    By words and trigrams, pairs meet through what they share; vectors are compared within a transcript, whose shortlist
    is short."""
    name = similarity_backend(backend, ranked.columns)
    if name == "lexical":
        pairs = similar_pairs(ranked, "transcript_id", "rank", text, threshold, None)
    else:
        side = lambda n: ranked.select("transcript_id", F.col("rank").alias(n), F.struct("embedding").alias(f"v_{n}"))
        pairs = side("a").join(side("b"), "transcript_id").filter("a < b").select("transcript_id", "a", "b", SIMILARITY[name](F.col("v_a"), F.col("v_b")).alias("similarity")).filter(F.col("similarity") >= threshold)
    return pairs.select(F.col("transcript_id").alias("group"), F.col("a").alias("better"), F.col("b").alias("worse"), "similarity")


def _best_first(candidates: DataFrame) -> DataFrame:
    return staged(greedy.ranked(candidates, "transcript_id", F.desc("rerank_score"), F.desc("normalized_score"), F.col("ord")), "ranked")


def drop_similar(candidates: DataFrame, threshold: float = SIMILAR, text: str = "text", backend: str = "lexical", **how) -> DataFrame:
    """(transcript_id, ord) of the candidates that stay when each that resembles a better one that stays is dropped;
    best by (rerank_score, normalized_score), then ord."""
    ranked = _best_first(candidates)
    return greedy.survivors(ranked, "transcript_id", similar_conflicts(ranked, threshold, text, backend), **how).select("transcript_id", "ord")


def similarity_notes(candidates: DataFrame, threshold: float = SIMILAR, text: str = "text", backend: str = "lexical", **how) -> DataFrame:
    """(transcript_id, ord, note) of the candidates that drop_similar() drops: the best one that stays and that each
    resembles. candidates also have hook and start_ms."""
    ranked = _best_first(candidates)
    conflicts = staged(similar_conflicts(ranked, threshold, text, backend), "similar")
    gone = staged(greedy.removed(conflicts, **how), "removed")
    kept = conflicts.join(gone.select("group", F.col("worse").alias("better")), ["group", "better"], "left_anti")
    first = kept.join(gone, ["group", "worse"]).groupBy("group", "worse").agg(F.min(F.struct("better", "similarity")).alias("m")).select(F.col("group").alias("transcript_id"), F.col("worse").alias("rank"), "m.better", "m.similarity")
    side = lambda rank, hook, at, *more: ranked.select("transcript_id", F.col("rank").alias(rank), F.col("hook").alias(hook), (F.col("start_ms") / 1000).alias(at), *more)
    met = first.join(side("rank", "hook", "at", "ord"), ["transcript_id", "rank"]).join(side("better", "other", "other_at"), ["transcript_id", "better"])
    # Fixed value: the text of the note is part of the result.
    note = F.format_string("dropped '%s' at %.0fs — %.0f%% similar to '%s' at %.0fs", "hook", "at", F.col("similarity") * 100, "other", "other_at")
    return met.select("transcript_id", "ord", note.alias("note"))


#: Vectors and queries of a task's tile, and queries of one product.
TILE_VECTORS, TILE_QUERIES, STRIP = 8_192, 1_024, 128
MILLION = 1_000_000


def _matrices(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of lists of doubles, by their length; lists that are null or hold nulls aren't in it."""
    lists = column.combine_chunks()
    sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = lists.flatten()
    ends = np.cumsum(sizes)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    lacks = np.zeros(len(sizes), dtype=bool)
    lacks[rows[values.is_null().to_numpy(zero_copy_only=False)]] = True
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[(sizes > 0) & ~lacks]).tolist():
        these = np.flatnonzero((sizes == n) & ~lacks)
        out[n] = these, flat[(ends[these] - n)[:, None] + np.arange(n)]
    return out


def _millionths(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows, 0 at least, in millionths rounded half up; what isn't a number is above all.

    A product that lies at a half but for its last bits is summed anew from the first component on, as Spark does."""
    x = np.maximum(q @ v.T, 0.0) * MILLION
    out = np.floor(x + 0.5)
    a, b = np.nonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6)
    if len(a):
        exact = np.zeros(len(a))
        for j in range(q.shape[1]):
            exact += q[a, j] * v[b, j]
        each, at = np.unique(exact, return_inverse=True)
        out[a, b] = np.array([int(Decimal(repr(e)).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP)) for e in np.maximum(each, 0.0).tolist()])[at]
    return np.where(np.isnan(x), 2 * MILLION, out).astype(np.int64)


def _tile_best(most: int):
    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("vec_id")
        ids, asked = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        n, found = len(ids), []
        have, want = _matrices(vectors["unit"]), _matrices(queries["q"])
        for low in range(0, len(asked) if n else 0, STRIP):
            some = asked[low : low + STRIP]
            score = np.zeros((len(some), n), dtype=np.int64)
            for size in have.keys() & want.keys():
                at = want[size][0]
                mine = slice(*np.searchsorted(at, (low, low + STRIP)))
                if mine.stop > mine.start:
                    score[np.ix_(at[mine] - low, have[size][0])] = _millionths(want[size][1][mine], have[size][1])
            # One number tells score and place: vectors lie in order of vec_id.
            key = np.where(ids[None, :] == some[:, None], np.int64(-1), score * n + (n - 1 - np.arange(n)))
            top = np.argpartition(key, -most, axis=1)[:, -most:] if n > most else np.broadcast_to(np.arange(n), key.shape)
            kept = np.take_along_axis(key, top, axis=1)
            a, b = np.nonzero(kept >= 0)
            found.append((some[a], ids[top[a, b]], kept[a, b] // n))
        query, vec, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return pa.table({"query_id": query, "vec_id": vec, "similarity": np.where(s == 2 * MILLION, np.nan, s / MILLION)})

    return best


def most_alike(vectors: DataFrame, queries: DataFrame, most: int = 3, tile: tuple[int, int] = (TILE_VECTORS, TILE_QUERIES)) -> DataFrame:
    """(query_id, rank, vec_id, similarity): for each of a stated set of query vectors its most alike other vectors.

    vectors and queries: (vec_id, embedding). Every query meets every vector, in tiles of both that are products of
    matrices, keeps the best of the tile, and then the best of those."""
    blocks, strips = (max(1, -(-n // size)) for n, size in zip((vectors.count(), queries.count()), tile, strict=True))
    dealt = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    doubles = lambda name: unit(F.col("embedding")).cast("array<double>").alias(name)
    v = vectors.filter("vec_id is not null").select("vec_id", doubles("unit"), dealt(blocks, "block"), each(strips, "strip"))
    q = queries.filter("vec_id is not null").select(F.col("vec_id").alias("query_id"), doubles("q"), dealt(strips, "strip"), each(blocks, "block"))
    kinds = f"query_id {dict(queries.dtypes)['vec_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, similarity double"
    scored = v.groupBy("block", "strip").cogroup(q.groupBy("block", "strip")).applyInArrow(_tile_best(most), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).select("query_id", "rank", "vec_id", "similarity")
