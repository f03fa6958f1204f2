"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

1. One scan gives each document the signature of its set of word n-grams, and counts n-grams in a table of hash buckets
   of fixed size. Documents of equal sets are one class; a class goes on once.
2. Each class orders its n-grams by (bucket count, hash), rare first, an order that all classes share. Two sets of
   sufficient overlap share an n-gram within the first size - ceil(threshold * size) + 1 of each, so only these prefixes
   are dealt out by n-gram, and only n-grams that more than one class has stay.
3. First each n-gram's classes are paired with one of them, its hub: pairs that pass the length and positional filters
   are verified once. The links give provisional components. Then every n-gram whose classes lie in more than one
   component pairs the classes outside its largest component with all others. These pairs, filtered likewise, travel
   as (class, block of one component, members) and are verified until one member links: further members of one
   component can't change the result. So a large group of near copies never becomes all its pairs, and no link between
   components is lost.
4. Components come from links by contraction: every vertex moves to the least of its neighbours, until no edge is left.

Sets are one class if two 64-bit signatures agree; the first names the class, and should it be that of two sets, all of
them are signed anew. N-grams are known by 64-bit hashes. Defined cases: a null or blank text has an empty set, links
with nothing and is its own component; fewer than k words are one n-gram, the whole sequence; equal rows share a class;
rows that share a doc_id are documents of their own, each with its own text; a null doc_id takes no part and has a null
component; other columns than doc_id and text, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_names, mixed, shingle_hashes, stage_table, text_bytes, text_slices

#: The bucket table that orders n-grams: 2**BUCKET_BITS counts, dealt out in chunks of 2**CHUNK_BITS.
BUCKET_BITS = 20
CHUNK_BITS = 14
#: N-grams counted more often than this are dealt out by n-gram and class, not by n-gram alone.
HOT_COUNT = 1 << 17
#: Classes that are verified against as one block, and classes that meet a block in one task.
BLOCK = 128
TASK_ROWS = 2_000
#: Classes of an n-gram that one task pairs with the classes outside the n-gram's largest component.
SLICE = 4_096


def row_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct n-gram hashes, their rows ascending, set size of each row) of a batch's texts."""
    data, offsets = text_bytes(batch.column("text"))
    hashes, rows = shingle_hashes(data, offsets, k)
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")] if batch.num_rows <= 65_536 else np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[keep], rows[keep]
    return hashes, rows, np.bincount(rows, minlength=batch.num_rows)


def signatures(hashes: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit signature of each row's set, another one for each seed."""
    sums = np.r_[np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D * (2 * seed + 1) % (1 << 64))), dtype=np.uint64)]
    ends = np.cumsum(sizes)
    return mixed((sums[ends] - sums[ends - sizes]) ^ mixed(sizes.astype(np.uint64))).astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
    names = ["doc_id", "n_shingles", "node", "proof", "chunk", "counts"]
    for whole in batches:
        for batch in text_slices(whole, "text"):
            hashes, _, sizes = row_sets(batch, k)
            counts += np.bincount((hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            signed = (pa.array(signatures(hashes, sizes, s), mask=sizes == 0) for s in (seed, seed + 1))
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *signed, *none], names)
    chunks = [c for c in range(1 << (BUCKET_BITS - CHUNK_BITS)) if counts[c << CHUNK_BITS : (c + 1) << CHUNK_BITS].any()]
    packed = [zlib.compress(counts[c << CHUNK_BITS : (c + 1) << CHUNK_BITS].tobytes(), 1) for c in chunks]
    none = pa.nulls(len(chunks), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], names)


def _signed(batches: Iterator[pa.RecordBatch], k: int, seed: int, name: str) -> Iterator[pa.RecordBatch]:
    """The rows, each with the class of its text as the last column."""
    for whole in batches:
        for batch in text_slices(whole, "text"):
            hashes, _, sizes = row_sets(batch, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signatures(hashes, sizes, seed), mask=sizes == 0)], [*batch.schema.names, name])


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            more = np.frombuffer(zlib.decompress(counts), dtype=np.uint32)
            sums[chunk] = np.minimum(sums.get(chunk, np.uint64(0)) + more.astype(np.uint64), np.uint64(0xFFFFFFFF))
    packed = [zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def bucket_table(scanned: DataFrame) -> np.ndarray:
    """Of each bucket, the logarithm of its count in 1/2048ths: 2**BUCKET_BITS numbers of 16 bits, whatever the input."""
    rows = scanned.filter(F.col("chunk").isNotNull()).select("chunk", "counts")
    part = rows.repartition(64, F.col("chunk"), F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(_add_counts, "chunk int, counts binary")
    table = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
    for row in part.repartition(64, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").toLocalIterator():
        table[row["chunk"] << CHUNK_BITS : (row["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.uint32)
    return np.floor(2047 * np.log2(1.0 + table)).astype(np.uint16)


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, percent: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams (token, node, at) of each class's prefix; at: size, place, and a sign where the n-gram is hot."""
    hot = np.uint16(2047 * np.log2(1.0 + HOT_COUNT))
    for whole in batches:
        for batch in text_slices(whole, "text"):
            hashes, rows, sizes = row_sets(batch, k)
            rank = table[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")] if batch.num_rows <= 65_536 else order[np.argsort(rows[order], kind="stable")]
            hashes, rank, rows = hashes[order], rank[order], rows[order]
            place = np.arange(len(hashes)) - (np.cumsum(sizes) - sizes)[rows]
            size = sizes[rows]
            keep = place <= size - (percent * size + 99) // 100
            where = (size[keep].astype(np.int64) << 32) | place[keep]
            where[rank[keep] >= hot] |= np.int64(-(1 << 63))
            node = batch.column("node").to_numpy(zero_copy_only=False)[rows[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep].view(np.int64)), pa.array(node), pa.array(where)], ["token", "node", "at"])


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, those whose token stands in another row, or is hot."""
    held = None
    none = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["token", "node", "at"])
    for batch in _with_end(batches, none):
        token, node, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        last = not len(token)
        if held is not None:
            token, node, at, alike = np.r_[held[0], token], np.r_[held[1], node], np.r_[held[2], at], held[3]
        else:
            alike = False
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        keep = np.r_[alike, same] | np.r_[same, False] | (at < 0)
        stop = len(token) if last else len(token) - 1
        held = None if last else (token[-1:], node[-1:], at[-1:], bool(same[-1]) if len(same) else alike)
        k = np.flatnonzero(keep[:stop])
        where = at[k] & np.int64((1 << 63) - 1)
        if len(k):
            columns = (token[k], node[k], where >> 32, where & np.int64(0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "size", "place"])


def _with_end(batches: Iterator[pa.RecordBatch], end: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from batches
    yield end


def least_overlap(size, other, percent: int):
    """The overlap from which 100 * overlap >= percent * union."""
    return (percent * (size + other) + 99 + percent) // (100 + percent)


def could_link(s, t, i, j, percent: int):
    """Length and positional filter for sets of sizes s, t that share the n-grams at places i, j."""
    small, large = F.least(s, t), F.greatest(s, t)
    most = F.least(F.least(i, j) + 1 + F.least(s - i - 1, t - j - 1), small)
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (s + t))


def _crossing(c: dict[str, np.ndarray], cuts: np.ndarray, percent: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """(x, blk, y) columns of whole groups: each probe by each member of its group, as far as the filters let them.

    Members stand in order of size, so a probe is paired only with those that the length filter lets through."""
    starts = np.r_[0, cuts[cuts < len(c["token"])]].astype(np.int64)
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c["token"])]))
    probe = c["probe"].astype(bool)
    members, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
    sizes = (group[members] << 32) | c["size"][members]
    of, own = group[probes] << 32, c["size"][probes]
    first = np.searchsorted(sizes, of | ((percent * own + 99) // 100), "left")
    widths = np.searchsorted(sizes, of | (100 * own // percent), "right") - first
    ends = np.cumsum(widths)
    lo = 0
    while lo < len(probes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        width = widths[lo:hi]
        a = np.repeat(probes[lo:hi], width)
        b = members[np.repeat(first[lo:hi], width) + np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)]
        # Two outsiders meet twice; the pair is taken where x < y.
        ok = np.flatnonzero((c["comp"][a] != c["comp"][b]) & (c["big"][b].astype(bool) | (c["node"][a] < c["node"][b])))
        a, b = a[ok], b[ok]
        s, t, i, j = c["size"][a], c["size"][b], c["place"][a], c["place"][b]
        overlap = np.minimum(np.minimum(i, j) + np.minimum(s - i, t - j), np.minimum(s, t))
        ok = (100 + percent) * overlap >= percent * (s + t)
        if ok.any():
            yield np.stack([c["node"][a[ok]], c["blk"][b[ok]], c["node"][b[ok]]])
        lo = hi


def _unique(found: list[np.ndarray]) -> np.ndarray:
    """The distinct columns, ascending."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]] if rows.shape[1] else rows


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[at, len(values)].astype(np.int32)), pa.array(values))


def _by_class(found: np.ndarray) -> pa.RecordBatch:
    """Rows (x, blks, ys) of distinct (x, blk, y) columns."""
    x, blk, y = found
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return pa.RecordBatch.from_arrays([pa.array(x[at]), _lists(blk, at), _lists(y, at)], ["x", "blks", "ys"])


def _cross(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, slice, probe, size), candidates (x, blks, ys): x of another component than each y in its blk."""
    names = ("token", "slice", "probe", "node", "comp", "blk", "big", "size", "place")
    held: dict[str, np.ndarray] = {n: np.zeros(0, np.int64) for n in names}
    found: list[np.ndarray] = []
    for batch in _with_end(batches, None):
        if batch is not None:
            held = {n: np.r_[held[n], batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)] for n in names}
        n = len(held["token"])
        cuts = np.flatnonzero((held["token"][1:] != held["token"][:-1]) | (held["slice"][1:] != held["slice"][:-1])) + 1
        stop = n if batch is None else int(cuts[-1]) if len(cuts) else 0
        if stop:
            found += _crossing({m: v[:stop] for m, v in held.items()}, cuts[cuts < stop], percent)
            held = {m: v[stop:] for m, v in held.items()}
        if sum(f.shape[1] for f in found) > 1 << 20:
            found = [_unique(found)]
            if found[0].shape[1] > 1 << 19:
                yield _by_class(found[0])
                found = []
    if found:
        yield _by_class(_unique(found))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From _cross()'s rows sorted by x, distinct rows (blk, x, ys)."""
    held = np.zeros((3, 0), dtype=np.int64)
    for batch in _with_end(batches, None):
        if batch is not None:
            x = np.repeat(batch.column("x").to_numpy(), pc.list_value_length(batch.column("ys")).to_numpy())
            flat = (batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("blks", "ys"))
            held = np.concatenate([held, np.stack([x, *flat])], axis=1)
        # Rows of the last x may go on in the next batch.
        stop = held.shape[1] if batch is None else int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
        if stop:
            x, blk, y = _unique([held[:, :stop]])
            held = held[:, stop:]
            at = np.flatnonzero(np.r_[True, (blk[1:] != blk[:-1]) | (x[1:] != x[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(blk[at]), pa.array(x[at]), _lists(y, at)], ["blk", "x", "ys"])


def suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the overlap of two sorted sets: by ranges of hashes, the smaller of the two counts."""
    bins = max(1, 1 << max(0, len(a) // 2).bit_length())
    shift = np.uint64(64 - max(1, bins.bit_length() - 1))
    size = 1 << max(1, bins.bit_length() - 1)
    return int(np.minimum(np.bincount((a >> shift).astype(np.int64), minlength=size), np.bincount((b >> shift).astype(np.int64), minlength=size)).sum())


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sets of distinct hashes link."""
    least = least_overlap(len(a), len(b), percent)
    if min(len(a), len(b)) < least or suffix_bound(a, b) < least:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (blk, salt, is_x): first a block's members, then the classes that meet it. A class gets one
    link at most to each component."""
    key, members = None, {}
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 20):
            hashes, _, sizes = row_sets(batch, k)
            ends = np.cumsum(sizes)
            c = {n: batch.column(n).to_pylist() for n in ("blk", "salt", "is_x", "node", "comp", "ys")}
            found = []
            for i in range(batch.num_rows):
                if (c["blk"][i], c["salt"][i]) != key:
                    key, members = (c["blk"][i], c["salt"][i]), {}
                own = hashes[ends[i] - sizes[i] : ends[i]]
                if not c["is_x"][i]:
                    members[c["node"][i]] = own.copy(), c["comp"][i]
                    continue
                linked = set()
                for y in c["ys"][i]:
                    other, comp = members.get(y, (None, None))
                    if other is not None and comp not in linked and links(own, other, percent):
                        linked.add(comp)
                        found.append((c["node"][i], y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])


def verified(candidates: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) among candidates (blk, x, ys), a row for each blk and x, with members (blk, node, comp) and texts (node, text)."""
    salts = candidates.groupBy("blk").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("salts"))
    xs = candidates.join(salts, "blk").select("blk", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("is_x"), F.col("x").alias("node"), F.lit(None).cast("long").alias("comp"), "ys")
    none = F.lit(None).cast("array<long>")
    own = members.join(salts, "blk").select("blk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("is_x"), "node", "comp", none.alias("ys"))
    rows = xs.unionByName(own).join(texts, "node").select("blk", "salt", "is_x", "node", "comp", "ys", "text")
    dealt = rows.repartition("blk", "salt").sortWithinPartitions("blk", "salt", "is_x")
    return stage_table(dealt.mapInArrow(lambda batches: _verify(batches, k, percent), "a long, b long"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes that edges (a, b) join; comp is one of the nodes."""
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stage_table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "jaccard-moves")
        if labels is None:
            labels = moves.withColumnRenamed("to", "comp")
        else:
            labels = labels.join(moves.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = stage_table(labels, "jaccard-labels")
        left = edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("c")), "a").join(moves.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
        edges = stage_table(left.filter("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "jaccard-edges")
        if edges.isEmpty():
            return labels


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    sets, components, _ = grouped(docs, k, percent)
    return sets.join(components, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def scan(thin: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(a row for each document with its set's signatures, and rows of counts; the least doc_id of each class; seed).

    No two sets have one node: should they, as their other signatures show, all are signed anew."""
    seed = 0
    while True:
        scanned = stage_table(thin.mapInArrow(lambda batches, s=seed: _scan(batches, k, s), "doc_id long, n_shingles long, node long, proof long, chunk int, counts binary"), "jaccard-scan")
        sets = scanned.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        classes = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("proof").alias("low"), F.max("proof").alias("high"), F.count(F.lit(1)).alias("rows"))
        classes = stage_table(classes, "jaccard-classes")
        if classes.filter("low <> high").isEmpty():
            return scanned, classes.select("node", "doc_id"), seed
        seed += 2


def grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """((doc_id, n_shingles, node) of every row, (node, least_node, component_id) of every class, seed of the nodes); the
    least document of a component has component_id and least_node."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    scanned, classes, seed = scan(thin, k)
    sets = scanned.filter(F.col("chunk").isNull()).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    table = spark.sparkContext.broadcast(bucket_table(scanned))
    repeated = repeats(sets)
    if repeated:  # a doc_id isn't enough to find a class's text
        signed = thin.mapInArrow(lambda batches: _signed(batches, k, seed, "node"), "doc_id long, text string, node long")
        texts = stage_table(signed.join(classes, ["doc_id", "node"]).groupBy("node").agg(F.first("text").alias("text")), "jaccard-class-texts")
    else:
        texts = thin.join(classes, "doc_id").select("node", "text")
    prefixes = texts.mapInArrow(lambda batches: _prefixes(batches, k, percent, table.value), "token long, node long, at long")
    dealt = prefixes.repartition("token", F.when(F.col("at") < 0, F.col("node"))).sortWithinPartitions("token")
    postings = stage_table(dealt.mapInArrow(_shared_only, "token long, node long, size long, place long"), "jaccard-postings")
    wanted = postings.select("node").distinct().join(classes, "node")
    sources = texts.join(wanted, "node") if repeated else thin.join(wanted, "doc_id")
    sources = stage_table(sources.select("node", "text"), "jaccard-texts")

    hubs = postings.groupBy("token").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "size", "place")).alias("hub"))
    near = postings.join(hubs, "token").filter(F.col("node") != F.col("hub.node"))
    near = near.filter(could_link(F.col("size"), F.col("hub.size"), F.col("place"), F.col("hub.place"), percent))
    pairs = near.select(F.col("hub.node").alias("blk"), F.col("node").alias("x")).distinct().withColumn("ys", F.array("blk"))
    pairs = stage_table(pairs, "jaccard-pairs")
    found = verified(pairs, pairs.select("blk", F.col("blk").alias("node"), F.col("blk").alias("comp")).distinct(), sources, k, percent)
    labels = components(found)

    sized = labels.join(labels.groupBy("comp").agg(F.count(F.lit(1)).alias("held")), "comp")
    met = postings.join(sized, "node", "left").select("token", "node", "size", "place", F.coalesce("comp", "node").alias("comp"), F.coalesce("held", F.lit(1)).alias("held"))
    met = stage_table(met, "jaccard-placed")
    open_ = met.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("held", "comp")).alias("most"), F.count(F.lit(1)).alias("rows"))
    open_ = open_.filter("low <> high").select("token", F.col("most.comp").alias("largest"), F.ceil(F.col("rows") / SLICE).cast("int").alias("slices"))
    rows = stage_table(met.join(open_, "token"), "jaccard-open")
    # Blocks of a component, together with the lone classes that meet it.
    family = F.when(F.max("held") > 1, F.max("comp")).otherwise(F.min("largest"))
    nodes = rows.groupBy("node").agg(F.max("comp").alias("comp"), family.alias("family"))
    sizes = nodes.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    blk = F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("blocks")))
    nodes = stage_table(nodes.join(sizes, "family").select("node", "comp", blk.alias("blk")), "jaccard-blocks")
    rows = rows.join(nodes.select("node", "blk"), "node").withColumn("big", F.col("comp") == F.col("largest"))
    cols = ["token", "slice", "probe", "node", "comp", "blk", "big", "size", "place"]
    own = rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).withColumn("probe", F.lit(False)).select(cols)
    outside = rows.filter(~F.col("big")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("probe", F.lit(True)).select(cols)
    crossing = own.unionByName(outside).repartition("token", "slice").sortWithinPartitions("token", "slice", "probe", "size")
    crossed = crossing.mapInArrow(lambda batches: _cross(batches, percent), "x long, blks array<long>, ys array<long>")
    merged = crossed.repartition("x").sortWithinPartitions("x").mapInArrow(_merge, "blk long, x long, ys array<long>")
    candidates = stage_table(merged, "jaccard-cross")
    more = verified(candidates, nodes, sources, k, percent)
    labels = components(found.unionByName(more))

    placed = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = placed.groupBy("comp").agg(F.min(F.struct("doc_id", "node")).alias("least"))
    final = placed.join(least, "comp").select("node", F.col("least.node").alias("least_node"), F.col("least.doc_id").alias("component_id"))
    return sets, stage_table(final, "jaccard-components"), seed


def repeats(sets: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row."""
    return not sets.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty()


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs without near copies: of each component one row of least doc_id stays, and every row without words
    or doc_id. Where rows share a doc_id, of a component's rows with its least doc_id one stays: of one class, the least
    text."""
    sets, components, seed = grouped(docs, k, percent)
    found = stage_table(sets.filter(F.col("node").isNotNull()).join(components, "node"), "jaccard-result")
    drop, node = free_names(docs, "drop", "node")
    if not repeats(found):
        drops = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(drop))
        return docs.join(drops, F.col("doc_id").cast("long") == F.col(drop), "left_anti")
    schema = StructType([*docs.schema.fields, StructField(node, LongType())])
    signed = docs.mapInArrow(lambda batches: _signed(batches, k, seed, node), schema)
    signed = signed.withColumn(node, F.when(F.col("doc_id").isNotNull(), F.col(node)))
    keeps = components.filter("node = least_node").select(F.col("node").alias(drop), F.col("component_id"))
    keeps = keeps.select(drop, F.col("component_id").alias(f"{drop}_id"))
    met = signed.join(keeps, (F.col(node) == F.col(drop)) & (F.col("doc_id").cast("long") == F.col(f"{drop}_id")))
    kept = met.groupBy(node).agg(F.min_by(F.struct(*docs.columns), "text").alias(drop)).select(f"{drop}.*")
    return kept.unionByName(signed.filter(F.col(node).isNull()).select(*docs.columns))
