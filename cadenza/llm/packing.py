"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any number of pieces is a histogram of at most
`capacity` counts. The reduction and the best fit work on that histogram, with multiplicities, on the driver; what they
return is a table of runs ("pieces 100..499 of length 700 lie at offset 1348 of sequences 9000..9399") whose number is
bounded by the number of lengths and of open free spaces, not by the number of pieces. Pieces find their place by their
rank among those of equal length, counted in slices so that a length that many pieces share is never one task.

Reduction: with i the longest piece that is left and r the room beside it, a set is fixed for good when it dominates
every other feasible set that holds i: {i} if nothing else fits; {i, j} if j fills r, or if no two pieces fit r together
and j is the longest that fits; {i, a, b} if no three fit, a is the longest that fits, b the longest beside a, and no
pair of other pieces longer than b fits. What remains is packed by best fit, longest first.

Defined cases: a null text is an empty document, of the closing id alone; equal rows are packed each on its own; a
document longer than the capacity is cut into whole pieces, of which the first may be shorter; rows that share a doc_id
(null too) are documents of their own; added tokens that stand in a text have their own ids; other columns than doc_id
and text, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import contextlib
import functools
import itertools
import os
import re
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, text_slices

CAPACITY = 2048
#: About so many pieces of one length are ranked by one task.
SLICE_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Each piece has a lane, by its place in its task, from which its slice comes: ids and texts may all be alike.
LANES = 1 << 20


#: Characters of the stretches of text whose ids a worker remembers, twice: those met of late, and those before.
MEMO_CHARS = 4_000_000
#: Seconds without a task after which a worker forgets them: other stages run in the same workers.
IDLE_S = 2.0
#: A stretch is white space and the Latin letters that follow, up to an ASCII sign or white space, or else all that
#: follows up to white space. Tokens never reach across stretches.
_STRETCH = re.compile(r"\s*[A-Za-zÀ-ÖØ-öø-ɏ]+(?![^\s!-/:-@\[-`{-~])|\s*\S+|\s+")
_BETWEEN = re.compile(r"(?<=\S)(?=\s)")


class TokenEncoder:
    """The ids that a tokenizer file gives, as bytes of unsigned 32-bit numbers.

    A byte-level tokenizer cuts a text into words before it merges bytes: no word holds white space behind anything else,
    or a letter before a sign. So each stretch has its own ids, and those of stretches met before are remembered; new ones
    are encoded many at a time, as one text. Texts with an added token, or with one of the four separators that Python
    alone takes for white space, go to the tokenizer whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        # A byte-level vocabulary has a letter for each byte.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0
        self.lock, self.tasks, self.begun = threading.Lock(), 0, 0

    @contextlib.contextmanager
    def task(self, idle_s: float = IDLE_S) -> Iterator[None]:
        """While it lasts the memory stays; idle_s after it, without another task, it goes."""
        with self.lock:
            self.tasks += 1
            self.begun += 1
        try:
            yield
        finally:
            with self.lock:
                self.tasks -= 1
            timer = threading.Timer(idle_s, self.forget, [self.begun])
            timer.daemon = True
            timer.start()

    def forget(self, begun: int) -> None:
        """Unless a task has begun since then."""
        with self.lock:
            if not self.tasks and begun == self.begun:
                self.memo, self.older, self.chars = {}, {}, 0

    def exact(self, texts: list[str]) -> list[bytes]:
        # Some at a time: an encoding holds far more than its ids.
        batches = (self.tokenizer.encode_batch_fast(texts[lo : lo + 500], add_special_tokens=False) for lo in range(0, len(texts), 500))
        return [np.array(e.ids, dtype="<u4").tobytes() for batch in batches for e in batch]

    def joined(self, some: list[str]) -> list[bytes]:
        """The ids of each of some stretches, none of which ends in white space, from one encoding of all.

        Each begins with white space, or with a line end that is put before it and left out again, so that no word reaches
        across two of them, as in a text. Bytes are counted: unless tokens end where stretches end, each is encoded alone."""
        bare = [not s[0].isspace() for s in some]
        text = "".join([f"\n{s}" if b else s for s, b in zip(some, bare, strict=True)])
        ids = np.frombuffer(self.exact([text])[0], dtype="<u4")
        edges = np.zeros((len(some), 2), dtype=np.int64)
        edges[:, 0], edges[:, 1] = bare, [len(s) if s.isascii() else len(s.encode()) for s in some]
        edges = np.cumsum(edges).reshape(-1, 2)  # where each begins and ends
        ends = np.r_[0, np.cumsum(self.sizes[ids])]
        cuts = np.searchsorted(ends, edges)
        if ends[-1] != edges[-1, 1] or (ends[cuts] != edges).any():
            return self.exact(some)
        data = ids.tobytes()
        return [data[a:b] for a, b in (4 * cuts).tolist()]

    def ids_of(self, some: list[str], most: int = 2_000) -> list[bytes]:
        """The ids of each of some stretches."""
        blank = {s for s in some if s[-1].isspace()}
        met = dict(zip(blank, self.exact(list(blank)), strict=True))
        rest = [s for s in some if s not in blank]
        for lo in range(0, len(rest), most):
            met.update(zip(rest[lo : lo + most], self.joined(rest[lo : lo + most]), strict=True))
        return [met[s] for s in some]

    def stretches(self, text: str, most: int = 1 << 18) -> Iterator[list[str]]:
        """The stretches of a text, for about `most` characters at a time."""
        at = 0
        while len(text) - at > most:
            cut = _BETWEEN.search(text, at + most)
            if not cut:
                break
            yield _STRETCH.findall(text, at, cut.start())
            at = cut.start()
        yield _STRETCH.findall(text, at)

    def learn(self, new: set[str]) -> None:
        """From now on the memory has these stretches, which it didn't have."""
        self.chars += sum(map(len, new))
        before = {c: self.older[c] for c in new if c in self.older}
        self.memo.update(before)
        rest = [c for c in new if c not in before]
        self.memo.update(zip(rest, self.ids_of(rest), strict=True))

    def met(self, found: list[str]) -> list[bytes]:
        """The ids of each of some stretches, by the memory."""
        if self.chars > MEMO_CHARS:
            self.memo, self.older, self.chars = {}, self.memo, 0
        ids = list(map(self.memo.get, found))
        new = {s for s, i in zip(found, ids, strict=True) if i is None}
        if new:
            self.learn(new)
            ids = [self.memo[s] if i is None else i for s, i in zip(found, ids, strict=True)]
        return ids

    def groups(self, texts: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
        """The texts in order, some at a time, of about `most` characters; one that must stay whole is alone."""
        some, chars = [], 0
        for text in texts:
            whole = any(w in text for w in self.whole)
            if some and (whole or chars + len(text) > most):
                yield some
                some, chars = [], 0
            some.append(text)
            chars += len(text)
            if whole:
                yield some
                some, chars = [], 0
        if some:
            yield some

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for some in self.groups(texts):
            if len(some) > 1:
                found = [_STRETCH.findall(text) for text in some]
                ids = iter(self.met(list(itertools.chain.from_iterable(found))))
                yield from (b"".join(itertools.islice(ids, len(f))) for f in found)
            elif any(w in some[0] for w in self.whole):
                yield self.exact(some)[0]
            else:
                yield b"".join(i for found in self.stretches(some[0]) for i in self.met(found))


@functools.lru_cache(1)
def token_encoder(path: str) -> TokenEncoder:
    """One for a worker, whatever tasks it runs."""
    return TokenEncoder(path)


def piece_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = token_encoder(path)
    with encoder.task():
        yield from _pieces(encoder, batches, capacity, end_id)


def _pieces(encoder: TokenEncoder, batches: Iterator[pa.RecordBatch], capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end, done = np.array([end_id], dtype="<u4").tobytes(), 0
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 22):
            rows: list[list] = [[], [], [], [], []]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids = memoryview(found + end)
                n = len(ids) // 4
                start, stop, piece = 0, n % capacity or capacity, 0
                while start < n:
                    for column, value in zip(rows, (doc_id, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            lanes = (np.arange(done, done + len(rows[0])) * 40_503 % LANES).astype(np.int32)
            done += len(rows[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds, strict=True)), pa.array(lanes)], ["doc_id", "piece", "start", "length", "ids_crc32", "lane"])


def reduce_and_pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, sequences): a run (length, first, n, sequence, offset) puts the pieces of ranks first..first+n-1 of that
    length at that offset of the sequences from `sequence` on, one in each."""
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)
    placed = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, placed[length], n, sequence, offset))
        placed[length] += n
        left[length] -= n
        if not left[length]:
            lengths.remove(length)

    def longest(upto: int, without: dict[int, int]) -> int | None:
        at = bisect.bisect_right(lengths, upto) - 1
        while at >= 0 and left[lengths[at]] - without.get(lengths[at], 0) < 1:
            at -= 1
        return lengths[at] if at >= 0 else None

    def smallest(k: int, over: int, without: dict[int, int]) -> list[int]:
        """The k smallest pieces of more than `over`."""
        found: list[int] = []
        at = bisect.bisect_right(lengths, over)
        while at < len(lengths) and len(found) < k:
            found += [lengths[at]] * min(k - len(found), max(0, left[lengths[at]] - without.get(lengths[at], 0)))
            at += 1
        return found

    def dominating(i: int) -> list[int] | None:
        """What goes with i in a set that dominates all others that hold i."""
        room, own = capacity - i, {i: 1}
        a = longest(room, own)
        if a is None:
            return []
        least = smallest(3, 0, own)
        if a == room or len(least) < 2 or least[0] + least[1] > room:
            return [a]
        if len(least) == 3 and sum(least) <= room:
            return None
        both = own | {a: 1 + (a == i)}
        b = longest(room - a, both)
        if b is None:
            b = 0
        rival = smallest(2, b, own)
        if len(rival) == 2 and sum(rival) <= room:
            return None
        return [a, b] if b else None

    i = lengths[-1] if lengths else None
    while i is not None:
        fixed = dominating(i)
        if fixed is None:
            at = bisect.bisect_left(lengths, i) - 1
        else:
            uses: dict[int, int] = {}
            for k in (i, *fixed):
                uses[k] = uses.get(k, 0) + 1
            # The same set dominates again while every length that the decision looked at is still there. It looks at
            # three pieces of a length at most, besides those of the set: until the last of n times 4 * m are left of a
            # length that the set has m of, and m + 3 <= 4 * m. That a pair fills the room holds whatever else is left.
            n = max(1, min(left[k] // m for k, m in uses.items()) - 3) if not (fixed and sum((i, *fixed)) == capacity and len(fixed) == 1) and fixed else min(left[k] // m for k, m in uses.items())
            offset = 0
            for k, m in uses.items():
                for _ in range(m):
                    take(k, n, sequences, offset)
                    offset += k
            sequences += n
            at = bisect.bisect_right(lengths, i) - 1
        i = lengths[at] if at >= 0 else None

    # Best fit, longest first: spaces holds, for each free space, the runs of sequences that have it.
    spaces: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    for length in reversed(lengths.copy()):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                space = order[at]
                sequence, held = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space]
                    order.pop(at)
                each = min(space // length, left[length])
                n = min(held, left[length] // each)
                if held > n:
                    if space not in spaces:
                        spaces[space] = []
                        bisect.insort(order, space)
                    spaces[space].append((sequence + n, held - n))
            else:
                space, each = capacity, min(capacity // length, left[length])
                n = left[length] // each
                sequence = sequences
                sequences += n
            for k in range(each):
                take(length, n, sequence, capacity - space + k * length)
            if rest := space - each * length:
                if rest not in spaces:
                    spaces[rest] = []
                    bisect.insort(order, rest)
                spaces[rest].append((sequence, n))
            if not left[length]:
                break
    return runs, sequences


def _places(batches: Iterator[pa.RecordBatch], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset by the run that holds (length, position)."""
    keys = runs[:, 0] * (1 << 40) + runs[:, 1]
    for batch in batches:
        length, position = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "position"))
        run = runs[np.searchsorted(keys, length * (1 << 40) + position, side="right") - 1]
        columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        columns |= {"sequence_id": pa.array(run[:, 3] + position - run[:, 1]), "offset": pa.array(run[:, 4])}
        yield pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row for each piece: its document, place there, length, CRC of its ids, its sequence and place in it. tokenizer:
    a file of the tokenizers library, at a path that the executors have too."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: piece_rows(batches, tokenizer, capacity, end_id), f"{PIECES}, lane int")
    pieces = stage_table(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    slices = max(1, -(-max(counts.values(), default=0) // SLICE_ROWS))
    slices = max(slices, min(64, -(-sum(counts.values()) // 2_000)))
    runs, _ = reduce_and_pack(counts, capacity)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    cut = pieces.withColumn("slice", F.col("lane") % min(slices, LANES))
    sizes = cut.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("l"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(bases, (F.col("length") == F.col("l")) & (F.col("slice") == F.col("s")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("base")).alias("position"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    return ranked.mapInArrow(lambda batches: _places(batches, shared.value), f"{PIECES}, sequence_id long, offset long")
