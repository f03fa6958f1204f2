"""Shared pieces of the corpus operators: stage tables, Arrow text access, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The word separators of the contracts: space, tab, LF, VT, FF, CR.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own if all
    executors run on this machine, and an error if they don't: other machines wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cadenza/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Removes all stage tables of this application. Results that read them must have been written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: later steps don't recompute what is above,
    and the table outlives any executor."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column, in any case of letters."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text each (one row at least), to bound what numpy allocates."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if column.offset:
        column = pa.concat_arrays([column])
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * _MIX
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverses modulo 2**64, for i below n."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P, np.uint64)], dtype=np.uint64)
        _INVERSES = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)], dtype=np.uint64)
    return _POWERS[:n], _INVERSES[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z in lower case, the row of each word), for rows of text bytes.

    A word's hash is a polynomial in its bytes, taken as a difference of prefix sums, and mixed with its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.r_[False, ~_IS_SPACE[data], False]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    last = np.zeros(n + 1, dtype=bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | last[1:])) + 1
    powers, inverses = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverses[starts]
    hashes = mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each run of k words, its row); a row of fewer than k words has its whole sequence as the one run."""
    words, rows = word_hashes(data, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    begins = np.r_[0, np.cumsum(counts)[:-1]]
    if len(words) >= k:
        whole = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
        acc = words[whole]
        for j in range(1, k):
            acc = mixed(acc * _P + words[whole + j])
        at = rows[whole]
    else:
        acc, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    more = words[begins[short]] if len(short) else np.zeros(0, np.uint64)
    for j in range(1, k - 1):
        has = np.flatnonzero(counts[short] > j)
        if len(has):
            more[has] = mixed(more[has] * _P + words[begins[short[has]] + j])
    more = mixed(more + counts[short].astype(np.uint64))
    return np.r_[acc, more], np.r_[at, short]


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ascending, and the distinct hashes of each ascending."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]
