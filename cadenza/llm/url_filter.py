"""URL filters by a sort-merge range join.

A host is turned round label by label and closed with a dot ("www.example.org" -> "org.example.www."), so a rule for a
host and all its subdomains is the interval of keys from "org.example." up to "org.example/". URLs and rules are dealt
to key ranges; a rule goes to every range that its interval meets. Each range is sorted by key and swept once with a
stack of the rules whose intervals are open, which nest; the paths of a host's rules are looked up by their lengths.

The split points come from a bounded sample of keys, which decides how even the ranges are and nothing else; a hash of
page_id and path is part of the split key, so a host, or one URL, that holds a third of all rows spreads over many
ranges, also where page_ids are null or repeated. Only rows alike in all of these share one.

Verdicts: the longest rule that fits (host and path together; then the longer host, then block before allow), else the
default. Defined cases: a null URL, or one without "://", has an empty host and path, and no rule; equal rows each get a
row; null and repeated page_ids are kept; other columns than page_id and url, whatever their names, play no part; without
rules every verdict is the default; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_RANGE = 500_000
SAMPLE_PER_RANGE = 40
MOST_RANGES = 20_000
KEY_CHARS = 80
OUT = "page_id long, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def parsed_rules(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(host, path, written rule, action) of ("block", "example.org/es/") pairs."""
    found = []
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        found.append((host.lower(), slash + path, rule, action))
    return found


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(parsed_rules(rules), "host string, path string, rule string, action string")


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack: list[tuple[str, dict[str, tuple], list[int]]] = []
    span, last_key, fitting = None, None, []
    for batch in batches:
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        out: list[list] = [[], [], [], [], []]
        for i, (part, key) in enumerate(zip(c["part"], c["key"], strict=True)):
            if part != span:
                stack, span, last_key = [], part, None
            if key != last_key:
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                last_key = key
            if c["is_url"][i]:
                path, best = c["path"][i], None
                for prefix, paths, lengths in reversed(stack):
                    at = bisect_right(lengths, len(path)) - 1
                    while at >= 0:
                        if found := paths.get(path[: lengths[at]]):
                            rank = (len(prefix) - 1 + lengths[at], len(prefix), found[1] == "block")
                            best = max(best or (rank, found), (rank, found))
                            break
                        at -= 1
                rule, verdict = best[1] if best else (None, default)
                for column, value in zip(out, (c["page_id"][i], c["host"][i], path, rule, verdict), strict=True):
                    column.append(value)
            else:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                _, paths, lengths = stack[-1]
                path, said = c["path"][i], (c["rule"][i], c["action"][i])
                paths[path] = max(paths.get(path, said), said, key=lambda x: (x[1] == "block", x[0]))
                at = bisect_right(lengths, len(path))
                if not at or lengths[at - 1] != len(path):
                    lengths.insert(at, len(path))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def _deal(batches: Iterator[pa.RecordBatch], splits: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        salts = batch.column("salt").to_pylist()
        parts = [bisect_right(splits, (key[:KEY_CHARS], salt)) for key, salt in zip(batch.column("key").to_pylist(), salts, strict=True)]
        yield batch.drop_columns(["salt"]).append_column("part", pa.array(np.array(parts, dtype=np.int32)))


def _spread(batches: Iterator[pa.RecordBatch], splits: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    """A rule for each range that its interval meets."""
    for batch in batches:
        keys = batch.column("key").to_pylist()
        first = [bisect_left(splits, (key[:KEY_CHARS], -(1 << 63))) for key in keys]
        last = [bisect_right(splits, ((key[:-1] + "/")[:KEY_CHARS], 1 << 63)) for key in keys]
        at = np.repeat(np.arange(len(keys)), [b - a + 1 for a, b in zip(first, last, strict=True)])
        parts = np.array([p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)], dtype=np.int32)
        yield batch.take(pa.array(at)).append_column("part", pa.array(parts))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url)."""
    spark = pages.sparkSession
    url = F.col("url")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    urls = urls.select("*", host_key(F.col("host")).alias("key"), F.xxhash64("page_id", "path").alias("salt"))
    n = pages.count()
    ranges = max(1, min(MOST_RANGES, max(n // ROWS_PER_RANGE, min(64, n // 100))))
    share = min(1.0, 2 * ranges * SAMPLE_PER_RANGE / max(1, n))
    sample = urls.select(F.substring("key", 1, KEY_CHARS).alias("key"), "salt")
    # About ranges * SAMPLE_PER_RANGE short keys, whatever the input.
    picked = sample.filter(F.pmod(F.xxhash64("key", "salt"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * ranges * SAMPLE_PER_RANGE + 1000)
    keys = sorted((r[0], r[1]) for r in picked.collect())
    splits = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    dealt = urls.mapInArrow(lambda batches: _deal(batches, splits), "page_id long, host string, path string, key string, part int")
    opened = rules.select("rule", "action", "path", host_key(F.col("host")).alias("key")).dropDuplicates(["rule", "action"])
    spread = opened.mapInArrow(lambda batches: _spread(batches, splits), "rule string, action string, path string, key string, part int")
    null = F.lit(None)
    events = dealt.select("part", "key", F.lit(True).alias("is_url"), "page_id", "host", "path", null.cast("string").alias("rule"), null.cast("string").alias("action")).unionByName(
        spread.select("part", "key", F.lit(False).alias("is_url"), null.cast("long").alias("page_id"), null.cast("string").alias("host"), "path", "rule", "action")
    )
    swept = events.repartition(len(splits) + 1, "part").sortWithinPartitions("part", "key", "is_url")
    return swept.mapInArrow(lambda batches: _sweep(batches, default), OUT)
