"""WARC archives: a writer of deduplicated records and a salvage reader.

Writer: each record is a gzip member of its own. Spark's text writer commits the files, on any file system: a row is a
member without its last byte, and the line separator, one zero byte, supplies it. A member ends with its size, whose last
byte is zero below 16 MiB; behind a larger one stands an empty member, which ends with a zero too. This rests on Spark
keeping the bytes of a binary column as they are when it casts them to a string and writes them as text; were they
changed, the reader's checks would fail and every record would show as a gap. A task begins a new file before its file
holds FILE_BYTES, so an archive is that long, or one record.

Reader: at each place it expects a gzip member or a version line. A member must decompress with the right checksum, a
record must have its length, its closing blank lines and its digests. Where a check fails, the reader searches for the
next place at which a member or version line is valid, goes on there, and logs the bytes between as a quarantined gap.
Within a member's content it searches for version lines likewise; such a gap has the member's place, its decompressed
bytes, and where it begins in the content as part of its reason. Of a cut or damaged member the sound records before the
damage count too (of a cut one those with more behind them, of a damaged one those with a digest), and its gap begins
behind the last of them.

Of records with equal payloads of at least `least_bytes` bytes the one of largest page_id is the response and the others
are revisits of it. Defined cases: a null html is an empty payload; rows that share page_id and payload are alike,
so where that page_id is the largest each is a response; a null page_id is smaller than all others; a null url has no
target header; other columns than page_id, url and html, whatever their names, play no part; an empty table gives an
empty archive and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_path, stage_table, text_slices

#: Archives end before they are longer, and hold so many records at most.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 20_000
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
RECORD = "page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
READ = f"archive string, at long, gap_bytes long, reason string, {RECORD}"
_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")
_HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """A response record, or (with refers_to) a revisit without its payload."""
    digest = digest or base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""
    lines = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    lines.append(f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """Gzip that ends with a zero byte."""
    squeeze = zlib.compressobj(level, wbits=31)
    member = squeeze.compress(data) + squeeze.flush()
    if member[-1]:
        empty = zlib.compressobj(level, wbits=31)
        member += empty.compress(b"") + empty.flush()
    return member


def _members(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Members, and the number of the task's file that each goes to."""
    file, held = 0, 0
    for whole in batches:
        for batch in text_slices(whole, "payload", 1 << 23):
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            rows, files = [], []
            for page_id, url, payload, sha1, refers_to in zip(c["page_id"], c["url"], c["payload"], c["sha1"], c["refers_to"], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                rows.append(gzip_member(record_bytes(page_id, url, payload.encode(), refers_to, digest))[:-1])
                held += len(rows[-1]) + 1
                if held > most:
                    file, held = file + 1, len(rows[-1]) + 1
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(files, pa.int32())], ["member", "file"])


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for every row of pages (page_id, url, html) to archives below the folder path."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    # Payloads of one row need no lookup: only those of several are joined.
    shared = base.filter(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("keeps"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    joined = base.join(shared.select("sha1", "keeps"), "sha1", "left")
    refers = F.when(F.col("keeps").isNotNull() & ~F.col("keeps").eqNullSafe(F.col("page_id")), F.col("keeps"))
    members = joined.select("page_id", "url", "payload", "sha1", refers.alias("refers_to")).mapInArrow(lambda batches: _members(batches, file_bytes), "member binary, file int")
    lines = members.select(F.col("member").cast("string").alias("value"), "file")
    lines.write.partitionBy("file").option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed_record(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """(headers, block, end) of the record at a version line, or what is wrong with it."""
    head = _HEADER.match(data, at)
    if not head:
        return "no header"
    headers = {}
    for line in head[1].decode("utf-8", "replace").split("\r\n")[:-1]:
        name, colon, value = line.partition(":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        return "no length"
    end = head.end() + int(length)
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        return "wrong length"
    block = bytes(data[head.end() : end])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:] != base32_sha1(block):
        return "wrong block digest"
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != base32_sha1(block.partition(b"\r\n\r\n")[2]):
        return "wrong payload digest"
    return headers, block, end + 4


def _member_at(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """(content, end, what is wrong with it) of the gzip member at a place. Of a wrong one the content is what decompresses.
    The inflater gets the bytes in steps, as it copies what it is given beyond the member's end."""
    inflate, parts, place, step = zlib.decompressobj(31), [], at, 1 << 12
    try:
        while place < len(data) and not inflate.eof:
            parts.append(inflate.decompress(data[place : place + step]))
            place, step = min(len(data), place + step), min(1 << 20, 2 * step)
        return (b"".join(parts), place - len(inflate.unused_data), "") if inflate.eof else (b"".join(parts), len(data), "cut member")
    except zlib.error as e:
        wrong = f"bad member: {e}"
    return b"".join(part for part, _ in _inflated(data, at)), len(data), wrong


def _inflated(data: memoryview, at: int, most: int | None = None) -> Iterator[tuple[bytes, int]]:
    """(part of the content, place up to which it was read) until an error, or until there are `most` bytes; what stands
    around either is read byte by byte."""
    inflate, done, step = zlib.decompressobj(31), 0, 1 << 12
    while at < len(data) and not inflate.eof and (most is None or done < most):
        before = inflate.copy()
        try:
            part = inflate.decompress(data[at : at + step])
        except zlib.error:
            part = None
        if step > 1 and (part is None or most is not None and done + len(part) >= most):
            inflate, step = before, 1
            continue
        if part is None:
            return
        at += step
        done += len(part)
        yield part, at


def _within(content: bytes, wrong: str) -> tuple[list[tuple[int, tuple[dict[str, str], bytes, int] | str, int]], int]:
    """((start, record or what is wrong, bytes) throughout a member's content, end of the last record). wrong: what is
    wrong with the member; of a cut one a record counts when more stands behind it, of a bad one when it has a digest."""
    items, at, bad, why, last = [], 0, None, "", 0
    while at < len(content):
        record = parsed_record(content, at)
        if not isinstance(record, str) and wrong == "cut member" and record[2] == len(content):
            record = wrong
        if not isinstance(record, str) and wrong.startswith("bad member") and not {"warc-block-digest", "warc-payload-digest"} & record[0].keys():
            record = "no digest"
        if isinstance(record, str):
            if bad is None:
                bad, why = at, record
            later = _VERSION_LINE.search(content, at + 1)
            at = later.start() if later else len(content)
            continue
        if bad is not None:
            items.append((bad, why, at - bad))
            bad = None
        items.append((at, record, record[2] - at))
        at = last = record[2]
    if bad is not None:
        items.append((bad, why, len(content) - bad))
    return items, last


def salvaged(data: bytes | pa.Buffer) -> Iterator[tuple[int, dict[str, str] | None, bytes, int, str]]:
    """(place, headers, block, 0, "") for each sound record, (place, None, b"", bytes, reason) for each gap."""
    data = memoryview(data).cast("B")
    at, bad, why = 0, None, ""
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            content, end, wrong = _member_at(data, at)
            items, last = _within(content, wrong)
            if bad is not None and (last or not items and not wrong):
                yield bad, None, b"", at - bad, why
                bad = None
            for start, record, size in items if last else []:
                if not isinstance(record, str):
                    yield at, record[0], record[1], 0, ""
                elif not wrong or start < last:
                    yield at, None, b"", size, f"{record}, from byte {start} of the member's content"
            if not wrong:
                if items and not last and bad is None:
                    yield at, None, b"", end - at, items[0][1]
                at = end
                continue
            if last:  # nothing before the place that gives the last record's end is read again
                for _, at in _inflated(data, at, last):
                    pass
                bad, why = at, wrong
                later = _CANDIDATE.search(data, at)
                at = later.start() if later else len(data)
                continue
        elif data[at : at + 5] == b"WARC/":
            record = parsed_record(data, at)
            if not isinstance(record, str):
                if bad is not None:
                    yield bad, None, b"", at - bad, why
                    bad = None
                yield at, record[0], record[1], 0, ""
                at = record[2]
                continue
            wrong = record
        else:
            wrong = "no member or version line"
        if bad is None:
            bad, why = at, wrong
        later = _CANDIDATE.search(data, at + 1)
        at = later.start() if later else len(data)
    if bad is not None and bad < len(data):
        yield bad, None, b"", len(data) - bad, why


def _page(value: str | None) -> int | None:
    found = _PAGE.fullmatch(value or "")
    return int(found[1]) if found else None


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = [part.split()[0] for part in READ.split(", ")]
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[tuple] = []
            held = 0
            for at, headers, block, gap, why in salvaged(data.as_buffer()):
                if headers is None:
                    rows.append((path, at, gap, why, *(None,) * 7))
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                kind = headers.get("warc-type")
                digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(payload)
                whole = int(size[1]) if size and kind == "revisit" else len(payload)
                rows.append((path, at, None, None, _page(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, digest, whole, _page(headers.get("warc-refers-to")), payload if with_payload else None))
                held += len(payload) if with_payload else 0
                if held > 1 << 23 or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (gap_bytes null) and quarantined gaps (reason, at, gap_bytes) of the archives in a folder and below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _read(batches, with_payload), READ)


def salvage(spark: SparkSession, path: str, with_payload: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine log) of the archives in a folder, read once; both are tables in the shared folder. The log has
    archive, at, gap_bytes and reason of each gap."""
    rows = stage_table(read_warc(spark, path, with_payload), "warc-read")
    gaps = stage_table(rows.filter("gap_bytes is not null").select("archive", "at", "gap_bytes", "reason"), "warc-quarantine")
    return rows.filter("gap_bytes is null").drop("gap_bytes", "reason"), gaps


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back: the records, without payloads."""
    path = stage_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    records, _ = salvage(pages.sparkSession, path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
