"""Secret scans with structural confirmation.

Base spans come from three patterns: assignments of a password or key, access key ids, long hex runs. On top, runs of
base64 and hex and dotted tokens are candidates that are reported only when their decoded bytes have the structure of a
private key: DER whose nested lengths add up and whose fields are those of a PKCS#1, PKCS#8 (encrypted or not), SEC1 or
DSA private key; the frame of an OpenSSH private key; or a signed token whose header and payload are JSON objects, the
header with an algorithm. Public keys and certificates have the same encodings but are no secrets: they aren't reported.
Nor are keys whose whole body is encrypted and shows no structure.

Base64 may be of either alphabet, and wrapped: lines of at least LEAST_LINE characters, the last of any length. Between two
lines there is a blank or a line end, which may be written out as \\n, with an indent, quote signs or comment signs behind
it, or the end of a string literal before and the start of the next one behind it. A key may start at any of the lines,
and ends where its own lengths say, be it within a line: its span is the whole block. Hex may be wrapped alike, and its
bytes may stand apart by colons or blanks; a key may start at any digit. A token may start at any ey of its header, as
other letters may stand directly before it. The work on a text grows with its length, whatever stands in it: a header
is looked for in four decodings of a run, one for each place in a group of four, and keys where their first bytes are.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; equal rows are scanned each;
candidates that don't decode, or whose lengths don't add up, are not reported; whole texts are scanned, of any length;
other columns than doc_id and text, whatever their names, play no part, and redact() keeps them as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Kinds in the order of equal starts. The first three are the base.
KINDS = ("assign", "access", "hex", "der", "keyblob", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Every assignment has one of these letters groups before a sign; texts without one are skipped.
_ASSIGN_SIGN = re.compile(r"""(?:word|passwd|secret|token|key)["']?\x20*[:=]""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_LINE, LONGEST_LINE, LEAST_KEY = 16, 128, 40
#: Between two lines: the end of a string literal, a line end or blank, an indent, quote or comment signs, the next literal.
_BREAK = re.compile(r"""(?:["'][\x20\t]*[+\\,.&]?)?[\x20\t]*(?:\r\n?|\n|(?:\\r)?\\n|(?<=[A-Za-z0-9+/_=-])\x20(?=[A-Za-z0-9+/_-]))(?:["'][\x20\t]*[+\\,.&]?[\x20\t]*(?:\r\n?|\n))?[\x20\t]*(?:(?:>|\#|\*|\||//|--|;)[\x20\t]*)*["']?""")
#: A run of base64 begins behind another character, or behind an escape such as a written \n, whose letter isn't base64.
_EDGE = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/\\])|(?<=\\)(?![nrt]))"
_BASE64 = re.compile(rf"{_EDGE}[A-Za-z0-9+/]{{{LEAST_LINE},}}+(?:{_BREAK.pattern}[A-Za-z0-9+/]{{{LEAST_LINE},}}+)*+(?:{_BREAK.pattern}[A-Za-z0-9+/]++)?={{0,2}}")
_URL_EDGE = _EDGE.replace("+/", r"_\-")
_BASE64_URL = re.compile(_BASE64.pattern.replace(_EDGE, _URL_EDGE).replace("[A-Za-z0-9+/]", "[A-Za-z0-9_-]"))
#: All encoded keys have a run as long as this.
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}")
#: How a SEQUENCE and an OpenSSH frame open in base64.
_OPENS = ("M", "b3BlbnNzaC1rZXkt")
#: Hex digits, in pairs apart by a sign or wrapped; all keys have at least as many.
_HEX_ANY = re.compile(rf"[0-9a-fA-F]{{2}}(?:(?:[:\x20]?|{_BREAK.pattern}|:{_BREAK.pattern})[0-9a-fA-F]{{2}}){{23,}}+[0-9a-fA-F]?")
#: How keys open in hex: a SEQUENCE of 24 bytes or more whose first field is a small INTEGER or a SEQUENCE, or the frame.
_HEX_OPENS = re.compile(r"(?=(30(?:8[1-4]|[1-7][0-9a-f])(?:[0-9a-f]{2}){0,4}?(?:02010[01]|30)|6f70656e7373682d6b65792d763100))")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{4,}+)\.[A-Za-z0-9_-]*+")
_OPENSSH = b"openssh-key-v1\x00"
_LEAST = {"assign": 6, "access": 20}


def der_ends(data: bytes, at: int, stop: int, depth: int = 0) -> int:
    """Where the DER element at `at` ends, or -1 if its lengths don't add up. Constructed elements are parsed throughout."""
    if at + 2 > stop or depth > 16:
        return -1
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > stop:
            return -1
        size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if size < 0x80:
            return -1
    end = at + size
    if end > stop:
        return -1
    if tag & 0x20:
        while at < end:
            at = der_ends(data, at, end, depth + 1)
            if at < 0:
                return -1
    return end


def der_fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the fields of a SEQUENCE that spans the bytes and nests well."""
    if data[:1] != b"\x30" or der_ends(data, 0, len(data)) != len(data):
        return None
    at, found = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0), []
    while at < len(data):
        end = der_ends(data, at, len(data))
        body = at + 2 + (data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0)
        found.append((data[at], data[body:end]))
        at = end
    return found


# Tags of DER, and the sizes of elliptic private keys in bytes.
INTEGER, OCTETS, OID, SEQUENCE, FIRST, SECOND = 0x02, 0x04, 0x06, 0x30, 0xA0, 0xA1
CURVE_BYTES = (14, 16, 20, 21, 24, 28, 29, 30, 32, 36, 48, 52, 64, 66, 72)


def _algorithm(content: bytes) -> bool:
    """Whether the content of a SEQUENCE opens with an object identifier."""
    return len(content) > 2 and content[0] == OID and 0 < content[1] <= len(content) - 2


def is_der_key(data: bytes) -> bool:
    """The fields of a private key, by tags, version and sizes."""
    fields = der_fields(data) if len(data) >= 24 else None
    if not fields:
        return False
    tags, first = [t for t, _ in fields], fields[0][1]
    if tags == [SEQUENCE, OCTETS]:  # PKCS#8, encrypted: how, and the key
        return _algorithm(first) and len(fields[1][1]) >= 16
    if tags[0] != INTEGER or first not in (b"\x00", b"\x01"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS#8: version, algorithm, key, attributes, public key
        return _algorithm(fields[1][1]) and len(fields[2][1]) >= 16 and all(t in (FIRST, SECOND, 0x81) for t in tags[3:])
    if tags[1:2] == [OCTETS]:  # SEC1: version 1, key, curve, public key
        return first == b"\x01" and len(fields[1][1]) in CURVE_BYTES and len(tags) > 2 and all(t in (FIRST, SECOND) for t in tags[2:])
    sizes = [len(c.lstrip(b"\x00")) for _, c in fields]
    if tags == [INTEGER] * 6:  # DSA: version, p, q, g, public, private
        return first == b"\x00" and sizes[1] >= 64 and 16 <= sizes[2] <= sizes[1] and sizes[5] <= sizes[2]
    # PKCS#1: version, modulus, exponents, two primes, their exponents, coefficient, and other primes of version 1
    rsa = tags[:9] == [INTEGER] * 9 and tags[9:] == ([SEQUENCE] if first == b"\x01" else [])
    return rsa and sizes[1] >= 32 and sizes[2] <= sizes[1] and max(sizes[4:9]) < sizes[1]


def _key_name(field: bytes) -> bool:
    return field.startswith((b"ssh-", b"ecdsa-sha2-", b"sk-")) and field.isascii() and len(field) <= 64


def is_key_blob(data: bytes) -> bool:
    """The frame of an OpenSSH private key: its cipher, derivation and options, a number of keys, and as far as they are
    there the first public key, which names its algorithm."""
    if not data.startswith(_OPENSSH):
        return False
    at, fields = len(_OPENSSH), []
    while len(fields) < 3:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size + 4 > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    if not 1 <= int.from_bytes(data[at : at + 4], "big") <= 16 or not all(f.isascii() and f for f in fields[:2]):
        return False
    name = data[at + 12 : at + 12 + int.from_bytes(data[at + 8 : at + 12], "big")]
    return at + 12 + 64 > len(data) or _key_name(name)


def _url_decoded(part: str) -> bytes | None:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    objects = []
    for part in text.split(".")[:2]:
        try:
            objects.append(json.loads(_url_decoded(part) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in objects) and isinstance(objects[0].get("alg"), str)


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_der_key(data) else "keyblob" if is_key_blob(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if _ASSIGN_SIGN.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _ends(joined: str, start: int) -> Iterator[tuple[str, int]]:
    """(kind, bytes) that a key at a place of unpadded base64 may have by its own lengths, the most first."""
    head = _decoded(joined[start : start + 32])
    if head[0] == 0x30:
        more = head[1] & 0x7F if head[1] & 0x80 else 0
        if more <= 4:
            yield "der", 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
        return
    if not head.startswith(_OPENSSH):
        return
    data, found = _decoded(joined[start:]), []
    at, fields, most = len(_OPENSSH), 0, 3
    while at + 4 <= len(data) and fields < most:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
        if fields == 3:  # the number of keys, the public ones, all private ones in one field
            most += int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
        if at <= len(data) and fields == most:
            found.append(at)
    yield from (("keyblob", end) for end in reversed(found))
    yield "keyblob", len(data)


def _apart(run: str) -> Iterator[tuple[int, str]]:
    """A run of base64 where a blank doesn't wrap it: behind a line longer than any that is wrapped a new run begins."""
    at, line = 0, 0
    for m in _BREAK.finditer(run):
        if m[0] == " " and m.start() - line > LONGEST_LINE:
            yield at, run[at : m.start()]
            at = m.end()
        line = m.end()
    yield at, run[at:]


def _wrapped_keys(run: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of base64, which begin with its lines."""
    breaks = [m.span() for m in _BREAK.finditer(run)]
    starts, stops = [0, *(b for _, b in breaks)], [*(a for a, _ in breaks), len(run)]
    joined = "".join(run[a:b] for a, b in zip(starts, stops, strict=True)).rstrip("=")
    pads = len(run) - len(run.rstrip("="))
    marks = [0, *accumulate(b - a for a, b in zip(starts, stops, strict=True))]
    marks[-1] = len(joined)
    i = 0
    while i < len(starts) and marks[i] + LEAST_KEY <= len(joined):
        after = i + 1
        if run.startswith(_OPENS, starts[i]):
            for kind, size in _ends(joined, marks[i]):
                chars = -(-size * 8 // 6)
                if chars < LEAST_KEY or marks[i] + chars > len(joined):
                    continue
                line = bisect_left(marks, marks[i] + chars) - 1
                whole = marks[line + 1] == marks[i] + chars
                if whole and line == len(starts) - 1 and pads not in (0, -chars % 4):
                    continue
                if _key_kind(_decoded(joined[marks[i] : marks[i] + chars])) == kind:
                    yield kind, starts[i], stops[line] if whole else starts[line] + marks[i] + chars - marks[line]
                    after = line + 1
                    break
        i = after


def _hex_keys(run: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the keys in a run of hex digits that may be apart or wrapped."""
    places = [i for i, c in enumerate(run) if c in "0123456789abcdefABCDEF"] if not run.isalnum() else range(len(run))
    digits = ("".join(run[i] for i in places) if len(places) < len(run) else run).lower()
    done = 0
    for m in _HEX_OPENS.finditer(digits):
        if m.start() < done:
            continue
        if digits[m.start()] == "3":
            more = int(digits[m.start() + 3]) if digits[m.start() + 2] == "8" else 0
            size = 2 + more + int(digits[m.start() + 4 : m.start() + 4 + 2 * more] if more else digits[m.start() + 2 : m.start() + 4], 16)
        else:
            size = (len(digits) - m.start()) // 2
        end = m.start() + 2 * size
        if size >= 24 and end <= len(digits) and (kind := _key_kind(bytes.fromhex(digits[m.start() : end]))):
            yield kind, places[m.start()], places[end - 1] + 1
            done = end


_HEADER = re.compile(r'\{(?="|\x20[\x20\t\r\n]*")')
_JSON = json.JSONDecoder()


def _header_starts(text: str, start: int, end: int) -> Iterator[int]:
    """Where in a run of base64 a JSON object begins that ends with the run and names an algorithm, ascending."""
    found = []
    for first in range(start, min(start + 4, end)):
        data = _url_decoded(text[first:end])
        if not data or not data.rstrip().endswith(b"}"):
            continue
        shown = data.decode("latin-1")  # a character a byte, so that places are bytes
        for m in _HEADER.finditer(shown):
            if m.start() % 3:
                continue
            try:
                header, stop = _JSON.raw_decode(shown, m.start())
                data[m.start() :].decode() if not shown[stop:].strip() else None
            except (ValueError, RecursionError):
                continue
            if not shown[stop:].strip() and isinstance(header, dict) and isinstance(header.get("alg"), str):
                found.append(first + m.start() // 3 * 4)
    return iter(sorted(found))


def _token_spans(text: str) -> Iterator[tuple[str, int, int]]:
    at = 0
    while m := _TOKEN.search(text, at):
        at = m.end(1) + 1
        if "ey" not in m[1]:
            continue
        try:
            payload = json.loads(_url_decoded(m[2]) or b"")
        except (ValueError, RecursionError):
            continue
        start = next((i for i in _header_starts(text, m.start(), m.end(1)) if i <= m.end(1) - 10), None) if isinstance(payload, dict) else None
        if start is not None:
            yield "token", start, m.end()
            at = m.end()


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    encoded = _LONG.search(text)
    for pattern in (_BASE64, _BASE64_URL) if encoded else ():
        for m in pattern.finditer(text):
            run = m[0]
            if len(run) < LEAST_KEY or not any(x in run for x in _OPENS) or pattern is _BASE64_URL and not ("-" in run or "_" in run):
                continue
            for at, part in _apart(run.replace("-", "+").replace("_", "/")):
                found += [(kind, m.start() + at + a, m.start() + at + b) for kind, a, b in _wrapped_keys(part)]
    for m in _HEX_ANY.finditer(text):
        found += [(kind, m.start() + a, m.start() + b) for kind, a, b in _hex_keys(m[0])]
    if "ey" in text and "." in text:
        found += _token_spans(text)
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0])))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start and kind."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[1], KINDS.index(s[0]))) if text else []


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each stretch of spans replaced by a mark."""
    found = spans(text)
    if not found:
        return text
    parts, done = [], 0
    at, stop = found[0][1], found[0][2]
    for _, start, end in [*found[1:], ("", len(text) + 1, 0)]:
        if start > stop:
            parts += [text[done:at], mark]
            done, at, stop = stop, start, end
        else:
            stop = max(stop, end)
    return "".join(parts) + text[done:]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 23):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(found, kind)], [*(n for n in batch.schema.names if n != "text"), "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, kind by kind, for every row of docs."""
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(_scan, f"doc_id long, spans {SPANS}")


def span_report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s spans."""
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _redact(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_slices(whole, "text", 1 << 23):
            texts = [redacted(t) for t in batch.column("text").to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with their secrets replaced, and n_chars (where there is one) counted anew."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    columns = docs.columns
    return docs.mapInArrow(lambda batches: _redact(batches, columns), docs.schema)
