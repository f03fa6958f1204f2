"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores. DataFrame functions alone.

Each kind has a pattern, a validator and words that tend to stand near it. A match that its validator refuses goes; one
that it accepts has the kind's score, and NEARBY more where one of the words stands in the CONTEXT code points between
it and its neighbours of the same kind. Base kinds (email, ip, card, phone) stay whatever their score; of the others
those of `least` or more: account numbers (iban, by mod 97) always, social security numbers (ssn) beside a word only.

The patterns are written so that a scan is linear in a text: a run of characters is read once, from its first one. They
match what the plain ones of PLAIN match. Places come from the lengths of matches and of what stands between them, summed
by blocks, so a text with a million matches isn't quadratic either.

Spans are in code points, end exclusive. Defined cases: a null or empty text has no spans; whole texts are scanned, of any
length; equal rows are scanned each; of one kind matches never overlap, of two they may; other columns than doc_id and
text, whatever their names, play no part, and redact() keeps them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import let

#: Kinds in the order of equal starts. The first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
_NAME, _WORD = "A-Za-z0-9._%+-", "A-Za-z0-9_"
_ACCOUNT = r"[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"[A-Z]{{2}}[0-9]{{2}}(?<![{_WORD}].{{4}})(?:{_ACCOUNT})(?![{_WORD}])",
    "ssn": rf"[0-9]{{3}}-(?<![{_WORD}].{{4}})[0-9]{{2}}-[0-9]{{4}}(?![{_WORD}])",
}
#: The same as plain patterns, for engines without lookbehind.
PLAIN = PATTERNS | {
    "email": rf"[{_NAME}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "iban": rf"\b[A-Z]{{2}}[0-9]{{2}}(?:{_ACCOUNT})\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: What a text with a match contains.
_SIGNS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Areas, groups and serials that aren't given out.
NO_SSN = "^(?:000|666|9)|-00-|0000$"
WORDS = {
    "email": "mail|contact|kontakt|courriel|correo|write to|schreib|adresse",
    "ip": "address|server|host|login|adresse|connect|anschluss|conexi",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment|cvv|cvc",
    "phone": "phone|call|tel|fax|mobile|handy|fon|llam|appel",
    "iban": "iban|account|bank|konto|compte|cuenta|bic|swift",
    "ssn": "ssn|social security|sozialversicherung|insurance|tax id|taxpayer|seguridad social|curit. sociale",
}
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
NEARBY, CONTEXT, LEAST = 0.3, 48, 0.5
SPAN = "struct<start:int,k:int,kind:string,end:int,score:double,value:string>"
_BLOCK = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether from the right every second digit doubled (less 9 above 9) and the others add up to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


def passes_mod97(code: Column) -> Column:
    """Whether an account number of capital letters and digits leaves 1 when divided by 97: its first four characters
    last, letters as 10 to 35."""
    compact = F.replace(code, F.lit(" "), F.lit(""))
    value = F.transform(F.split(F.concat(F.substring(compact, 5, 64), F.left(compact, F.lit(4))), ""), lambda c: F.ascii(c) - F.when(c < "A", 48).otherwise(55))
    rest = F.aggregate(value, F.lit(0), lambda r, v: (r * F.when(v < 10, 10).otherwise(100) + v) % 97)
    return (rest == 1) & F.char_length(compact).between(15, 34)


def confirmed(kind: str, hit: Column) -> Column:
    """How many of a match's characters are confirmed: all, none, or of an account number all but a last short group."""
    size = F.char_length(hit)
    if kind == "ip":
        return F.when(hit.rlike(IP_PARTS), size).otherwise(0)
    if kind == "card":
        return let(_digits(hit), lambda d: F.when(F.char_length(d).between(14, 19), F.when(passes_luhn(d), size).otherwise(0)).otherwise(0))
    if kind == "phone":
        return F.when(F.char_length(_digits(hit)).between(10, 15), size).otherwise(0)
    if kind == "iban":
        shorter = F.regexp_replace(hit, "\x20[A-Z0-9]{1,3}$", "")
        return F.when(passes_mod97(hit), size).when(F.contains(hit, F.lit(" ")) & passes_mod97(shorter), F.char_length(shorter)).otherwise(0)
    if kind == "ssn":
        return F.when(hit.rlike(NO_SSN), 0).otherwise(size)
    return size


def running(sizes: Column) -> Column:
    """Of each number the sum of those before it: by blocks, whose own sums come first."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int"))
    block = lambda b: F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))
    grown = lambda values, first: F.aggregate(values, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda s, x: s + x))
    cut = lambda a: F.slice(a, F.lit(1), F.size(a) - 1)
    return let(grown(sums, F.lit(0)), lambda o: F.flatten(F.transform(blocks, lambda b: cut(grown(block(b), F.get(o, b))))))


def _near(kind: str, before: Column, after: Column) -> Column:
    around = F.concat(F.right(before, F.lit(CONTEXT)), F.lit("\n"), F.left(after, F.lit(CONTEXT)))
    return F.translate(around, _UPPER, _LOWER).rlike(WORDS[kind])


def kind_spans(text: Column, kind: str, least: float = LEAST) -> Column:
    """The spans of one kind in a text, in order, as SPAN."""
    none = F.array().cast(f"array<{SPAN}>")

    def of_hits(hits: Column) -> Column:
        def of_gaps(gaps: Column) -> Column:
            ends = running(F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.char_length(h)))

            def span(hit: Column, i: Column, offset: Column) -> Column:
                start = offset + F.char_length(F.get(gaps, i))
                score = F.lit(SCORES[kind]) + F.when(_near(kind, F.get(gaps, i), F.get(gaps, i + 1)), NEARBY).otherwise(0.0)
                made = lambda n: F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.lit(kind).alias("kind"), (start + n).alias("end"), F.round(score, 2).alias("score"), F.left(hit, n).alias("value"))
                return let(confirmed(kind, hit), lambda n: F.when(n > 0, made(n)))

            found = let(ends, lambda e: F.array_compact(F.transform(hits, lambda h, i: span(h, i, F.get(e, i)))))
            return found if kind in BASE else F.filter(found, lambda s: s["score"] >= least)

        return F.when(F.size(hits) > 0, let(F.split(text, PATTERNS[kind], -1), of_gaps)).otherwise(none)

    every = let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), of_hits)
    return F.when(F.contains(text, F.lit(_SIGNS[kind])), every).otherwise(none) if kind in _SIGNS else every


def spans(text: Column, least: float = LEAST) -> Column:
    """All spans of a text, by start and kind."""
    return F.sort_array(F.concat(*[kind_spans(text, kind, least) for kind in KINDS]))


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and its spans (start, k, kind, end, score, value) for every row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans(F.coalesce("text", F.lit("")), least).alias("spans"))


def span_report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of scan()'s spans."""
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scanned.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, kind: str, least: float = LEAST) -> Column:
    """The text with the confirmed spans of one kind replaced by the kind's name in brackets."""
    mark = f"[{kind.upper()}]"

    def of_hits(hits: Column) -> Column:
        def of_gaps(gaps: Column) -> Column:
            def put(hit: Column, i: Column) -> Column:
                sure = F.lit(True) if kind in BASE or SCORES[kind] >= least else _near(kind, F.get(gaps, i), F.get(gaps, i + 1))
                return F.concat(F.get(gaps, i), let(confirmed(kind, hit), lambda n: F.when((n > 0) & sure, F.concat(F.lit(mark), F.substring(hit, n + 1, F.char_length(hit)))).otherwise(hit)))

            return F.concat(F.array_join(F.transform(hits, put), ""), F.element_at(gaps, -1))

        return F.when(F.size(hits) > 0, let(F.split(text, PATTERNS[kind], -1), of_gaps)).otherwise(text)

    return let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), of_hits)


def redact(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs with personal data replaced, kind by kind; null texts stay null, n_chars (where there is one) follows."""
    out = docs
    for kind in ("iban", "card", "phone", "ip", "ssn", "email"):
        out = out.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"), kind, least)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)
