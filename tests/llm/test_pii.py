"""Personal data: base spans by plain matching, checksums, context, redaction, odd tables."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cadenza.llm import pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.BASE.index(s[0])))


def iban(country, rest):
    code = rest + country + "00"
    number = int("".join(str(int(c, 36)) for c in code))
    return f"{country}{98 - number % 97:02d}{rest}"


def scanned(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.spans for r in pii.scan(docs).collect()}


def test_base_spans_equal_plain_matching(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "a@b", "x_y@ex-1.org.uk", "@", "..", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "999", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "411111111111111111111111", "+1 (212) 555-0199", "+4", "+12 34 (((((", "+49.30.1234567", "é", "🙂", " ", " ", "\n", "-", "9", "12 34", "+", "ß@ä.de"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(400)] + ["", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    rows = {r.doc_id: r for r in pii.span_report(pii.scan(docs)).collect()}
    for i, text in enumerate(texts):
        want = plain_base(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text, want, rows[i].spans)
        assert [rows[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]


def test_account_and_security_numbers(spark):
    good = [iban("DE", "370400440532013000"), iban("GB", "WEST12345698765432"), iban("NO", "86011117947")]
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    texts = [f"pay {g} now" for g in good] + [f"pay {spaced(g)} now" for g in good] + [f"to {spaced(good[1])} AND more", f"to {spaced(good[1])} USD", good[0][:-1] + str((int(good[0][-1]) + 1) % 10), "x" + good[0], good[0] + "_", good[0].lower()]
    texts += ["my SSN is 123-45-6789.", "part 123-45-6789 of it", "ssn 000-45-6789, ssn 666-45-6789, ssn 912-45-6789, ssn 123-00-6789, ssn 123-45-0000", "ssn 1123-45-67890"]
    got = {i: [(s.kind, s.value) for s in spans if s.kind in ("iban", "ssn")] for i, spans in scanned(spark, texts).items()}
    for i, g in enumerate(good):
        assert got[i] == [("iban", g)] and got[i + 3] == [("iban", spaced(g))]
    assert got[6] == got[7] == [("iban", spaced(good[1]))]
    assert all(got[i] == [] for i in range(8, 12))
    assert got[12] == [("ssn", "123-45-6789")] and all(got[i] == [] for i in (13, 14, 15))


def test_words_nearby_move_scores(spark):
    got = scanned(spark, ["my card: 4111111111111111", "number 4111111111111111", "4111111111111111 is my Visa", "card " + "x " * 60 + "4111111111111111"])
    assert [got[i][0].score for i in range(4)] == [0.9, 0.6, 0.9, 0.6]


def test_long_texts_and_many_matches(spark):
    """Places are summed by blocks; runs that no match ends are read once."""
    many = "a@b.cc " * 5_000
    texts = [many, "1" * 300_000, "a" * 300_000, "a@" * 100_000, "+1" + "(" * 200_000, "1.2." * 50_001, "🙂" * 70_000 + " 10.0.0.1"]
    got = scanned(spark, texts)
    assert [(s.start, s.end) for s in got[0]] == [(7 * i, 7 * i + 6) for i in range(5_000)]
    assert got[1] == got[2] == got[3] == got[4] == [] and len(got[5]) == 25_000
    assert [(s.kind, s.start, s.end) for s in got[6]] == [("ip", 70_001, 70_009)]
    assert pii.span_report(pii.scan(spark.createDataFrame([], SCHEMA))).collect() == []


def test_redaction(spark):
    rows = [(1, "mail a@b.cc or +1 212 555 0199, card 4111 1111 1111 1111 and 10.0.0.1!", "en", "s", 5), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, "nothing 999.1.1.1", "en", "s", 1), (4, "nothing 999.1.1.1", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("spans", "kind", "value", "score")})
    got = pii.redact(docs)
    assert got.columns == docs.columns
    texts = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text is not None)
    line = "mail [EMAIL] or [PHONE], card [CARD] and [IP]!"
    assert texts == [(1, line, len(line)), (3, "", 0), (4, "nothing 999.1.1.1", 17), (4, "nothing 999.1.1.1", 17)]
    assert pii.scan(docs).count() == 5
