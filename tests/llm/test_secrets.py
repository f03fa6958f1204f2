"""Secret scans: the base patterns by plain matching, structural confirmation, redaction."""

import base64
import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from cadenza.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tlv(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (b"\x82" + len(body).to_bytes(2, "big"))
    return bytes([tag]) + size + body


def integer(n, byte=b"\x11"):
    return tlv(2, byte * n)


ALGORITHM = tlv(0x30, tlv(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), tlv(5))
CURVE = tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07"))


def rsa_key(n=256):
    return tlv(0x30, integer(1, b"\x00"), integer(n), integer(3), integer(n), *[integer(n // 2)] * 5)


def private_keys():
    sec1 = tlv(0x30, integer(1, b"\x01"), tlv(4, b"s" * 32), CURVE, tlv(0xA1, tlv(3, b"\x00" + b"p" * 65)))
    return {
        "rsa": rsa_key(),
        "pkcs8": tlv(0x30, integer(1, b"\x00"), ALGORITHM, tlv(4, rsa_key(128))),
        "pkcs8 encrypted": tlv(0x30, ALGORITHM, tlv(4, b"e" * 700)),
        "sec1": sec1,
        "pkcs8 ed25519": tlv(0x30, integer(1, b"\x00"), tlv(0x30, tlv(6, b"\x2b\x65\x70")), tlv(4, tlv(4, b"s" * 32))),
        "dsa": tlv(0x30, integer(1, b"\x00"), integer(128), integer(20), integer(128), integer(127), integer(20)),
        "openssh": openssh_key(),
    }


def look_alikes():
    field = lambda b: len(b).to_bytes(4, "big") + b
    return {
        "spki": tlv(0x30, ALGORITHM, tlv(3, b"\x00" + tlv(0x30, integer(256), integer(3)))),
        "rsa public": tlv(0x30, integer(256), integer(3)),
        "certificate": tlv(0x30, tlv(0x30, tlv(0xA0, integer(1)), integer(8), ALGORITHM, tlv(0x30, tlv(0x31, ALGORITHM))), ALGORITHM, tlv(3, b"s" * 257)),
        "octets": tlv(0x30, integer(1, b"\x01"), tlv(4, b"z" * 33)),
        "octets and no curve": tlv(0x30, integer(1, b"\x01"), tlv(4, b"z" * 32)),
        "three integers": tlv(0x30, integer(1), integer(64), integer(3)),
        "eight integers": tlv(0x30, integer(1, b"\x00"), *[integer(64)] * 7),
        "signature": tlv(0x30, integer(32), integer(32)),
        "ssh public": field(b"ssh-ed25519") + field(b"k" * 32),
        "ssh rsa public": field(b"ssh-rsa") + field(b"\x01\x00\x01") + field(b"n" * 257),
        "length beyond": rsa_key()[:-1],
    }


def test_private_keys_and_look_alikes():
    for encode in (base64.b64encode, base64.urlsafe_b64encode, lambda d: d.hex().encode(), lambda d: d.hex().upper().encode()):
        for name, data in private_keys().items():
            data = data[:-9] + b"\xff\xef\xfe\x3e\xfb" + data[-4:] if name == "pkcs8 encrypted" else data  # signs of both alphabets
            key = encode(data).decode()
            assert [(a, b) for _, a, b in secrets.confirmed_spans(f"k {key} z")] == [(2, 2 + len(key))], name
        for name, data in look_alikes().items():
            assert secrets.confirmed_spans(f"k {encode(data).decode()} z") == [], name


def test_a_key_with_more_behind_it_is_a_key():
    """Its own lengths say where it ends: what stands directly behind is left."""
    key = rsa_key()
    for encode, end in ((base64.b64encode, -(-len(key) * 8 // 6)), (lambda d: d.hex().encode(), 2 * len(key))):
        text = f"k {encode(key + bytes(3)).decode()} z"
        assert [(a, b) for _, a, b in secrets.confirmed_spans(text)] == [(2, 2 + end)]


def test_no_byte_of_a_wrapped_key_stays():
    for name, data in private_keys().items():
        for width in (64, 70, 76):
            for end in ("\n", "\r\n", "\n  ", "\\n"):
                key = wrapped(data, width, end)
                text = f"x{end}-----BEGIN PRIVATE KEY-----{end}{key}{end}-----END PRIVATE KEY-----{end}y"
                assert secrets.redacted(text) == text.replace(key, "[SECRET]"), (name, width, end)


def brute_spans(text):
    """Every run of one alphabet that decodes whole to a private key, by trying all of them."""
    found = set()
    for alphabet, decode in (("A-Za-z0-9+/", base64.b64decode), ("A-Za-z0-9_-", base64.urlsafe_b64decode)):
        for m in re.finditer(f"[{alphabet}]{{40,}}={{0,2}}", text):
            data = decode(m[0].rstrip("=") + "=" * (-len(m[0].rstrip("=")) % 4))
            found |= {("keyblob" if name == "openssh" else "der", *m.span()) for name, key in private_keys().items() if data == key}
    for m in re.finditer("(?:[0-9a-fA-F]{2}){24,}", text):
        found |= {("keyblob" if name == "openssh" else "der", *m.span()) for name, key in private_keys().items() if bytes.fromhex(m[0]) == key}
    return sorted(found, key=lambda s: s[1])


def test_added_spans_against_brute_force():
    rng = random.Random(6)
    every = [*private_keys().values(), *look_alikes().values(), b"noise" * 30, bytes(range(256))]
    for _ in range(60):
        text = ""
        for _ in range(rng.randrange(1, 8)):
            encode = rng.choice([base64.b64encode, base64.urlsafe_b64encode, lambda d: d.hex().encode()])
            text += rng.choice([" word ", "\u00e9 ", " 🙂", "; ", ", a-long-name-of-words-with-hyphens-in-it "]) + encode(rng.choice(every)).decode()
        text += " end"
        assert secrets.confirmed_spans(text) == brute_spans(text)


def plain_base(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_and_confirmed(spark):
    key = base64.b64encode(rsa_key(32)).decode()
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.c2ln"
    blob = base64.b64encode(openssh_key()).decode()
    texts = [
        None, "", "no secrets here", 'PASSWORD = "hunter22" and token: abc', "é🙂 api_key:abcdef AKIA" + "A1" * 9, "0123456789abcdef01234567 x", f"{key} tail", f"a {token} b", blob,
        "QUJD" * 20, "30" + "82" * 30, "ſecret=abcdefgh paſſword: abcdefg", "secret=" + "f" * 30, rsa_key(32).hex(), "x" * 200_000 + " passwd: 123456", "ey" + "." * 50,
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in secrets.span_report(secrets.scan(docs)).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert got[6].spans == f"der:0:{len(key)}" and got[7].spans == f"token:2:{2 + len(token)}" and got[8].spans.startswith("keyblob:0:")
    assert got[9].spans == got[10].spans.replace("hex:0:62", "") == "" and "der:0:" in got[13].spans


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a password=hunter22 b", "en", "s", 21), (2, None, None, None, None), (3, "clean", "en", "s", 5)], SCHEMA)
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "a [SECRET] b", 12), (2, None, None), (3, "clean", 5)}
    assert secrets.span_report(secrets.scan(docs.limit(0))).collect() == []
    clash = docs.withColumns({c: F.lit("password=hunter22") for c in ("spans", "kind", "start", "end")})
    assert secrets.redact(clash).columns == clash.columns and secrets.redact(clash).first().spans == "password=hunter22"
    assert secrets.span_report(secrets.scan(clash)).collect() == secrets.span_report(secrets.scan(docs)).collect()


def openssh_key(private=301):
    field = lambda b: len(b).to_bytes(4, "big") + b
    public = field(b"ssh-ed25519") + field(b"k" * 32)
    return b"openssh-key-v1\x00" + field(b"none") + field(b"none") + field(b"") + b"\x00\x00\x00\x01" + field(public) + field(b"p" * private)


def wrapped(data, width, end):
    run = base64.b64encode(data).decode()
    return end.join(run[i : i + width] for i in range(0, len(run), width))


def test_wrapped_keys():
    for kind, data in (("der", rsa_key()), ("der", b"\x30\x82\x04\x00" + rsa_key()[4:]), ("keyblob", openssh_key()), ("keyblob", openssh_key(302)), ("keyblob", openssh_key(303))):
        whole = data[:4] == rsa_key()[:4] or kind == "keyblob"
        for width in (64, 70, 76):
            for end in ("\n", "\r\n", "\n    ", "\\n"):
                key = wrapped(data, width, end)
                for before, after in (("", ""), (f"-----BEGIN KEY-----{end}", f"{end}-----END KEY-----"), (f"note {'Q' * 64}{end}", ""), ("", end if "=" in key else f"{end}end of it")):
                    want = [(kind, len(before), len(before) + len(key))] if whole else []
                    assert secrets.confirmed_spans(before + key + after) == want, (kind, width, end, before, after)
    text = f"a\n{wrapped(rsa_key(), 64, chr(10))}\nb"
    assert secrets.redacted(text) == "a\n[SECRET]\nb"
    assert secrets.confirmed_spans("\n".join(["A" * 76] * 20_000)) == []


def test_tokens_behind_other_letters():
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'x'})}.c2ln"
    for before in ("key_", "monkey-", "x.keyvalues.", "they_obeyed.", "", "a=", "eyeyeyeyeyey"):
        assert secrets.confirmed_spans(f"{before}{token} b") == [("token", len(before), len(before + token))], before


def wrapped_forms(key):
    b64, digits = base64.b64encode(key).decode(), key.hex()
    cut = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    lines = cut(b64, 64)
    yield "mail quote", "\n".join("> " + x for x in lines), 2
    yield "literals by plus", " +\n    ".join(f'"{x}"' for x in lines), 1
    yield "literals by backslash", " \\\n  ".join(f'"{x}"' for x in lines), 1
    yield "blanks", " ".join(lines), 0
    yield "carriage returns", "\r".join(lines), 0
    yield "comments", "\n".join("# " + x for x in lines), 2
    yield "16 columns", "\n".join(cut(b64, 16)), 0
    yield "19 columns", "\n".join(cut(b64, 19)), 0
    yield "hex", digits, 0
    yield "hex in lines", "\n".join(cut(digits, 60)), 0
    yield "colon hex", ":".join(cut(digits, 2)), 0
    yield "colon hex in lines", ":\n    ".join(":".join(cut(x, 2)) for x in cut(digits, 30)), 0
    yield "spaced hex", " ".join(cut(digits.upper(), 2)), 0
    yield "one more digit", "f" + digits, 1
    if len(key) % 3 == 0:
        yield "letters behind", b64 + "QUJDREVG", 0


def test_keys_as_they_stand_in_mails_and_code():
    for name, key in private_keys().items():
        key = key if name == "openssh" else key
        for form, text, lead in wrapped_forms(key):
            whole = f"see below\n\n{text}\n\nthanks, bye"
            found = [s for s in secrets.confirmed_spans(whole) if s[0] in ("der", "keyblob")]
            at = whole.index(text)
            assert found and found[0][1] <= at + lead and found[0][2] >= at + len(text) - (8 if form == "letters behind" else 1), (name, form, found)
    for name, key in look_alikes().items():
        for form, text, _ in wrapped_forms(key):
            if (name, form) != ("length beyond", "letters behind"):  # the letters are the bytes that it lacks
                assert not [s for s in secrets.confirmed_spans(text) if s[0] in ("der", "keyblob")], (name, form)


def test_work_grows_with_the_text():
    """Runs that open a token or key at every place: the number of decodings stays four a run."""
    calls = []
    plain = secrets._url_decoded
    try:
        secrets._url_decoded = lambda part: calls.append(len(part)) or plain(part)
        secrets.spans("ey" * 200_000 + ".eyJhIjoxfQ.abc")
    finally:
        secrets._url_decoded = plain
    assert len(calls) == 5 and sum(calls) < 5 * 400_000
    assert secrets.spans("30" * 100_000)[0][0] == "hex" and secrets.spans("M" * 300_000) == []
