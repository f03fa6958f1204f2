"""WARC: round trips, revisits, salvage."""

import base64
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from cadenza.llm import warc

SCHEMA = "page_id long, url string, html string"
DIGEST = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def test_round_trip(spark):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(32, 5000)) for _ in range(300_000))
    rows = [(i, f"http://a.org/{i}", rng.choice(["", "<p>é</p>", "\r\n\r\nWARC/1.1\r\n", "x\x00y", f"own {i}"])) for i in range(80)]
    rows += [(500, None, None), (None, "http://b.org/ü\r\nX: y", "<p>é</p>"), (None, None, "lone"), (501, "u", noise), (7, "http://again", rows[7][2])]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = best[h] >= 0 and i != best[h]
        want.append((i, len(h.encode()), DIGEST(h), "revisit" if revisit else "response", best[h] if revisit else None))
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_payloads_stay(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "v", "aa"), (3, "w", "long enough"), (4, "x", "long enough")], SCHEMA)
    warc.write_warc(pages, str(tmp_path / "w"), least_bytes=5)
    rows = warc.read_warc(spark, str(tmp_path / "w"))
    assert {(r.page_id, r.record_type, r.refers_to) for r in rows.collect()} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}
    assert {r.page_id: bytes(r.payload or b"") for r in rows.collect()} == {1: b"aa", 2: b"aa", 3: b"", 4: b"long enough"}
    assert rows.filter(F.col("gap_bytes").isNotNull()).count() == 0


def records(n):
    return [warc.record_bytes(i, f"http://x/{i}", f"page {i}".encode() * 50, None) for i in range(n)]


def salvage(data):
    good, gaps = [], []
    for at, headers, _, gap, why in warc.salvaged(data):
        good.append(headers["warc-record-id"]) if headers else gaps.append((at, gap, why))
    return [int(g[12:-1]) for g in good], gaps


def test_salvage_of_members_and_plain_records():
    for wrap in (warc.gzip_member, lambda r: r):
        parts = [wrap(r) for r in records(6)]
        assert salvage(b"".join(parts)) == (list(range(6)), [])
        hurt = bytearray(b"".join(parts))
        begin = len(parts[0]) + len(parts[1])
        for k in range(begin + 20, begin + 60):
            hurt[k] ^= 0x5A
        good, gaps = salvage(bytes(hurt))
        assert good == [0, 1, 3, 4, 5] and [(g[0], g[1]) for g in gaps] == [(begin, len(parts[2]))]
        good, gaps = salvage(b"junk \x1f\x8b\x08 WARC/1.1\r\n" + b"".join(parts[:2]) + b"??" + parts[2] + parts[3][:-9])
        assert good == [0, 1, 2] and len(gaps) == 3 and gaps[1][1] == 2
    assert salvage(b"") == ([], []) and salvage(b"nothing") == ([], [(0, 7, "no member or version line")])


def test_wrong_digest_is_quarantined():
    r = records(2)
    bad = r[0].replace(b"page 0", b"page 9", 1)
    assert salvage(warc.gzip_member(bad) + warc.gzip_member(r[1]))[0] == [1]


def test_members_of_several_records():
    r = records(8)
    bad = r[3].replace(b"page 3", b"page 9", 1)
    good, gaps = salvage(warc.gzip_member(b"".join([*r[:3], bad, *r[4:6]])) + warc.gzip_member(b"".join(r[6:])))
    assert good == [0, 1, 2, 4, 5, 6, 7]
    assert [g[:2] for g in gaps] == [(0, len(bad))] and gaps[0][2].endswith(f"from byte {sum(map(len, r[:3]))} of the member's content")


def test_records_before_the_damage_of_a_member():
    rng = random.Random(3)
    r = [warc.record_bytes(i, "u", rng.randbytes(3_000), None) for i in range(8)]
    for level in (0, 4):
        whole, after = warc.gzip_member(b"".join(r[:6]), level), warc.gzip_member(r[6], level) + warc.gzip_member(r[7], level)
        cut = whole[: len(whole) * 3 // 4]
        for hurt in (cut, cut + b"\xff" * 40 + whole[len(cut) + 40 :]):
            good, gaps = salvage(hurt + after)
            assert good[:4] == [0, 1, 2, 3] and good[-2:] == [6, 7] and len(good) == len(set(good)) and gaps
            if level:  # stored content is read on beyond the damage
                assert len(gaps) == 1 and len(hurt) / 2 < gaps[0][0] and gaps[0][0] + gaps[0][1] == len(hurt)
        begin = whole.index(zlib.crc32(b"".join(r[:6])).to_bytes(4, "little"))
        assert salvage(whole[:begin] + b"\x00\x00\x00\x00" + whole[begin + 4 :] + after)[0] == list(range(8))
    bare = [x.replace(b"WARC-Payload-Digest", b"X-P").replace(b"WARC-Block-Digest", b"X-B") for x in r[:3]]
    member = warc.gzip_member(b"".join(bare))
    begin = member.index(zlib.crc32(b"".join(bare)).to_bytes(4, "little"))
    assert salvage(member)[0] == [0, 1, 2] and salvage(member[:begin] + b"\x00\x00\x00\x00" + member[begin + 4 :])[0] == []


def test_empty_and_clashing_columns(spark):
    clash = {c: F.lit("clash") for c in ("payload", "sha1", "keeps", "file", "value", "member")}
    assert warc.round_trip(spark.createDataFrame([], SCHEMA).withColumns(clash)).collect() == []
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], SCHEMA)
    assert sorted(warc.round_trip(pages.withColumns(clash)).collect()) == sorted(warc.round_trip(pages).collect())


def test_archives_end_at_their_size(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://a.org/{i}", rng.randbytes(1_000).hex()) for i in range(60)] + [(99, "u", rng.randbytes(40_000).hex())]
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"), file_bytes=20_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").rglob("part-*"))
    assert len(sizes) >= 5 and sizes[-2] <= 20_000 < sizes[-1]
    records, gaps = warc.salvage(spark, str(tmp_path / "w"))
    assert sorted(r.page_id for r in records.collect()) == [r[0] for r in rows] and gaps.count() == 0


def test_quarantine_log(spark, tmp_path):
    parts = [warc.gzip_member(r) for r in records(5)]
    (tmp_path / "a").write_bytes(b"".join(parts[:2]) + b"??" + parts[2])
    (tmp_path / "b").write_bytes(parts[3][:60] + parts[4])
    records_, gaps = warc.salvage(spark, str(tmp_path))
    assert sorted(r.page_id for r in records_.collect()) == [0, 1, 2, 4]
    assert sorted((r.archive[-1], r.at, r.gap_bytes) for r in gaps.collect()) == [("a", len(parts[0]) + len(parts[1]), 2), ("b", 0, 60)]


def test_work_follows_the_records(monkeypatch):
    """Four times as many records in one file: four times as many bytes are given to the inflater, no more than twice each."""
    rng = random.Random(5)
    part = [warc.gzip_member(warc.record_bytes(i, "u", rng.randbytes(4_000), None)) for i in range(500)]
    plain, given = zlib.decompressobj, []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def decompress(self, data):
            given.append(len(data))
            return self.inner.decompress(data)

    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *how: Counted(plain(*how)))
    for n in (1, 4):
        data = b"".join(part * n)
        given.clear()
        assert sum(1 for _ in warc.salvaged(data)) == 500 * n
        assert len(data) <= sum(given) <= 2 * len(data) + 8_192 * 500 * n
