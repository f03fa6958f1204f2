"""Licence scans: equivalent spellings and layouts meet, other texts don't."""

import os

import pytest

from cadenza.llm.license_texts import DIGESTS, LICENSES, TITLES
from cadenza.llm.licenses import known_digests, license_scan

KNOWN = dict(LICENSES)
FOLDER = "/usr/share/common-licenses"

SCHEMA = "doc_id long, text string, license string"


def test_whole_texts_and_notices(spark):
    mit, isc = KNOWN["MIT"], KNOWN["ISC"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Ann Other\n  (C) 2021 Someone\n" + mit.upper().replace(", ", ",\n *  ")),
        (3, mit.replace("sublicense", "sub-licence").replace("License", "Licence")),
        (4, mit + " extra"),
        (5, isc + "\nAll rights reserved."),
        (6, "prose\nLicensed under the Apache License, Version 2.0.\nmore\n  released under the MIT licence\n"),
        (7, "prose Released under the MIT License."),
        (8, None), (8, ""), (None, " \n"), (9, "licence " * 50_000), (1, mit),
    ]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = license_scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].license for i in (1, 2, 3, 4, 5, 7, 8, 9, None)] == ["MIT", "MIT", "MIT", None, "ISC", None, None, None, None]
    assert by[6].notices == "Apache-2.0,MIT" and by[7].notices == "" and by[8].digest == by[None].digest
    assert license_scan(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = license_scan(spark.createDataFrame([(1, "a", "b")], SCHEMA))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def wrapped(text, width, mark):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = ""
        line += f" {word}" if line else word
    return "\n".join(mark + x for x in [*lines, line])


def test_titles_layouts_and_lines_that_begin_with_copyright(spark):
    rows = [(f"{name} {width} {t}", name, (f"{TITLES[name]}\n\nCopyright (c) 2019, Ann\n\n" if t and name in TITLES else "") + wrapped(text, width, mark)) for name, text in LICENSES for width, mark in ((60, ""), (72, " * "), (77, "# ")) for t in (False, True)]
    assert any("\ncopyright" in text.lower() for _, _, text in rows)
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in license_scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [name for _, name, _ in rows]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no folder of licences")
def test_known_digests_are_those_of_the_published_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [(i, open(f"{FOLDER}/{f}").read()) for i, f in enumerate(names) if os.path.exists(f"{FOLDER}/{f}")]
    got = {r.doc_id: r.license for r in license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: name for i, name in enumerate(names.values()) if i in dict(texts)}
    assert {name for name, _ in DIGESTS} >= set(names.values())


def test_licences_as_a_table(spark):
    docs = spark.createDataFrame([(1, "Own licence, 1st edition"), (2, "other")], "doc_id long, text string")
    own = known_digests(spark, [("Own", "own license 1st Edition")])
    assert {r.doc_id: r.license for r in license_scan(docs, licenses=own).collect()} == {1: "Own", 2: None}
