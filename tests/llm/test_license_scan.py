"""Licence phrases and expressions."""

import re

import pytest

from scanloom.llm import license_scan

SCHEMA = "doc_id long, text string, labels string, score int"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "Released under the MIT License.", "under the mit license under the mit license under", "CC BY-NC 4.0, cc  by\nnc", "CC BY NC BY NC cc by nc",
    "Apache License, Version 2.0", "undér the mit license", "under the mit licenses", None, "", "...", "x" * 300000 + " under the mit license", "w " * 100000 + "cc by nc",
    "İ under THE mit LICENSE ß", "a\x00under\x7fthe{mit}license", "cc by nc sa, cc by sa", "Under the MIT licence",
]


def test_base_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None), (0, TEXTS[0], "x", 1)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(str((r[0], *brute(r[1]))) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_empty_table(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text, names, degree", [
    ("MIT", ["mit"], 1.0),
    ("GPL-2.0-only OR MIT", ["gpl-2.0-only", "mit"], 1.0),
    ("GPL-2.0-only AND MIT", ["gpl-2.0-only", "mit"], 0.3),
    ("MIT OR GPL-2.0 AND LGPL-2.1", ["gpl-2.0", "lgpl-2.1", "mit"], 1.0),  # and binds closer
    ("(MIT OR GPL-2.0) AND LGPL-2.1", ["gpl-2.0", "lgpl-2.1", "mit"], 0.5),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0"], 0.5),
    ("GPL-2.0 WITH Classpath-exception-2.0 OR CC-BY-NC-4.0", ["cc-by-nc-4.0", "gpl-2.0"], 0.5),
    ("MIT AND", ["mit"], 1.0),
    ("((MIT", ["mit"], 1.0),
    ("MIT) OR GPL-2.0", ["mit"], 1.0),
    ("MIT GPL-2.0", ["mit"], 1.0),
    ("LicenseRef-own", ["licenseref-own"], 0.4),
])
def test_expressions(text, names, degree):
    found = license_scan.evaluate(text)
    assert found.valid and found.names == names and found.degree == pytest.approx(degree)


@pytest.mark.parametrize("text", ["", "AND MIT", ")", "()", "*/"])
def test_no_expression(text):
    assert not license_scan.evaluate(text).valid


def test_tags(spark):
    row = license_scan.Scanner().scan("# SPDX-License-Identifier: (Apache-2.0 OR GPL-3.0-or-later) AND BSD-3-Clause\nint x;")
    assert row["labels"] == "apache-2.0,bsd-3-clause,gpl-3.0-or-later" and row["score"] == 1.0 and row["n_base"] == 0
    assert license_scan.Scanner().scan("license: none of it")["labels"] == ""


@pytest.mark.parametrize("text, labels", [
    ("EPL-2.0", "epl-2.0"), ("EPL-2.0 OR Artistic-2.0", "artistic-2.0,epl-2.0"), ("PostgreSQL", "postgresql"), ("WTFPL */", "wtfpl"),
    ("LicenseRef-own", "licenseref-own"), ("(CDDL-1.0 OR GPL-2.0-only) AND OFL-1.1", "cddl-1.0,gpl-2.0-only,ofl-1.1"),
])
def test_tags_outside_the_known_families(text, labels):
    for tag in ("SPDX-License-Identifier:", "License-Expression:"):
        row = license_scan.Scanner().scan(f"// {tag} {text}\nint x;")
        assert row["labels"] == labels and row["score"] == 0.4
    assert license_scan.Scanner().scan("license: see the file")["labels"] == ""


def test_expressions_are_read_to_the_end_of_the_line():
    scan = license_scan.Scanner().scan
    long = "SPDX-License-Identifier: MIT" + " AND MIT" * 1000 + " AND GPL-2.0-only\nAND Zlib"
    assert scan(long)["labels"] == "gpl-2.0-only,mit" and scan(long)["score"] == 0.3
    padded = "SPDX-License-Identifier:" + " " * 5000 + "Apache-2.0"
    assert scan(padded)["labels"] == "apache-2.0"
    for pad in range(1960, 2000):  # no identifier is cut in two
        assert scan("SPDX-License-Identifier:" + " " * pad + "GPL-2.0-only")["labels"] == "gpl-2.0-only"
    many = "license: mit " * 100_000  # one line with many tags
    assert scan(many)["labels"] == "mit"


@pytest.mark.parametrize("text, labels, score", [
    ("License: MIT. And then we went home.", "mit", 1.0),
    ("license: mit and enjoy the rest", "mit", 1.0),
    ("/* SPDX-License-Identifier: MIT */ or see the file", "mit", 1.0),
    ("License: MIT, or later by hand", "mit", 1.0),
    ("license: mit or ms-pl", "mit,ms-pl", 1.0),
    ("license: mit and gpl-2.0 and so on", "gpl-2.0,mit", 0.3),
    ("license: mit and (gpl-2.0", "gpl-2.0,mit", 0.3),
    ("SPDX-License-Identifier: MIT AND PostgreSQL; AND GPL-2.0", "mit,postgresql", 0.4),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", "gpl-2.0", 0.5),
    ("SPDX-License-Identifier: MIT é AND GPL-2.0", "mit", 1.0),
])
def test_expressions_end_where_prose_begins(text, labels, score):
    row = license_scan.Scanner().scan(text)
    assert row["labels"] == labels and row["score"] == pytest.approx(score)
