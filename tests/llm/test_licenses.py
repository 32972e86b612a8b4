import textwrap
from pathlib import Path

import pytest

from pulsegrid.llm import licenses


def test_equivalent_forms_have_one_digest(spark):
    mit = licenses.KNOWN[0][1]
    changed = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace("\n", "  \n\t").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace(",", " ,").replace("SUBLICENSE", "SUBLICENCE")
    rows = [
        (1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (6, "Text.\n  released under the MIT Licence \nmore\nLicensed under CC BY-NC 4.0."), (6, "Licensed under the Apache License, Version 2.0."), (7, "x " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (None, "Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, digest string, license_id int")
    got = sorted(((r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan_licenses(docs).collect()), key=repr)
    assert got == sorted(
        [(1, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (6, None, "CC-BY-NC-4.0,MIT"), (6, "Apache-2.0", "Apache-2.0"), (7, None, "CC-BY-NC-4.0"), (None, "CC-BY-4.0", "CC-BY-4.0")],
        key=repr,
    )
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_one_line_notices_hold_the_stem():
    assert all("licen" in text.lower() for _, text in licenses.KNOWN if "\n" not in text)


def identified(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]


def test_wrapping_and_titles_do_not_matter(spark):
    mit, isc, zero = (licenses.KNOWN[i][1] for i in range(3))
    one = " ".join(mit.split())
    wrapped = [textwrap.fill(mit, w) for w in range(20, 140, 3)]
    assert any(line.startswith("COPYRIGHT HOLDERS") for t in wrapped for line in t.split("\n"))
    heads = ["MIT License\n\n", "The MIT License (MIT)\r\n", "Copyright (c) 2020 A\nCopyright 2021 by B. All rights reserved.\nAll rights reserved.\n", "MIT License\n\nCopyright © <year> <name>\n(c) 2019 C\n"]
    assert identified(spark, [one, *wrapped, *(h + one for h in heads)]) == ["MIT"] * (1 + len(wrapped) + len(heads))
    assert identified(spark, ["ISC License\n\n" + textwrap.fill(isc, 60), textwrap.fill(zero, 50)]) == ["ISC", "0BSD"]
    others = ["MIT License", "Copyright holders pay.\n" + one, one.replace("COPYRIGHT HOLDERS ", ""), one + "\n(c) You must pay.", "MIT License with changes\n" + one, "Copyright (c) 2020 A"]
    assert identified(spark, others) == [None] * len(others)


FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this machine")
def test_whole_texts_of_common_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0"}
    assert identified(spark, [(FOLDER / n).read_text() for n in names]) == list(names.values())
    bsd = (FOLDER / "BSD").read_text()
    bullets = bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("University", "copyright holder").replace("REGENTS AND", "COPYRIGHT HOLDERS AND").replace("REGENTS", "COPYRIGHT HOLDER")
    two = bullets[: bullets.index("* Neither")] + bullets[bullets.index("THIS SOFTWARE") :]
    assert identified(spark, [bullets, two]) == ["BSD-3-Clause", "BSD-2-Clause"]


def test_own_lists_are_searched_for_whole(spark):
    own = [("Y-1", "We, the copyright holders waive all claims fully and forever")]
    docs = spark.createDataFrame([(1, own[0][1].replace("the ", "the\n")), (2, "A line\n" + own[0][1]), (3, own[0][1] + " more")], "doc_id long, text string")
    got = licenses.scan_licenses(docs, own).orderBy("doc_id").collect()
    assert [(r["license_id"], r["notices"]) for r in got] == [("Y-1", ""), (None, "Y-1"), (None, "")]


def test_sql_has_both_lookups(spark):
    import duckdb
    from pulsegrid.llm.queries import ORACLES

    mit, isc = licenses.KNOWN[0][1], licenses.KNOWN[1][1]
    texts = [mit, "MIT License\n\nCopyright (c) 2020 A\n\n" + textwrap.fill(mit, 50), "Some lines\n" + " ".join(isc.split()) + "\nmore", None, "", "Licensed under CC BY 4.0.", "(c) You must pay.\n" + mit, "Copyright (c) 2020 A\r\nAll rights reserved.\r\n" + textwrap.fill(isc, 33)]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = con.execute(ORACLES["op8_license_scan"])
    names = [c[0] for c in cursor.description]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))
    assert [r["license_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["MIT", "MIT", None, None, None, "CC-BY-4.0", "MIT", "ISC"]
    assert sorted(got, key=lambda r: r["doc_id"])[2]["notices"] == "ISC"
