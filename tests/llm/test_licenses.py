import duckdb

from ledgerlight.llm import licenses

from .fixtures import SF, awkward, docs, empty


def test_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted((r.doc_id, r.digest, r.license or "", ",".join(r.notices)) for r in licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    assert got == sorted((a, b, c or "", d) for a, b, c, d in db.sql(licenses.oracle_sql()).fetchall())
    assert any(r[3] for r in got)


def test_equivalent_forms_and_awkward_rows(spark):
    mit = next(body for name, body in licenses.KNOWN if name == "MIT" and len(body) > 300)
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n" + mit.upper()), (3, mit.replace("\n", "  \n\n*  ").replace(",", " ;")), (4, mit + "\nand one more condition"), (5, "released under the MIT Licence"), (6, "text\n  Licensed under the Apache Licence - Version 2.0\nmore"),
        (7, "(C) 1999 a\nCopyright b"), (8, None), (9, ""), (None, mit),
    ]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None)] == ["MIT", "MIT", "MIT", None, "MIT", "MIT"]
    assert got[6] == (None, ["Apache-2.0"]) and got[8] == got[9] == got[7] == (None, [])
    more = [(1, "Лицензия MIT License для всех"), (2, "根据 MIT License 发布"), (3, "MIT License"), (4, "é MIT License"), (5, "# Copyright (c) 2021 A. Author\n# " + mit.replace("\n", "\n# ")), (6, "/*\n * Copyright 1999-2004 B\n * All rights reserved.\n" + mit.replace("\n", "\n * ") + "\n */")]
    assert {r.doc_id: r.license for r in licenses.scan(docs(spark, more)).collect()} == {1: None, 2: None, 3: "MIT", 4: None, 5: "MIT", 6: "MIT"}
    assert licenses.scan(awkward(spark)).count() == awkward(spark).count() and licenses.scan(empty(spark)).collect() == []


def test_whole_licence_texts(spark):
    """Each text is found as it is, with other spaces and marks, in a comment, and under another copyright line; not with more words."""
    names = {n for n, _ in licenses.default_licences()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= names
    texts = [(n, t) for n, t in licenses.default_licences() if len(t) > 500]
    rows = []
    for k, (_, t) in enumerate(texts):
        rows += [(10 * k, t), (10 * k + 1, t.replace(" ", " \t ").replace(",", " ;")), (10 * k + 2, "// Copyright (C) 2022 Someone Else\n" + "\n".join("// " + x for x in t.split("\n"))), (10 * k + 3, t + "\nexcept on Mondays")]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, rows)).collect()}
    for k, (n, _) in enumerate(texts):
        assert [got[10 * k + j] for j in range(4)] == [n, n, n, None], n
