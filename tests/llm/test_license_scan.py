"""License scans."""

import os

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import license_scan as L


@pytest.mark.parametrize(
    "text, license_id",
    [
        (L._MIT, "MIT"), ("Copyright (c) 2020 Somebody\n\n" + L._MIT.upper(), "MIT"), ("MIT Licence\n© Somebody\n" + L._MIT.replace(". ", ".\n\n  * ").replace("merchantability", "merchantibility"), "MIT"),
        ("  // Released under the MIT licence  ", "MIT"), (L._MIT + " Extra.", None), (L._MIT[:-20], None), ("prose\nReleased under the MIT License.", None), ("", None), (None, None), ("© 2020 x", None),
        (f"Copyright 2001 X. All rights reserved.\n{L._BSD_HEAD}\n{L._BSD_NAME}\n{L._BSD_TAIL}", "BSD-3-Clause"), (f"{L._BSD_HEAD} {L._BSD_TAIL}", "BSD-2-Clause"), (L._ISC, "ISC"),
    ],
)
def test_whole_texts(spark, text, license_id):
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id long, text string, license_id string")
    got = L.scan(docs, L.catalogue_frame(spark)).collect()
    assert [r.license_id for r in got] == [license_id] * 2 and all(len(r.canonical_sha256) == 64 for r in got)


def test_bounds_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "Licensed under CC BY-NC 4.0."), (2, "x")], "doc_id long, text string")
    for bound in (0, 100):
        assert {r.doc_id: r.license_id for r in L.scan(docs, L.catalogue_frame(spark), bound=bound).collect()} == {None: "CC-BY-NC-4.0", 2: None}
    assert L.scan(docs.limit(0), L.catalogue_frame(spark)).isEmpty()
    empty = spark.createDataFrame([], "license_id string, text string")
    assert [r.license_id for r in L.scan(docs, empty).collect()] == [None, None]


FULL = {
    "Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2-only": "GFDL-1.2", "GFDL-1.3-only": "GFDL-1.3", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2",
    "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no license texts are installed")
def test_full_texts_laid_out_anew(spark):
    """Each long license is found as it is, in capitals with other breaks, and not with a sentence more."""
    assert set(FULL) == {k for k, _ in L.DIGESTS}
    rows = []
    for name, file in FULL.items():
        if os.path.exists(f"{FOLDER}/{file}"):
            text = open(f"{FOLDER}/{file}", encoding="utf-8").read()
            rows += [(name, name, text), (name, name, "\n".join(f"# {line.upper()}\r\n" for line in text.split("\n"))), (name, None, text + "\nOne more sentence.")]
    docs = spark.createDataFrame(rows, "doc_id string, want string, text string")
    got = L.scan(docs.select(F.struct("doc_id", "want").alias("id"), "text"), L.catalogue_frame(spark), id_col="id").collect()
    assert len(got) == len(rows) and all(r.license_id == r.id.want for r in got)


ODD = [
    "licence licence x", "non commercial non commercial", "sub licence sub license", "copyright the foo authors\nx", "copyright holders and contributors\nx", "(c) 2020 x. Permission is hereby granted, free of charge",
    "copyright 2020 x\nall rights reserved\ny", "Copyright 2020 x all rights reserved. Redistribution and use", "© Ä", "ÄÖ licence ß", "", " \n\r\n\t", "x" * 300_000 + " licence", "licence " * 50_000, None, "(c) this work that work",
]


def test_odd_texts_have_one_form_in_both_engines(spark, tmp_path):
    docs = spark.createDataFrame([*enumerate(ODD), (None, None), (0, ODD[0])], "doc_id long, text string").withColumn("license_id", F.lit(7)).withColumn("canonical_sha256", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in L.op5_license_scan(spark, str(tmp_path)).collect()), key=str)
    con = duck_documents(tmp_path)
    assert got == sorted(con.sql(L.ORACLE_SQL["op5_license_scan"]).fetchall(), key=str) and len(got) == len(ODD) + 2


def duck_documents(path):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return con


@pytest.mark.parametrize(
    "text, form",
    [
        ("Licence licence X", "license license x"), ("non commercial non-commercial", "noncommercial noncommercial"), ("(c) 2020 x. Permission is hereby granted", "permission is hereby granted"),
        ("Copyright The Foo Authors.\nx", "x"), ("copyright holders and contributors\nx", "copyright holders and contributors x"), ("Copyright 2020 x", ""), ("the copyright 2020", "the copyright 2020"),
        ("// Copyright (c) 2020 X. Licensed under the Y", "licensed under the y"), (None, ""),
    ],
)
def test_canonical_forms(spark, text, form):
    assert spark.createDataFrame([(text,)], "t string").select(L.canonical(F.col("t"))).first()[0] == form


def test_ties_on_one_digest(spark):
    catalogue = spark.createDataFrame([("B", "some terms"), ("A", "Some Terms!"), (None, "other"), ("C", None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, "some terms"), (2, "other"), (3, "")], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in L.scan(docs, catalogue).collect()} == {1: "A", 2: None, 3: None}
