"""Identifier parsing: spellings, rejections and shapes."""

import pytest
from pyspark.sql import functions as F

from vocatlas.functions import ids


def one(spark, expr, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(expr(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, canonical",
    [
        ("T1003", "T1003"), (" t1003\n", "T1003"), ("MITRE ATT&CK: T1003", "T1003"), ("att & ck technique t1003.", "T1003"), ("T1003.4", "T1003.004"), ("t1003/004", "T1003.004"),
        ("Sub technique T1003-04", "T1003.004"), ("tactic TA0006", "TA0006"), ("DS0009", "DS0009"), ("M1036", "M1036"), ("group: G0016", "G0016"), ("C0010", "C0010"), ("S0154", "S0154"),
        ("CWE-79", "CWE-79"), ("cwe 0079", "CWE-79"), ("(CWE_79)", "CWE-79"), ("weakness CWE:79", "CWE-79"), ("capec49", "CAPEC-49"), ("attack pattern CAPEC-049", "CAPEC-49"),
        ("79", None), ("T100", None), ("T10033", None), ("T1003.0004", None), ("CWE-12345", None), ("CWE-abc", None), ("CVE-2024-1", None), ("", None), (None, None), ("...", None), ("T١١١٠", None),
    ],
)
def test_canonical(spark, raw, canonical):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(ids.canonical_id(F.col("t"))).first()[0] == canonical


def test_parsed_fields(spark):
    rows = spark.createDataFrame([("T1003.004",), ("TA0001",), ("cwe-1",), ("capec 2",), ("x",)], "t string").select(ids.parse_id(F.col("t")).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in rows] == [
        ("T1003.004", "attack", "subtechnique", "T1003"), ("TA0001", "attack", "tactic", None), ("CWE-1", "cwe", "weakness", None), ("CAPEC-2", "capec", "attack_pattern", None), None,
    ]


def test_extract_keeps_first_mentions(spark):
    text = "Seen T1003.001 and cwe 79, then T1003/1 again; CAPEC-7 (M1036). Not C0010, XT1003 or T10031."
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r.x for r in df.select(ids.extract_ids(F.col("t")).alias("x")).collect()] == [["T1003.001", "CWE-79", "CAPEC-7", "M1036"], []]


@pytest.mark.parametrize(
    "raw, shaped",
    [
        ("CWE-abc", True), ("T99", True), ("S3 bucket", True), ("MITRE thing", True), ("technique T9", True), ("CVE-2024-1", True), ("medium", False), ("heap-based", False),
        ("cwe_abc", False), ("local", False), ("", False), (None, False),
    ],
)
def test_shape(spark, raw, shaped):
    assert spark.createDataFrame([(raw,)], "t string").select(ids.is_id_shaped(F.col("t"))).first()[0] is shaped


def test_document_ids(spark):
    rows = [("cve", "2024-1"), ("cve", "cve-2024-1"), ("mitre", "1003"), ("mitre", "t1003"), ("cwe", "79"), ("capec", "CAPEC-1")]
    df = spark.createDataFrame(rows, "k string, r string")
    assert [r[0] for r in df.select(ids.document_id(F.col("k"), F.col("r"))).collect()] == ["CVE-2024-1", "cve-2024-1", "T1003", "t1003", "CWE-79", "CAPEC-1"]
