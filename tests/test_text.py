"""Analyzers, replies and configuration."""

import pytest
from pyspark.sql import functions as F

from vocatlas.functions import replies, text
from vocatlas.plans import config


def analyzed(spark, value, analyzer):
    return spark.createDataFrame([(value,)], "t string").select(text.tokens(F.col("t"), analyzer)).first()[0]


@pytest.mark.parametrize(
    "value, tokens",
    [
        ("CWE-307", ["cwe", "307"]), ("T1110.001", ["t1110.001"]), ("zzip_get32 heap-based", ["zzip_get32", "heap", "base"]), ("The attacker's authentication", ["attack", "authent"]),
        ("Remote attackers", ["remot", "attack"]), ("1,234.5 and a.b.c", ["1,234.5", "a.b.c"]), ("", []), (None, []), ("Été à l'Île", ["été", "à", "l'île"]),
    ],
)
def test_english(spark, value, tokens):
    assert analyzed(spark, value, "english") == tokens


def test_simple(spark):
    assert analyzed(spark, "The CWE-307, l'Été_2!", "simple") == ["the", "cwe", "307", "l", "été_2"]
    with pytest.raises(ValueError):
        text.tokens(F.col("t"), "other")


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("agreed", "agre"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"),
        ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("hopefulness", "hope"), ("sensibiliti", "sensibl"), ("electrical", "electr"), ("replacement", "replac"),
        ("adoption", "adopt"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("by", "by"), ("yyyy", "yyyi"),
    ],
)
def test_porter(word, stem):
    assert text.porter(word) == stem


ITEM = '{"term": " lock out ", "kind": "symptom"}'


@pytest.mark.parametrize(
    "raw, status, n",
    [
        (f"[{ITEM}]", "ok", 1), ("[]", "ok", 0), (f"```json\n[{ITEM}]\n```", "ok", 1), (f"```\n[{ITEM}]\n``` and more", "ok", 1), (f"Sure:\n```json\n[{ITEM}]\n```", "ok", 1), (f"Sure: [{ITEM}] ok?", "ok", 1),
        ('{"terms": []}', "malformed", 0), (f'[{ITEM}, "x"]', "malformed", 0), ('[{"kind": "symptom"}]', "malformed", 0), ('[{"term": " ", "kind": "symptom"}]', "malformed", 0),
        ('[{"term": 3, "kind": "symptom"}]', "malformed", 0), ('[{"term": "x", "kind": ["symptom"]}]', "malformed", 0), ('[{"term": "x", "kind": "rumour"}]', "malformed", 0),
        ("No.", "malformed", 0), ("", "malformed", 0), (None, "malformed", 0), ('"text"', "malformed", 0), ("[" * 100_000, "malformed", 0),
    ],
)
def test_reading_replies(raw, status, n):
    got = replies.read_proposals(raw)
    assert got[0] == status and len(got[2]) == n and (got[1] is None) == (status == "ok")
    assert all(t == ("lock out", "symptom") for t in got[2])


def test_parse_reply_column(spark):
    df = spark.createDataFrame([(f"[{ITEM}]",), ("no",), (None,)], "r string").select(replies.parse_reply(F.col("r")).alias("p"))
    assert [(r.p.status, len(r.p.proposals)) for r in df.collect()] == [("ok", 1), ("malformed", 0), ("malformed", 0)]


def test_config(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text('{"a": 1}')
    assert config.load_config(str(path)) == {"a": 1}
    assert config.file_hash(spark, str(path)) == config.config_hash(b'{"a": 1}') and len(config.config_hash(b"", 8)) == 8
