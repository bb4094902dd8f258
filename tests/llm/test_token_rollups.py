"""Token rollups."""

import random

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import token_rollups as R

CHANGE = "source string, lang string, tokenizer string, sign int, n_tokens long"


def plain(batches):
    out = {}
    for rows in batches:
        for s, lang, t, sign, n in rows:
            d, k = out.get((s, lang, t), (0, 0))
            out[(s, lang, t)] = (d + sign, k + sign * (n or 0))
    return {k: v for k, v in out.items() if v != (0, 0)}


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_batches_repeats_and_compaction(spark, tmp_path):
    rng = random.Random(1)
    batches = [[(rng.choice(["a", "b", None]), rng.choice(["x", None]), "t", rng.choice([1, -1]), rng.choice([1, 5, None])) for _ in range(20)] for _ in range(5)]
    store = R.Store(spark, str(tmp_path / "s"))
    assert totals(store) == {}
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, CHANGE)
        assert store.commit(f"b{i}", df) and not store.commit(f"b{i}", df)
        assert totals(store) == plain(batches[: i + 1])
        if i in (1, 3):
            store.compact()
            store.compact()
            assert store.batches() == [] and store.committed("b0") and not store.commit("b0", df)
            assert totals(store) == plain(batches[: i + 1])
    again = R.Store(spark, str(tmp_path / "s"))
    assert totals(again) == plain(batches)
    assert {r.lang: r.n_docs for r in again.totals("lang").collect()} == {
        lang: d for lang in ("x", None) if (d := sum(v[0] for k, v in plain(batches).items() if k[1] == lang)) or sum(v[1] for k, v in plain(batches).items() if k[1] == lang)
    }


def test_interrupted_batch_is_written_again(spark, tmp_path):
    store = R.Store(spark, str(tmp_path / "s"))
    half = tmp_path / "s" / "batch=b0"
    half.mkdir(parents=True)
    (half / "part-00000.parquet").write_bytes(b"PAR1")
    assert store.batches() == [] and totals(store) == {}
    assert store.commit("b0", spark.createDataFrame([("a", "x", "t", 1, 3)], CHANGE))
    assert totals(store) == {("a", "x", "t"): (1, 3)}


def test_interrupted_compaction_counts_nothing_twice(spark, tmp_path):
    store = R.Store(spark, str(tmp_path / "s"))
    store.commit("b0", spark.createDataFrame([("a", "x", "t", 1, 3)], CHANGE))
    store.totals().write.parquet(str(tmp_path / "s" / "snapshot=0"))  # and no list of its members
    assert totals(store) == {("a", "x", "t"): (1, 3)}
    store.compact()
    store.commit("b1", spark.createDataFrame([("a", "x", "t", 1, 4)], CHANGE))
    spark.createDataFrame([("b0",), ("b1",)], "batch string").write.parquet(str(tmp_path / "s" / "members=1"))
    store.totals().write.parquet(str(tmp_path / "s" / "snapshot=1"))  # and the batch still there
    assert totals(store) == {("a", "x", "t"): (2, 7)}


def test_revisions(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x", "one two", "e"), ("a", "x", None, "e")], "source string, lang string, text string, sign string")
    store = R.Store(spark, str(tmp_path / "s"))
    old, new = R.TOKENIZERS
    count = lambda v: R.count(F.col("text"), v)
    store.commit("0", R.signed(docs, 1, old, count(old)))
    store.commit("1", R.revised(docs, (old, count(old)), (new, count(new))))
    assert totals(store) == {("a", "x", new): (2, 2)}
    store.commit("2", R.signed(docs, -1, new, count(new)))
    assert totals(store) == {}


def test_wrong_changes_raise(spark, tmp_path):
    store = R.Store(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.commit("../x", spark.createDataFrame([], CHANGE))
    with pytest.raises(Exception, match="sign"):
        store.commit("b", spark.createDataFrame([("a", "x", "t", 2, 3)], CHANGE))
    assert store.commit("empty", spark.createDataFrame([], CHANGE)) and totals(store) == {}
