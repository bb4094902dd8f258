"""Corpus, index, frequencies, BM25 and its extensions."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocatlas.operators import bm25, index, metrics
from vocatlas.sources import corpus

KB = str(Path(__file__).parent / "fixtures" / "kb")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.load_corpus(spark, KB).persist()


@pytest.fixture(scope="module")
def idx(docs):
    return index.build(docs, "english")


def test_corpus(spark, docs):
    got = [tuple(r) for r in docs.orderBy("load_seq").select("doc_id", "source", "text").collect()]
    assert got == [
        ("CVE-2030-1", "cve", 'Overflow in Box {"note": "remote attackers"}'), ("CVE-2030-2", "cve", "Bypass authentication bypass"), ("CWE-20", "cwe", "Weak Keys authentication"),
        ("CAPEC-5", "capec", "Guessing"), ("T2000", "attack", "Guess Keys naïve guess"), ("T2000.001", "attack", "short"),
    ]
    assert corpus.load_corpus(spark, KB, ["cve", "cwe"], limit=2).count() == 2 and corpus.load_kb(spark, KB, "cve", 0).count() == 0
    assert corpus.load_corpus(spark, KB, []).isEmpty()
    with pytest.raises(ValueError):
        corpus.load_kb(spark, KB, "other")


@pytest.mark.parametrize("line", ["{not json", '{"title": "no id"}', "[1]"])
def test_malformed_rows_raise(spark, tmp_path, line):
    (tmp_path / "cwe.jsonl").write_text('{"id": "1"}\n' + line + "\n")
    with pytest.raises(Exception, match="malformed row"):
        corpus.load_kb(spark, str(tmp_path), "cwe").collect()


def test_staging(spark, docs, tmp_path):
    corpus.write_collection(docs, str(tmp_path / "c"))
    assert spark.read.schema("id string, contents string").json(str(tmp_path / "c")).count() == 6
    with pytest.raises(ValueError):
        corpus.write_collection(docs.limit(0), str(tmp_path / "d"))


def test_document_frequency(spark, idx):
    asked = spark.createDataFrame([("authentication bypass", "max"), ("authentication bypass", "min"), ("unseen", "max"), ("...", "max"), (None, "max")], "term string, combine string")
    got = {(r.term, r.combine): r.doc_freq for r in index.term_df(asked, idx.term_stats, "english").collect()}
    assert got == {("authentication bypass", "max"): 2, ("authentication bypass", "min"): 1, ("unseen", "max"): 0, ("...", "max"): 0, (None, "max"): 0}
    rule = spark.range(1).select(*(index.too_common(F.lit(n), F.lit(t), 0.5).alias(f"c{i}") for i, (n, t) in enumerate([(5, 10), (6, 10), (1, 0)]))).first()
    assert tuple(rule) == (False, True, False)


def test_save_and_load(spark, idx, tmp_path):
    index.save(idx, str(tmp_path / "i"), {"kind": "base"})
    back = index.load(spark, str(tmp_path / "i"))
    assert back.analyzer == "english" and index.total_docs(back) == 6 and index.read_manifest(spark, str(tmp_path / "i"))["kind"] == "base"
    assert index.fetch(back, "CAPEC-5").first().raw == "Guessing"
    assert back.postings.where("token = 'guess' and doc_id = 'T2000'").first().positions == [0, 3]
    q = spark.createDataFrame([("q", "guess keys guess authentication")], "query_id string, text string")
    found = lambda i: {r.doc_id: r.score for r in bm25.scores(i, q).collect()}
    assert found(back) == pytest.approx(found(idx)) and len(found(back)) == 4
    with pytest.raises(ValueError):
        index.save(index.build(spark.createDataFrame([], "doc_id string, text string")), str(tmp_path / "e"))


def test_scores_by_hand(spark, idx):
    got = bm25.search(idx, spark.createDataFrame([("q", "guess keys guess")], "query_id string, text string")).collect()
    lengths = {r.doc_id: r.dl for r in idx.doc_stats.collect()}
    avg = sum(lengths.values()) / 6

    def one(tf, df, dl):
        return math.log(1 + (6 - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * dl / avg))

    want = {"T2000": 2 * one(2, 2, 4) + one(1, 2, 4), "CAPEC-5": 2 * one(1, 2, 1), "CWE-20": one(1, 2, 3)}
    assert {r.doc_id: pytest.approx(r.score) for r in got} == want
    assert [r.rank for r in sorted(got, key=lambda r: -r.score)] == [1, 2, 3]


def test_expansion_field_leaves_contents_alone(spark, docs, idx):
    extra = spark.createDataFrame([("CAPEC-5", "old", 0), ("CAPEC-5", "zanzibar keys", 1), ("gone", "x", 2)], "doc_id string, expansion string, load_seq long")
    rich = index.build_enriched(docs, extra, "english")
    assert rich.docs.count() == 6
    q = spark.createDataFrame([("a", "zanzibar"), ("b", "keys")], "query_id string, text string")
    assert {(r.query_id, r.doc_id) for r in bm25.search(rich, q).collect()} == {("b", "CWE-20"), ("b", "T2000")}
    assert {(r.query_id, r.doc_id) for r in bm25.search(rich, q, field="expansion").collect()} == {("a", "CAPEC-5"), ("b", "CAPEC-5")}
    plain = {(r.query_id, r.doc_id): r.score for r in bm25.scores(idx, q).collect()}
    assert {(r.query_id, r.doc_id): r.score for r in bm25.scores(rich, q).collect()} == pytest.approx(plain)


def test_extensions(spark, idx):
    q = spark.createDataFrame([("a", "overflow", "authentication"), ("b", "short", None)], "query_id string, text string, expansion string")
    fused = {(r.query_id, r.doc_id) for r in bm25.fused(idx, q).collect()}
    assert fused == {("a", "CVE-2030-1"), ("a", "CVE-2030-2"), ("a", "CWE-20"), ("b", "T2000.001")}
    extra = spark.createDataFrame([("a", 0, "guessing"), ("a", 1, "short")], "query_id string, ord int, text string")
    assert {r.doc_id for r in bm25.synthesis(idx, q.where("query_id = 'a'"), extra, 1).collect()} == {"CVE-2030-1", "T2000", "CAPEC-5"}
    assert {r.doc_id for r in bm25.multi_round(idx, spark.createDataFrame([("a", "weak")], "query_id string, text string")).collect()} >= {"CWE-20", "T2000"}
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = v.select(bm25.cosine(F.col("a"), F.col("b")).alias("x"), bm25.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert got.x == pytest.approx(0.5**0.5) and got.y is None
    dense = spark.createDataFrame([("a", "CWE-20", 0.5)], "query_id string, doc_id string, score double")
    mixed = {r.doc_id: r.score for r in bm25.hybrid(bm25.scores(idx, q.where("query_id = 'a'")), dense, 0.4).collect()}
    assert mixed == {"CVE-2030-1": pytest.approx(0.4), "CWE-20": pytest.approx(0.6)}


def test_dense_search_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "doc_id long, embedding array<double>")
    q = v.where("doc_id < 6").withColumnRenamed("doc_id", "query_id")
    got = [sorted((r.query_id, r.rank, r.doc_id) for r in bm25.dense_search(v, q, 3, block).collect()) for block in (1, 4, 100)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 18 and (0, 1, 15) in got[0]


def test_empty_index(spark):
    empty = index.build(spark.createDataFrame([], "doc_id string, text string"))
    assert bm25.search(empty, spark.createDataFrame([("q", "x")], "query_id string, text string")).isEmpty()


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 11)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("a", "y", 1), ("a", "z", 1), ("b", "x", 1), ("a", "x", 0)], "query_id string, doc_id string, gain int")
    got = {r.query_id: r for r in metrics.retrieval(ranked, qrels).collect()}
    assert (got["a"].recall_1, got["a"].recall_10, got["a"].recall_100) == (0.0, 0.5, 1.0)
    assert got["a"].ndcg_10 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["b"].ndcg_10 == 0.0
    assert metrics.coverage(ranked, qrels).first()[0] == pytest.approx(2 / 3)


def test_best_are_chosen_before_pairs_are_shuffled(spark, idx):
    """The same rows as from all scores, ties by id included, from few pairs."""
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    texts = [(i, " ".join(words[(i * j) % 5] for j in range(1, 2 + i % 7))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame([("a", "alpha beta alpha", "gamma"), ("b", "delta", ""), ("c", "none", None), ("d", "eps", "none")], "query_id string, text string, expansion string")
    extra = spark.createDataFrame([("a", 0, "eps eps"), ("b", 0, "alpha"), ("c", 1, "beta")], "query_id string, ord int, text string")
    made = index.build(docs)
    got = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    assert got(bm25.search(made, q, 7)) == got(bm25.top(bm25.scores(made, q), 7))
    few, every = bm25.fused(made, q, 0.7, k=7), bm25.fused(made, q, 0.7)
    assert got(bm25.top(few, 7)) == got(bm25.top(every, 7)) and few.count() <= 3 * 4 * 7 < every.count()
    few, every = bm25.synthesis(made, q, extra, 2, k=7), bm25.synthesis(made, q, extra, 2)
    assert got(bm25.top(few, 7)) == got(bm25.top(every, 7)) and few.count() <= 3 * 4 * 7 < every.count()
    twice = index.build(docs.unionByName(docs.where("doc_id < 9")))
    assert got(bm25.search(twice, q, 7)) == got(bm25.top(bm25.scores(twice, q), 7))
    named = spark.createDataFrame([("q", "guess keys")], "query_id string, text string")
    assert got(bm25.search(idx, named, 2)) == got(bm25.top(bm25.scores(idx, named), 2))


def test_scores_that_round_to_the_same_place_go_by_id(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from vocatlas.operators import nearest

    monkeypatch.setattr(nearest, "CELLS", 1)
    best = nearest.Best(1, 1)
    for i, score in ((9, 0.5), (8, 0.1), (7, 0.4999996), (6, 0.4999994)):
        best.offer(np.array([[score]]), np.array([[True]]), pa.array([i]))
        best._cut()
    assert best.ids[0].to_pylist() == [7]


def test_dense_search_of_odd_vectors(spark, monkeypatch):
    from vocatlas.operators import nearest

    monkeypatch.setattr(nearest, "CELLS", 16)
    nan = float("nan")
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [2.0, 0.0]), (6, [1.0, 1.0]), (7, [-1.0, 0.0]), (8, [nan, 1.0]), (None, [1.0, 0.0]), (9, [3.0, 0.0])], "doc_id long, embedding array<float>")
    q = v.where("doc_id in (0, 1, 2, 6)").withColumnRenamed("doc_id", "query_id")
    pairs = v.join(q.select("query_id", F.col("embedding").alias("e")), F.col("doc_id") != F.col("query_id")).select("query_id", "doc_id", bm25.cosine(F.col("e"), F.col("embedding")).alias("score"))
    got = lambda df: sorted((r.query_id, r["rank"], r.doc_id, None if r.score is None else repr(round(r.score, 6))) for r in df.collect())
    for k in (2, 20):
        assert got(bm25.dense_search(v, q, k)) == got(bm25.top(pairs, k))


@pytest.mark.parametrize("block", [2, 100])
def test_runs_of_tokens_in_documents(spark, block):
    """As by trying every pair, without shuffling a document."""
    import random

    from vocatlas.operators import nearest

    rng = random.Random(block)
    docs = [(i, None if i == 3 else [rng.choice("abcdefg") for _ in range(rng.randrange(9))]) for i in range(120)]
    runs = [(i, [rng.choice("abcde") for _ in range(1 + i % 5)]) for i in range(40)] + [(40, []), (41, ["zz"]), (0, ["a", "b"])]
    d, r = spark.createDataFrame(docs, "doc_id long, tokens array<string>"), spark.createDataFrame(runs, "item_id long, tokens array<string>")
    got = nearest.containing(d, r, block)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = [(i, j) for i, ws in runs for j, ts in docs if ws and any((ts or [])[k : k + len(ws)] == ws for k in range(len(ts or [])))]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100
