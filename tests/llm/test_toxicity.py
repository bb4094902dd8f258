"""Toxic passages."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocatlas.llm import toxicity as T
from vocatlas.llm.bytewords import tokenize


def plain_segments(scores):
    """Ruzzo and Tompa's segments by their definition: the best one, then those of what is left of both sides."""
    if not scores:
        return []
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12 or (at and abs(total - best) < 1e-12 and j - i < at[1] - at[0]):
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    left, right = plain_segments(scores[:i]), plain_segments(scores[j + 1 :])
    return left + [(i, j, best)] + [(a + j + 1, b + j + 1, s) for a, b, s in right]


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_their_definition(seed):
    rng = random.Random(seed)
    n, drift = 40, 0.37
    hits = sorted(rng.sample(range(n), rng.randrange(0, 15)))
    values = [rng.choice([0.1, 0.5, 1.1, 2.3]) + rng.random() / 1000 for _ in hits]
    scores = [-drift] * n
    for p, v in zip(hits, values):
        scores[p] = v
    got = T.maximal_segments(hits, values, drift)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(scores)]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in plain_segments(scores)])


def test_lambda_solves_its_equation():
    s, p = np.array([2.0, 3.0]), np.array([0.001, 0.002])
    lam = T.solve_lambda(s, p, 0.05)
    assert (p * np.exp(lam * s)).sum() + (1 - p.sum()) * math.exp(-lam * 0.05) == pytest.approx(1)


def test_extreme_values_bound_chance():
    """In random clean texts, passages of E at most E_MAX are rarer than E_MAX."""
    rng = random.Random(1)
    m = T.Model([("bad", 2.0, 0.002), ("vile", 3.0, 0.001)], 0.1)
    texts = [" ".join(rng.choices(["bad", "vile", "fine"], [0.002, 0.001, 0.997], k=300)) for _ in range(2000)]
    _, found = m.passages(tokenize(pa.array(texts)), len(texts))
    assert sum(bool(f) for f in found) <= 2000 * T.E_MAX * 1.3


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 400))]
        toxic = rng.random() < 0.25
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["scum", "Idiot!!", "TRASH,", *words[:3]]) for _ in range(8)] + ["scum"]
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_and_held_out(spark):
    rows, labels = corpus(900, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(docs, lab.where("doc_id < 600"))
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    wrong = [i for i, y in labels if i >= 600 and got[i].predicted != y]
    assert len(wrong) <= 9
    assert all(0 <= r.score <= 1 and (r.score >= 0.5) == bool(r.predicted) for r in got.values())
    some = next(r for r in got.values() if r.predicted)
    assert "scum" in some.passages[0].text and some.passages[0].e_value <= T.E_MAX


def test_defined_results(spark):
    rows, labels = corpus(300, 3)
    extra = [(1000, None, None), (1001, "", None), (None, "scum idiot trash scum scum", None), (1002, "ü " * 50000 + "scum idiot scum trash idiot scum", None), (1002, "fine", None), (1003, "scum " * 3, None), (1003, "scum " * 3, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, stat string")
    lab = spark.createDataFrame(labels + [(0, None), (None, 1), (5, labels[5][1]), (9999, 1)], "doc_id long, toxic int")
    model = T.fit(docs.where("doc_id < 1000"), lab)
    got = T.score(docs, model, carry=("text",)).where("doc_id >= 1000 or doc_id is null").collect()
    assert len(got) == 7
    low = min(r.score for r in got)
    assert all(r.score == low for r in got if r.text in (None, "", "fine"))
    assert all(r.predicted == 1 for r in got if r.text and "scum" in r.text)
    assert T.score(docs.limit(0), model).isEmpty()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a scum"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [round(r.score, 3) for r in T.score(docs, T.fit(docs, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.9 for r in T.score(docs, T.fit(docs, one)).collect())


def test_copies_count_once(spark):
    docs = spark.createDataFrame([(i, "same text" if i < 50 else f"text {i}") for i in range(60)], "doc_id long, text string")
    rows = T.training_rows(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    assert rows.count() == 11 and rows.where("text = 'same text'").first().toxic == 0


def test_query(spark, tmp_path):
    """Held-out rows by zlib's crc32, learning from no others, and the columns."""
    rows, labels = corpus(700, 4)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    # Labels of held-out rows are wrong, which must make no difference.
    lab = [(i, 1 - y if held(i) else y) for i, y in labels]
    spark.createDataFrame([(*r[:2], "aa") for r in rows] + [(None, "scum scum trash idiot scum", None), (5000, None, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, some in (("labels", lab), ("kept", [x for x in labels if not held(x[0])])):
        spark.createDataFrame(some, "doc_id long, toxic int").write.parquet(str(tmp_path / f"{name}.parquet"))
    out = T.op6_toxicity(spark, str(tmp_path))
    assert dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int"
    got = out.collect()
    assert len(got) == 702 and all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = T.fit(docs, spark.read.parquet(str(tmp_path / "kept.parquet")))
    want = {r.doc_id: (r.score, r.predicted) for r in T.score(docs, model).collect()}
    assert {r.doc_id: (r.score, r.predicted) for r in got} == want
    true = dict(labels)
    assert sum(want[i][1] != true[i] for i in true if held(i)) <= 5 and want[None][1] == 1


def test_clean_words_count_against_a_passage():
    m = T.Model([("bad", 2.0, 0.02), ("kind", -3.0, 0.1)], 0.1)
    stat, found = m.passages(tokenize(pa.array(["bad bad bad bad bad bad bad", "bad kind bad kind bad kind bad kind bad kind bad kind bad", "kind kind"])), 3)
    assert stat[0] > stat[1] >= 0 == stat[2] and found[0] and not found[1] and not found[2]
