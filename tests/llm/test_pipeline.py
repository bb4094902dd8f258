"""The pipeline's stages, and the queries that SQL can express."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tests.helpers import assert_same, duck
from vocatlas import llm

SF = "/root/testdata/sf0.001"
DATA = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@DATA
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(llm.queries()[name](spark, SF), llm.oracle_sql()[name], duck(SF))


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "mixing"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic, copied and contaminated documents, and odd rows, with clashing columns."""
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(400)] for lang, letters in (("aa", "abcdefghij"), ("bb", "klmnopqrst"))}
    make = lambda lang, n: [rng.choice(words[lang]) for _ in range(n)]
    item = make("aa", 40)
    rows, kind, labels = [], {}, []

    def add(i, text, what, lang="aa", toxic=0):
        rows.append((i, " ".join(text) if text is not None else None, lang, f"s{i % 3}" if i else None, 1.5, "x"))
        kind[i] = what
        labels.append((i, toxic))

    for i in range(1, 400):
        lang = "aa" if i % 2 else "bb"
        text = make(lang, rng.randrange(60, 200))
        if i % 10 == 3:
            for _ in range(6):
                text.insert(rng.randrange(20), "vile")
            add(i, text, "toxic", lang, 1)
        elif i % 10 == 5:
            add(i, text[:30] + item[5:30] + text[30:], "leak", lang)
        elif i % 10 == 7:
            add(i, text, "first", lang)
            add(1000 + i, text, "copy", lang)
            near = list(text)
            near[len(near) // 2] = "changed"
            add(2000 + i, near, "copy", lang)
        else:
            add(i, text, "clean", lang)
    add(3000, None, "none")
    add(3001, ["12", "!"], "none")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, predicted string").withColumn("probability", F.lit("p")).withColumn("rest.x", F.lit(1))
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind


def test_stages_one_by_one(spark, corpus):
    path, kind = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = dict(kind)
    for (name, stage), goes in zip(P.STAGES[:4], ("toxic", "none", "copy", "leak")):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = {i: k for i, k in kept.items() if k != goes}
        got = ids(out)
        if name == "near_dedup":
            # Any one of a group may stay; the first by id does.
            assert got == sorted(kept)
        else:
            assert got == sorted(kept), name
        docs = out
    last = P.STAGES[4][1](spark, docs, path)
    assert {"n_tokens", "topic", "probability"} <= set(last.columns) and 0 < last.count() <= docs.count()
    assert ids(last) == sorted(set(ids(last))) and set(ids(last)) <= set(kept)
    # Columns of docs stay; the stage's own go by another name beside them.
    assert last.columns[: len(docs.columns)] == docs.columns and "mix_probability" in last.columns and {r.probability for r in last.select("probability").collect()} == {"p"}
    again = P.run(spark, path)
    assert ids(again) == ids(last)


def test_empty_table(spark, corpus, tmp_path):
    path, _ = corpus
    for t in ("labels", "benchmark"):
        os.symlink(f"{path}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).isEmpty()


def test_mixing_rakes_the_documents_own_topic(spark, corpus):
    """A topic of their own, whatever its type, takes the place of the length class and isn't changed."""
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("topic", F.array("source")).withColumn("n_tokens", F.lit("mine")).withColumn("mix", F.lit(0))
    out = P.mix_sources(spark, docs, path)
    assert out.columns == [*docs.columns, "mix_n_tokens", "mix_topic", "mix_probability"]
    rows = out.collect()
    assert rows and all(r.n_tokens == "mine" and r.topic == [r.source] and r.mix_topic == f"[{'null' if r.source is None else r.source}]" for r in rows)
