"""Raking and sampling."""

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import mixing as M


def docs_of(spark, n=4000):
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit(None)), (F.col("id") % 11 % 3 + 1).cast("int")).alias("lang"),
        F.when(F.col("id") % 5 == 0, "note").otherwise("book").alias("topic"), (F.col("id") % 50).alias("n_tokens"),
    )


def test_marginals_meet_their_targets(spark):
    cells = M.cells_of(docs_of(spark))
    raked = M.rake(cells).collect()
    assert sum(r.weight for r in raked) == pytest.approx(1)
    for k in M.KEYS:
        tokens, weight = {}, {}
        for r in raked:
            tokens[r[k]] = tokens.get(r[k], 0) + r.tokens
            weight[r[k]] = weight.get(r[k], 0) + r.weight
        total = sum(t**M.TEMPERATURE for t in tokens.values())
        for v in tokens:
            assert weight[v] == pytest.approx(tokens[v] ** M.TEMPERATURE / total, rel=1e-4)


def test_stated_targets(spark):
    targets = {"lang": spark.createDataFrame([("en", 3.0), ("de", 1.0), ("zz", 9.0)], "value string, target double")}
    raked = M.rake(M.cells_of(docs_of(spark)), targets=targets).collect()
    share = {v: sum(r.weight for r in raked if r.lang == v) for v in ("en", "de", "")}
    assert share["en"] == pytest.approx(0.75, rel=1e-6) and share["de"] == pytest.approx(0.25, rel=1e-6) and share[""] == 0


@pytest.mark.parametrize("budget", [0.1, 0.5, 0.9, 1.0])
def test_budget_and_proportions(spark, budget):
    cells = M.calibrate(M.rake(M.cells_of(docs_of(spark))), budget).collect()
    total = sum(c.tokens for c in cells)
    assert sum(c.tokens * c.probability for c in cells) == pytest.approx(budget * total)
    free = [c.probability / c.worth for c in cells if c.probability < 1]
    assert all(f == pytest.approx(free[0]) for f in free) and all(0 < c.probability <= 1 for c in cells)
    assert all(c.worth >= max([x.worth for x in cells if x.probability < 1], default=0) for c in cells if c.probability == 1)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_sampling(spark, bound):
    docs = docs_of(spark).unionByName(docs_of(spark).where("doc_id = 7"))
    cells = M.calibrate(M.rake(M.cells_of(docs)))
    out = M.with_probability(docs, cells, max_cells=bound).withColumn("sampled", M.unit(F.col("doc_id")) < F.col("probability"))
    rows = out.collect()
    assert len(rows) == 4001 and out.columns == [*docs.columns, "probability", "sampled"]
    assert len({r.sampled for r in rows if r.doc_id == 7}) == 1 and not any(r.sampled for r in rows if r.n_tokens == 0)
    kept = sum(r.n_tokens for r in rows if r.sampled)
    assert kept == pytest.approx(M.BUDGET * sum(r.n_tokens for r in rows), rel=0.08)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (1, None, None, None, 5), (None, "a", "x", "t", 3), (2, "a", "", "t", 0), (3, "only", "nothing", "here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    got = M.mix(docs, budget=1.0).collect()
    assert len(got) == 5 and all(r.probability == (1 if r.n_tokens else 0) for r in got)
    assert M.mix(docs.limit(0)).isEmpty() and not any(r.sampled for r in M.mix(docs.where("n_tokens = 0")).collect())
    assert M.mix(docs.withColumn("__source", F.lit(1)).withColumn("extra", F.lit(2))).columns[-4:] == ["__source", "extra", "probability", "sampled"]


def test_token_counts(spark):
    df = spark.createDataFrame([("a b c\n d",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(M.count_tokens(F.col("t"))).collect()] == [3, 0, 0]


def test_rounds_go_on_until_targets_are_met(spark):
    """Cells that depend on each other need more than the first rounds; both placements agree."""
    rows = [("a", "x", "t", 1000), ("a", "y", "t", 1), ("b", "x", "t", 1), ("b", "y", "t", 1000), ("b", "y", "u", 5)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").withColumn("docs", F.lit(1))
    targets = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "value string, target double"), "lang": spark.createDataFrame([("x", 0.4), ("y", 0.6)], "value string, target double")}
    one, many = (sorted((r.source, r.lang, r.topic, r.weight) for r in M.rake(cells, targets=targets, max_cells=n).collect()) for n in (100, 0))
    assert [r[:3] for r in one] == [r[:3] for r in many] and [r[3] for r in one] == pytest.approx([r[3] for r in many])
    assert sum(r[3] for r in one if r[0] == "a") == pytest.approx(0.7, abs=1e-8) and sum(r[3] for r in one if r[1] == "x") == pytest.approx(0.4, abs=1e-8)


def test_targets_that_no_cells_can_meet(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10, 1), ("b", "y", "t", 10, 1)], "source string, lang string, topic string, tokens long, docs long")
    targets = {"source": spark.createDataFrame([("a", 1.0)], "value string, target double"), "lang": spark.createDataFrame([("y", 1.0)], "value string, target double")}
    with pytest.warns(M.NotConverged):
        assert all(r.weight == 0 for r in M.rake(cells, targets=targets).collect())


def test_raking_needs_no_shuffle(spark):
    cells = M.cells_of(docs_of(spark))
    plan = M.rake(cells)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
