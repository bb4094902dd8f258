"""Aggregates over terms, model calls and retrieval results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vocatlas.sources.records import is_stale

CALL = "model string, prompt bigint, completion bigint, latency_ms bigint, ok boolean, tag string, error string, started_at double, scope string"


def exploded(records: DataFrame) -> DataFrame:
    """One row a term: doc_id, its place and ``t``."""
    return records.select("doc_id", F.posexplode("proposed_terms").alias("ord", "t"))


def summarize(terms: DataFrame) -> DataFrame:
    """One row over ``t``: accepted, rejected, repaired, staleness_rate over all terms (null without identifiers)."""
    t = F.col("t")
    is_id = t["kind"] == "structural"
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return terms.agg(
        one(t["accepted"]).alias("accepted"),
        one(~t["accepted"]).alias("rejected"),
        one(t["repaired_from_id"].isNotNull()).alias("repaired"),
        F.try_divide(one(is_id & is_stale(t)).cast("double"), one(is_id).cast("double")).alias("staleness_rate"),
    )


def rejected_by_reason(terms: DataFrame) -> DataFrame:
    t = F.col("t")
    return terms.where(~t["accepted"]).groupBy(F.coalesce(t["reject_reason"], F.lit("unknown")).alias("reject_reason")).agg(F.count("*").alias("n"))


def rejection_rate(terms: DataFrame, structural_only: bool = True, *by: str) -> DataFrame:
    """``rejection_rate`` by groups, over identifiers or all terms; null where there are none."""
    t = F.col("t")
    pool = (t["kind"] == "structural") if structural_only else F.lit(True)
    return terms.groupBy(*by).agg(F.avg(F.when(pool, F.when(t["accepted"], 0.0).otherwise(1.0))).alias("rejection_rate"))


def mislabelled(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """Extension: how many terms were routed to another kind, by old and new kind.
    ``before``, ``after``: ``on`` and kind."""
    both = before.join(after.withColumnRenamed("kind", "routed"), on).where("kind != routed")
    return both.groupBy("kind", "routed").agg(F.count("*").alias("n"))


def call_log(calls: DataFrame, *by: str) -> DataFrame:
    """Calls, tokens, latency and failures, over all calls or by columns such as tag and scope."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return calls.groupBy(*by).agg(
        F.count("*").alias("calls"), zero("prompt").alias("prompt"), zero("completion").alias("completion"), zero(F.col("prompt") + F.col("completion")).alias("tokens"),
        zero("latency_ms").alias("latency_ms"), zero(F.when(F.col("ok"), 0).otherwise(1)).alias("failures"),
    )


def by_scope(calls: DataFrame, scopes: str = "scopes") -> DataFrame:
    """Aggregates per scope where each call lists the scopes that were open."""
    return call_log(calls.withColumn("scope", F.explode(scopes)), "scope")


def retrieval(ranked: DataFrame, qrels: DataFrame, at: tuple[int, ...] = (1, 10, 100), ndcg_at: int = 10) -> DataFrame:
    """Per query with relevant documents: recall at each cut and NDCG.

    ``ranked``: query_id, doc_id, rank. ``qrels``: query_id, doc_id, gain.
    """
    good = qrels.where("gain > 0").select("query_id", "doc_id", F.col("gain").cast("double").alias("gain"))
    ideal_rank = Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")
    ideal = good.withColumn("i", F.row_number().over(ideal_rank)).groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= ndcg_at, F.col("gain") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal")
    )
    hits = ranked.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(
        *(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias(f"hits_{k}") for k in at),
        F.sum(F.when(F.col("rank") <= ndcg_at, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    out = ideal.join(hits, "query_id", "left")
    return out.select(
        "query_id",
        *(F.coalesce(F.col(f"hits_{k}") / F.col("relevant"), F.lit(0.0)).alias(f"recall_{k}") for k in at),
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias(f"ndcg_{ndcg_at}"),
    )


def coverage(ranked: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """Share of all relevant (query, document) pairs found within rank ``k``."""
    good = qrels.where("gain > 0").select("query_id", "doc_id").distinct()
    found = ranked.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit")).distinct()
    return good.join(found, ["query_id", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Extension: ``n`` rows of each value of ``by``, by a hash of ``key``."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key)
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")
