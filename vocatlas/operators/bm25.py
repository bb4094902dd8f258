"""BM25 over the index's postings.

``ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + k1 (1 - b + b dl / avgdl))``
with exact lengths, N, df and avgdl by field; a token that a query repeats adds
up. ``scores`` gives all documents that share a token, as sums per (query,
document). The best k of a query are chosen in the tasks that read the documents
(``nearest``), so that other pairs are never made; where an index was saved, or
an id has several rows, they are chosen from ``scores``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatlas.functions.text import tokens
from vocatlas.operators import nearest
from vocatlas.operators.index import Index

# The parameters of the published runs.
K1, B = 0.9, 0.4
TOP_K = 100
#: Queries that a task holds at once, about.
QUERY_BLOCK = 2_000
#: Vectors of a task, at most, about.
VECTORS_PER_TASK = 1 << 16
SCALE = nearest.SCALE


def query_tokens(queries: DataFrame, analyzer: str = "simple", col: str = "text") -> DataFrame:
    """``query_id``, token and how often the query has it."""
    return queries.select("query_id", F.explode(tokens(F.col(col), analyzer)).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    return idf * tf / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def _hits(analyzed: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, qtf, tf, dl, df) of the queries' tokens, straight from
    analyzed documents: other tokens are never shuffled."""
    each = analyzed.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("token"))
    counted = each.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = counted.groupBy("token").agg(F.count("*").alias("df"))
    return counted.join(asked.join(df, "token"), "token")


def scores(index: Index, queries: DataFrame, field: str = "contents", k1: float = K1, b: float = B, col: str = "text") -> DataFrame:
    """``query_id``, ``doc_id`` and ``score`` of all documents that share a token with a query."""
    lengths = index.doc_stats.where(F.col("field") == field)
    whole = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    if not whole["n"]:
        return queries.select("query_id").join(index.docs.select("doc_id"), F.lit(False)).withColumn("score", F.lit(0.0))
    asked = query_tokens(queries, index.analyzer, col)
    if index.analyzed is not None:
        hits = _hits(index.analyzed.where(F.col("field") == field), asked)
        one = F.col("qtf") * weight(F.col("tf"), F.col("dl"), F.col("df"), F.lit(float(whole["n"])), F.lit(float(whole["avgdl"])), k1, b)
        return hits.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"))
    # Only the queries' tokens leave the postings and the statistics.
    stats = index.term_stats.where(F.col("field") == field).select("token", "df").join(asked, "token")
    hits = index.postings.where(F.col("field") == field).select("token", "doc_id", "tf").join(stats, "token")
    parts = hits.join(lengths.select("doc_id", "dl"), "doc_id")
    one = F.col("qtf") * weight(F.col("tf"), F.col("dl"), F.col("df"), F.lit(float(whole["n"])), F.lit(float(whole["avgdl"])), k1, b)
    return parts.groupBy("query_id", "doc_id").agg(F.sum(one).alias("score"))


def top(scored: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best ``k`` documents a query, with ``rank``; equal scores (to ``SCALE`` places) go by doc_id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCALE)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _candidates(index: Index, asked: DataFrame, k: int, field: str, k1: float = K1, b: float = B, by_max: bool = False) -> DataFrame | None:
    """Scores of rows that have the best ``k`` of each query among them, or None where they must come from ``scores``.
    ``asked``: query_id, ord, token, qtf."""
    if index.analyzed is None or k < 1:
        return None
    docs = index.analyzed.where(F.col("field") == field)
    # Rows of one id are one document, which no task need have whole.
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return None
    return _in_blocks(asked, QUERY_BLOCK, lambda block: nearest.sparse(docs, block, k, k1, b, by_max))


def _in_blocks(queries: DataFrame, block: int, find) -> DataFrame:
    """``find`` of some ``block`` queries at a time, put together."""
    blocks = -(-queries.select("query_id").distinct().count() // block) or 1
    if blocks == 1:
        return find(queries)
    dealt = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (find(queries.where(dealt == i)) for i in range(blocks)))


def search(index: Index, queries: DataFrame, k: int = TOP_K, field: str = "contents", k1: float = K1, b: float = B, col: str = "text") -> DataFrame:
    found = _candidates(index, query_tokens(queries, index.analyzer, col).withColumn("ord", F.lit(0)), k, field, k1, b)
    return top(scores(index, queries, field, k1, b, col) if found is None else found, k)


def fielded(index: Index, queries: DataFrame, weights: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """Scores over several fields, each times its weight, added up."""
    out = None
    for field, w in weights.items():
        part = scores(index, queries, field, k1, b).withColumn("score", F.col("score") * w)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def fused(index: Index, queries: DataFrame, w: float = 1.0, field: str = "contents", k: int | None = None) -> DataFrame:
    """Extension: score of the query's ``text`` plus ``w`` times that of its ``expansion``;
    with ``k`` of few more than each query's best ``k`` documents."""
    if k is not None and w > 0:
        more = query_tokens(queries.where("coalesce(expansion, '') != ''"), index.analyzer, "expansion").withColumn("qtf", F.col("qtf") * w)
        asked = query_tokens(queries, index.analyzer).withColumn("qtf", F.col("qtf").cast("double")).unionByName(more).groupBy("query_id", "token").agg(F.sum("qtf").alias("qtf"))
        found = _candidates(index, asked.withColumn("ord", F.lit(0)), k, field)
        if found is not None:
            return found
    original = scores(index, queries, field)
    extra = scores(index, queries.where("coalesce(expansion, '') != ''"), field, col="expansion").withColumn("score", F.col("score") * w)
    return original.unionByName(extra).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def synthesis(index: Index, queries: DataFrame, extra: DataFrame, budget: int, k: int | None = None) -> DataFrame:
    """Extension: a document's best score over a query and its first ``budget``
    extra queries; with ``k`` of few more than each query's best ``k`` documents.
    ``extra``: query_id, ord, text; chosen without looking at results."""
    asked = queries.select("query_id", F.lit(-1).alias("ord"), "text").unionByName(extra.where(F.col("ord") < budget).select("query_id", "ord", "text"))
    each = asked.select(F.struct("query_id", "ord").alias("query_id"), "text")
    if k is not None:
        counted = query_tokens(each, index.analyzer).select("query_id.query_id", "query_id.ord", "token", "qtf")
        found = _candidates(index, counted, k, "contents", by_max=True)
        if found is not None:
            return found
    return scores(index, each).groupBy(F.col("query_id.query_id").alias("query_id"), "doc_id").agg(F.max("score").alias("score"))


def multi_round(index: Index, queries: DataFrame, rounds: int = 2, feedback: int = 3, terms: int = 5) -> DataFrame:
    """Extension: each round adds to a query the ``terms`` rarest tokens of its
    ``feedback`` best documents, then searches again."""
    asked = queries.select("query_id", "text")
    for _ in range(rounds - 1):
        best = search(index, asked, feedback).select("query_id", "doc_id")
        stats = index.term_stats.where("field = 'contents'").select("token", "df")
        found = best.join(index.postings.where("field = 'contents'").select("doc_id", "token"), "doc_id").select("query_id", "token").distinct().join(stats.where("df > 1"), "token")
        rare = Window.partitionBy("query_id").orderBy("df", "token")
        more = found.withColumn("k", F.row_number().over(rare)).where(F.col("k") <= terms).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("more"))
        asked = asked.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))
    return scores(index, asked)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """Extension: the best ``k`` vectors of each query by cosine, itself left out.

    ``vectors``: doc_id, embedding. ``queries``: query_id, embedding; a stated
    set, of which about ``block`` are held at once, so that vectors are read once
    a block; each task keeps its best ``k``. Every query meets every vector.
    """
    n = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, -(-vectors.count() // VECTORS_PER_TASK))
    dealt = vectors.select("doc_id", "embedding").repartition(n)
    return top(_in_blocks(queries, block, lambda part: nearest.dense(dealt, part, k)), k)


def hybrid(sparse: DataFrame, dense: DataFrame, w: float = 0.5) -> DataFrame:
    """Extension: scores of two systems, each scaled to its query's best, mixed by ``w``."""
    best = Window.partitionBy("query_id")
    scaled = lambda df, f: df.withColumn("score", F.coalesce(F.try_divide(F.col("score"), F.max("score").over(best)), F.lit(0.0)) * f)
    both = scaled(sparse, w).unionByName(scaled(dense, 1 - w))
    return both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
