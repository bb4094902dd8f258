"""Inverted index as Parquet: postings, document lengths and term statistics.

A field has its own postings, lengths and statistics, so that an ``expansion``
field never changes what ``contents`` scores. Lengths need no shuffle; postings
and statistics are one aggregation each, whose partial results come before the
shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatlas.functions.text import tokens
from vocatlas.operators.skew import left_join, spread

FIELDS = ("contents", "expansion")
#: A term in more than this share of documents says too little.
DF_MAX_RATIO = 0.10
PARTS = ("postings", "doc_stats", "term_stats", "docs")


@dataclass
class Index:
    """``postings`` (field, token, doc_id, tf, positions), ``doc_stats``
    (field, doc_id, dl), ``term_stats`` (field, token, df, cf), ``docs`` (doc_id, raw).

    ``analyzed`` (field, doc_id, tokens) is what an index that isn't saved was made
    of: a search of it filters tokens before anything is shuffled.
    """

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    docs: DataFrame
    analyzer: str = "simple"
    analyzed: DataFrame | None = None


def build(docs: DataFrame, analyzer: str = "simple", fields: dict[str, str] | None = None) -> Index:
    """An index of ``doc_id`` and text columns. ``fields``: index field to column."""
    fields = fields or {"contents": "text"}
    listed = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(c), analyzer).alias("tokens")) for f, c in fields.items()))
    analyzed = docs.select("doc_id", F.inline(listed))
    doc_stats = analyzed.select("field", "doc_id", F.size("tokens").cast("long").alias("dl"))
    found = analyzed.select("field", "doc_id", F.posexplode("tokens").alias("pos", "token"))
    postings = found.groupBy("field", "token", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return Index(postings, doc_stats, _term_stats(analyzed), docs.select("doc_id", F.col(fields.get("contents", next(iter(fields.values())))).alias("raw")), analyzer, analyzed)


def _term_stats(analyzed: DataFrame) -> DataFrame:
    """Document and collection frequency from (field, doc_id, tokens): each
    distinct token counts for its document, each token for the collection."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    counted = lambda df, cf: lambda t: F.struct(t.alias("token"), df.alias("df"), cf.alias("cf"))
    rows = F.concat(F.transform(F.array_distinct("tokens"), counted(one, none)), F.transform("tokens", counted(none, one)))
    return analyzed.select("field", F.inline(rows)).groupBy("field", "token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def with_expansion(docs: DataFrame, expansions: DataFrame) -> DataFrame:
    """``docs`` with ``expansion`` (empty where there is none); every document
    stays. ``expansions``: doc_id, expansion and, to choose the last of several, load_seq."""
    last = expansions.groupBy("doc_id").agg(F.max_by("expansion", "load_seq").alias("expansion"))
    return docs.join(last, "doc_id", "left").withColumn("expansion", F.coalesce("expansion", F.lit("")))


def build_enriched(docs: DataFrame, expansions: DataFrame, analyzer: str = "simple") -> Index:
    """The same documents with a second field, under the same analyzer."""
    return build(with_expansion(docs, expansions), analyzer, {"contents": "text", "expansion": "expansion"})


def save(index: Index, path: str, manifest: dict | None = None) -> None:
    """Write all parts and then the manifest, whose presence says that the index is whole."""
    if index.docs.isEmpty():
        raise ValueError("no documents to index")
    for part in PARTS:
        df = getattr(index, part)
        writer = df.write.mode("overwrite")
        (writer.partitionBy("field") if "field" in df.columns else writer).parquet(f"{path}/{part}")
    spark = index.docs.sparkSession
    spark.createDataFrame([(json.dumps({**(manifest or {}), "analyzer": index.analyzer}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Index:
    manifest = read_manifest(spark, path)
    return Index(*(spark.read.parquet(f"{path}/{p}") for p in PARTS), manifest["analyzer"])


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first().value)


def fetch(index: Index, *doc_ids) -> DataFrame:
    """Stored documents by id."""
    return index.docs.where(F.col("doc_id").isin(*doc_ids))


def total_docs(index: Index, field: str = "contents") -> int:
    return index.doc_stats.where(F.col("field") == field).count()


def term_df(terms: DataFrame, term_stats: DataFrame, analyzer: str = "simple", field: str = "contents", col: str = "term", combine: str = "combine") -> DataFrame:
    """``terms`` with ``doc_freq``: the greatest or least document frequency of
    a term's tokens as its ``combine`` column ('max' or 'min') says; unseen
    tokens count 0, and a term without tokens has 0."""
    # Each distinct (term, rule) is looked up once; null has no tokens.
    asked = terms.where(F.col(col).isNotNull()).select(F.col(col).alias("__t"), F.coalesce(combine, F.lit("")).alias("__c")).distinct()
    each = asked.select("__t", "__c", F.explode_outer(tokens(F.col("__t"), analyzer)).alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    stats = term_stats.where(F.col("field") == field).select("token", "df")
    seen = left_join(each, stats, ["token"]).withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    found = seen.groupBy("__t", "__c").agg(F.when(F.col("__c") == "min", F.min("df")).otherwise(F.max("df")).alias("doc_freq"))
    plain = [F.col(f.name) for f in terms.schema if not isinstance(f.dataType, T.MapType)]
    keyed = terms.withColumn("__t", spread(F.col(col), *plain)).withColumn("__c", F.coalesce(combine, F.lit("")))
    out = keyed.join(found, ["__t", "__c"], "left")
    return out.select(*terms.columns, F.coalesce("doc_freq", F.lit(0).cast("long")).alias("doc_freq"))


def too_common(doc_freq, total, ratio: float = DF_MAX_RATIO):
    """Whether a term's share of documents is above ``ratio``; never in an empty index."""
    return F.coalesce(F.try_divide(doc_freq.cast("double"), total.cast("double")) > ratio, F.lit(False))


def sweep(doc_freqs: DataFrame, total: int, ratios: list[float]) -> DataFrame:
    """Accepted and rejected terms by ratio (``ratio``, ``accepted``, ``rejected``), in one pass."""
    each = doc_freqs.select(F.explode(F.array(*(F.lit(float(r)) for r in ratios))).alias("ratio"), "doc_freq")
    gone = too_common(F.col("doc_freq"), F.lit(total), 0.0) & (F.col("doc_freq") / F.lit(float(total)) > F.col("ratio")) if total else F.lit(False)
    return each.groupBy("ratio").agg(F.sum(F.when(gone, 0).otherwise(1)).alias("accepted"), F.sum(F.when(gone, 1).otherwise(0)).alias("rejected"))
