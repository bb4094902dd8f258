"""Enrichment records as JSON lines, under one schema whose rules are checked when written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vocatlas.operators.adjudicate import TERM, indexable_text, violations

SCHEMA_VERSION = "1.1.0"
TOKENS = "struct<prompt:bigint,completion:bigint>"
RECORD = (
    f"doc_id string, source string, original_text string, proposed_terms array<{TERM}>, llm_calls bigint, tokens {TOKENS},"
    " latency_ms bigint, model string, schema_version string"
)
FIELDS = ("doc_id", "source", "original_text", "proposed_terms", "llm_calls", "tokens", "latency_ms", "model", "schema_version")
# Where a record's document comes from.
SOURCES = ("cve", "cwe", "capec", "attack", "report", "query")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records with ``load_seq``, their order. Blank lines are skipped, other malformed
    lines raise, and what older versions lack gets its default."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("load_seq")).where(F.trim("value") != "")
    r = F.from_json("value", f"{RECORD}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("load_seq", "value", r.alias("r"))
    wrong = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | (F.coalesce("r.doc_id", F.lit("")) == "")
    doc_id = F.when(wrong, F.raise_error(F.concat(F.lit(f"{path}: malformed record: "), F.substring("value", 1, 200))).cast("string")).otherwise(F.col("r.doc_id"))
    zero = F.lit(0).cast("long")
    tokens = F.struct(F.coalesce("r.tokens.prompt", zero).alias("prompt"), F.coalesce("r.tokens.completion", zero).alias("completion"))
    return parsed.select(
        doc_id.alias("doc_id"), F.col("r.source").alias("source"), F.coalesce("r.original_text", F.lit("")).alias("original_text"),
        F.coalesce("r.proposed_terms", F.array().cast(f"array<{TERM}>")).alias("proposed_terms"), F.coalesce("r.llm_calls", zero).alias("llm_calls"), tokens.alias("tokens"),
        F.coalesce("r.latency_ms", zero).alias("latency_ms"), F.coalesce("r.model", F.lit("")).alias("model"),
        F.coalesce("r.schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"), "load_seq",
    )


def checked(records: DataFrame) -> DataFrame:
    """``records``, raising at the first that has no id or whose terms break a rule."""
    broken = F.filter(F.transform("proposed_terms", violations), lambda v: F.size(v) > 0)
    why = F.when(F.coalesce("doc_id", F.lit("")) == "", F.lit("record without doc_id")).when(
        F.size(broken) > 0, F.concat(F.lit("record "), "doc_id", F.lit(": "), F.array_join(F.flatten(broken), "; "))
    )
    why = F.coalesce(why, F.when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), F.concat(F.lit("record "), "doc_id", F.lit(": unknown source"))))
    return records.withColumn("doc_id", F.when(why.isNotNull(), F.raise_error(why).cast("string")).otherwise(F.col("doc_id")))


def write_records(records: DataFrame, path: str, append: bool = False) -> int:
    """Write checked records as JSON lines, null fields included; how many."""
    seen = Observation()
    rows = checked(records.select(*FIELDS)).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)
    return int(seen.get["n"] or 0)


def to_json(record: Column) -> Column:
    """One line of a record, term or token struct; nulls are kept, and so is what isn't ASCII."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def from_json(line: Column, schema: str = RECORD) -> Column:
    return F.from_json(line, schema, {"mode": "FAILFAST"})


# Views of a record's terms.


def accepted_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: t["accepted"])


def rejected_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: ~t["accepted"])


def repaired_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: t["repaired_from_id"].isNotNull())


def structural_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: t["kind"] == "structural")


def is_stale(t: Column) -> Column:
    return t["repaired_from_id"].isNotNull() | F.coalesce(t["reject_reason"] == "revoked", F.lit(False))


def _share(part: Column, whole: Column) -> Column:
    """Null where there is nothing to measure."""
    return F.try_divide(F.size(part).cast("double"), F.size(whole).cast("double"))


def rejection_rate(terms: Column, structural_only: bool = True) -> Column:
    pool = structural_terms(terms) if structural_only else terms
    return _share(rejected_terms(pool), pool)


def staleness_rate(terms: Column) -> Column:
    pool = structural_terms(terms)
    return _share(F.filter(pool, is_stale), pool)


def expansion_text(terms: Column, use_canonical: bool = False) -> Column:
    """The accepted terms as proposed, joined by spaces; their identifiers instead if asked for."""
    return F.array_join(F.transform(accepted_terms(terms), lambda t: indexable_text(t) if use_canonical else t["term"]), " ")


def expansions(records: DataFrame, use_canonical: bool = False) -> DataFrame:
    """``doc_id``, ``expansion`` and ``load_seq`` for the enriched index."""
    return records.select("doc_id", expansion_text(F.col("proposed_terms"), use_canonical).alias("expansion"), "load_seq")
