"""The training-corpus pipeline: toxicity, language, near copies, benchmark
passages, then a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's documents as Parquet in the shared folder and reads them again for
the next, so that a lost executor never costs an earlier stage. All stages but
the last return the columns of ``docs``, whatever they are.

Rows without an id, repeated rows, null and empty texts pass through as the
operators define: an empty text is not toxic, has no language (it is rejected
as ``und``), and is nobody's copy. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.llm import decontaminate, language_id, mixing, near_dedup, toxicity
from vocatlas.llm.base import table
from vocatlas.session import scratch_path

#: Texts whose language is less certain are rejected.
LANGUAGE_SCORE = 0.5


def _wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all other columns in one, ``rest``: whatever their
    names, they can't clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *rest).alias("rest"))


def _as(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``_wrapped`` rows with the columns of ``docs``."""
    return rows.select(*(c if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, doesn't predict to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _as(toxicity.score(_wrapped(docs), model, carry=("text", "rest")).where("predicted = 0"), docs)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language for certain; all, where no labelled text is."""
    model = language_id.fit(docs)
    if not model.langs:
        return docs
    judged = language_id.identify(_wrapped(docs), model, carry=("text", "rest"))
    return _as(judged.where(f"lang_pred != 'und' and score >= {LANGUAGE_SCORE}"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near copies."""
    return _as(near_dedup.drop_near_copies(_wrapped(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    marked = decontaminate.mark(_wrapped(docs), table(spark, sf_dir, "benchmark"), carry=("text", "rest"))
    return _as(marked.where(~F.col("contaminated")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled for the target mix, with all their columns and the
    added ``n_tokens``, ``topic`` and ``probability``.

    Where docs has a column of such a name it stays as it is, and the added one is
    called ``mix_`` and the name. A ``topic`` of the documents' own is the one
    that is raked; without it the third marginal is a class of length."""
    taken = {c.lower() for c in docs.columns}
    own = next((c for c in docs.columns if c.lower() == "topic"), None)
    counted = _wrapped(docs).select("doc_id", "text", "rest", F.col("rest.source"), F.col("rest.lang"), mixing.count_tokens(F.col("text")).alias("n_tokens"))
    counted = counted.withColumn("topic", F.col(f"rest.`{own}`").cast("string") if own else mixing.topic_of(F.col("n_tokens")))
    mixed = mixing.mix(counted).where("sampled")
    kept = [c if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return mixed.select(*kept, *(F.col(c).alias(f"mix_{c}" if c in taken else c) for c in ("n_tokens", "topic", "probability")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Trained models and similarity components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
