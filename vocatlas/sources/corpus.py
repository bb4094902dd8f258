"""Knowledge bases as JSON lines: reading them, and staging documents for indexing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.functions.ids import document_id, strip

# Knowledge bases in order, each with its id field and source.
ID_FIELDS = {"cve": "cve_id", "cwe": "cwe_id", "capec": "capec_id", "mitre": "mitre_id"}
SOURCES = {"cve": "cve", "cwe": "cwe", "capec": "capec", "mitre": "attack"}
KINDS = tuple(ID_FIELDS)
ROW = "id string, cve_id string, cwe_id string, capec_id string, mitre_id string, title string, contents string, _corrupt string"
CORPUS = "doc_id string, source string, title string, text string"


def load_kb(spark: SparkSession, kb_dir: str, kind: str, limit: int | None = None) -> DataFrame:
    """``doc_id``, source, title, text and ``load_seq`` (order of lines) of one base.

    ``contents`` stays the string it is. Blank lines are skipped. A line that is
    no JSON object, or has no id, raises an error that quotes the line; a limit
    of 0 gives no document.
    """
    if kind not in ID_FIELDS:
        raise ValueError(f"unknown kind {kind!r}; known: {KINDS}")
    path = f"{kb_dir}/{kind}.jsonl"
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("load_seq")).where(F.trim("value") != "")
    row = F.from_json("value", ROW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("load_seq", "value", row.alias("r"))
    raw = F.coalesce(F.nullif(F.col(f"r.{ID_FIELDS[kind]}"), F.lit("")), F.nullif(F.col("r.id"), F.lit("")))
    wrong = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | raw.isNull()
    message = F.concat(F.lit(f"{path}: malformed row: "), F.substring("value", 1, 200))
    checked = F.when(wrong, F.raise_error(message).cast("string")).otherwise(document_id(kind, raw))
    title = F.coalesce("r.title", F.lit(""))
    out = parsed.select(
        checked.alias("doc_id"), F.lit(SOURCES[kind]).alias("source"), title.alias("title"), strip(F.concat(title, F.lit(" "), F.coalesce("r.contents", F.lit("")))).alias("text"), "load_seq"
    )
    return out if limit is None else out.orderBy("load_seq").limit(limit)


def load_corpus(spark: SparkSession, kb_dir: str, kinds: Iterable[str] = KINDS, limit: int | None = None) -> DataFrame:
    """All bases in order; ``limit`` is across them."""
    out = None
    for i, kind in enumerate(kinds):
        part = load_kb(spark, kb_dir, kind).withColumn("load_seq", F.lit(i).cast("long") * (1 << 56) + F.col("load_seq"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"{CORPUS}, load_seq long")
    return out if limit is None else out.orderBy("load_seq").limit(limit)


def write_collection(docs: DataFrame, path: str) -> None:
    """``{id, contents}`` lines, with ``expansion`` where ``docs`` has it; raises if there are none."""
    if docs.isEmpty():
        raise ValueError("no documents to write")
    extra = ["expansion"] if "expansion" in docs.columns else []
    docs.select(F.col("doc_id").alias("id"), F.col("text").alias("contents"), *extra).write.mode("overwrite").option("ignoreNullFields", False).json(path)
