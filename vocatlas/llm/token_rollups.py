"""Token counts as delta-maintained rollups.

A batch is a frame of signed changes: an insert adds a document's tokens to
the totals of its source, language and tokenizer version, a delete takes them
away, and a revised count is a delete of the old count with an insert of the
new one. Totals are sums of changes, so any grouping of any of the committed
batches adds up, no document is read twice, and order does not matter.

A store is a folder that all executors share. ``commit`` sums a batch by key,
partially before the shuffle, and writes the sums as ``batch=ID``. The batch's
``_SUCCESS`` file, which Spark writes last, is the commit: a batch that was
interrupted is written again from its start, and one that is already committed
is left alone, so that repeating a commit has no effect. ``compact`` folds
batches into one snapshot, whose folder names the batches in it by writing
their ids as rows, and readers use the newest snapshot with the batches that it
lacks.

Defined results: null keys are groups of their own, null counts are 0 tokens
of one document, changes of an unknown kind raise an error. Repeated rows
within a batch are changes of their own. Keys whose documents and tokens all
went have zero totals and are left out. Without batches there are no totals.
Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.llm.base import table
from vocatlas.session import scratch_path

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions, and the pattern that counts a version's tokens.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[0-9]{1,3}|[A-Za-z]{1,6}|[^\x00-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"}


def count(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def signed(rows: DataFrame, sign: int, tokenizer: Column | str, tokens: Column) -> DataFrame:
    """Changes from (source, lang): ``sign`` 1 inserts, -1 deletes."""
    return rows.select("source", "lang", (F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), tokens.alias("n_tokens"))


def revised(rows: DataFrame, old: tuple[str, Column], new: tuple[str, Column]) -> DataFrame:
    """Changes that replace each row's old (tokenizer, count) by the new one, made in one pass."""
    pair = F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.lit(s).alias("sign"), n.alias("n_tokens")) for s, (v, n) in ((-1, old), (1, new))))
    return rows.select("source", "lang", F.inline(pair))


class Store:
    """Totals kept as batches of sums in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _complete(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{folder}/_SUCCESS"))

    def _folders(self, kind: str) -> list[str]:
        at = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.startswith(f"{kind}=") and self._complete(n))

    def batches(self) -> list[str]:
        """Ids of the committed batches that no compaction has removed."""
        return [n.partition("=")[2] for n in self._folders("batch")]

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The newest snapshot's folder and the batches in it."""
        found = sorted((n for n in self._folders("snapshot") if self._complete(f"members={n.partition('=')[2]}")), key=lambda n: int(n.partition("=")[2]))
        if not found:
            return None, set()
        members = self.spark.read.schema("batch string").parquet(f"{self.path}/members={found[-1].partition('=')[2]}")
        return found[-1], {r.batch for r in members.collect()}

    def committed(self, batch: str) -> bool:
        return batch in self._snapshot()[1] or self._complete(f"batch={batch}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of (``KEYS``, sign, n_tokens); False if it was there already."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        sign = F.when(F.col("sign").isin(1, -1), F.col("sign").cast("long")).otherwise(F.raise_error(F.lit("sign must be 1 or -1")).cast("long"))
        sums = (
            changes.select(*KEYS, sign.alias("sign"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
            .groupBy(*KEYS)
            .agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))
        )
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self, *by: str) -> DataFrame:
        """Documents and tokens by ``by`` (all keys if none are named)."""
        by = by or KEYS
        snapshot, members = self._snapshot()
        folders = [f"{self.path}/{snapshot}"] * bool(snapshot) + [f"{self.path}/batch={b}" for b in self.batches() if b not in members]
        rows = self.spark.read.schema(SUMS).parquet(*folders) if folders else self.spark.createDataFrame([], SUMS)
        return rows.groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot, then remove them."""
        old, members = self._snapshot()
        batches = self.batches()
        if not set(batches) - members:
            return
        number = int(old.partition("=")[2]) + 1 if old else 0
        self.totals().coalesce(1).write.mode("overwrite").parquet(f"{self.path}/snapshot={number}")
        self.spark.createDataFrame([(b,) for b in sorted(members | set(batches))], "batch string").write.mode("overwrite").parquet(f"{self.path}/members={number}")
        for b in batches:
            self._fs.delete(self._path(f"{self.path}/batch={b}"), True)


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents were inserted under one tokenizer version,
    revised to the next, the first of these batches delivered twice, and the
    documents labelled of low quality deleted."""
    old, new = TOKENIZERS
    text = F.col("text")
    # Counted before any join, so that no text is ever shuffled.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", count(text, old).alias("old"), count(text, new).alias("new"))
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    first = signed(docs, 1, old, F.col("old"))
    store = Store(spark, scratch_path(spark, "token-rollups"))
    store.commit("0-insert", first)
    store.commit("1-revise", revised(docs, (old, F.col("old")), (new, F.col("new"))))
    store.commit("0-insert", first)
    store.compact()
    store.commit("2-delete", signed(docs.join(bad, "doc_id", "left_semi"), -1, new, F.col("new")))
    return store.totals()


QUERIES = {"op10_token_rollups": op10_token_rollups}
ORACLE_SQL = {
    "op10_token_rollups": rf"""
SELECT source, lang, 'pieces-2' AS tokenizer, count(*) AS n_docs,
  CAST(sum(coalesce(len(regexp_extract_all(text, '{TOKENIZERS["pieces-2"]}')), 0)) AS BIGINT) AS n_tokens
FROM documents
WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)
GROUP BY source, lang
"""
}
