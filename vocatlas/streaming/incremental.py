"""Incremental enrichment over a folder of documents that grows.

A file stream with ``availableNow`` picks up new files; each batch goes through
the same resumable run, whose anti-join with the written records makes a batch
that is delivered twice harmless. Failed documents have no record: as the
stream counts their files as read, ``retry`` runs the folder as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DOCUMENT = "doc_id string, source string, text string"


def stream(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[DataFrame], object], schema: str = DOCUMENT, fmt: str = "parquet") -> None:
    """Give each batch of new documents to ``run``, until no file is left."""
    docs = spark.readStream.schema(schema).format(fmt).load(folder)
    query = docs.writeStream.foreachBatch(lambda batch, _: run(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def retry(spark: SparkSession, folder: str, run: Callable[[DataFrame], object], schema: str = DOCUMENT, fmt: str = "parquet") -> None:
    """Give all documents to ``run``; those with a record are skipped by it."""
    run(spark.read.schema(schema).format(fmt).load(folder))
