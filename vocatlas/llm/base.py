"""What the operators of this subpackage share: tables, partitions, hashing."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a Python worker is sent at once, at most (rows, bytes).
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound a Python worker's batches by bytes, as texts may be long, and not by rows alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.match("[0-9]+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id's decimal text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


#: A key is hot if it holds more than one in so many rows (so hot keys are fewer than that), and more than so many.
HOT_SHARE, HOT_LEAST = 1_000, 64


def salted_join(rows: DataFrame, by_key: DataFrame, on: str, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """The inner join of ``rows`` with ``by_key``, which has few rows a key.

    Rows of a hot key are dealt to several tasks by a hash of the row, and the
    other side's rows of that key are repeated for each. The hot keys, fewer
    than ``HOT_SHARE``, are looked up first. ``counts`` (key, ``__n``) and
    ``total`` are computed where they aren't given; ``rows`` should be a table,
    as it is read twice. Null keys have no partner.
    """
    limit = max(HOT_LEAST, math.ceil((rows.count() if total is None else total) / HOT_SHARE))
    counts = rows.groupBy(on).agg(F.count("*").alias("__n")) if counts is None else counts
    found = counts.where((F.col("__n") > limit) & F.col(on).isNotNull()).select(on, F.ceil(F.col("__n") / limit).cast("int").alias("__k")).collect()
    if not found:
        return rows.join(by_key, on)
    hot = rows.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias(on), F.lit(n).alias("__k")) for k, n in found))))
    salt = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("__k")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__k")
    copies = by_key.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__k"), F.lit(1)) - 1))).drop("__k")
    return dealt.join(copies, [on, "__salt"]).drop("__salt")
