"""Left joins in which no key, however many rows it has, is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key of more rows than ``HOT_ROWS`` is dealt to tasks by so many rows; the ``MOST_HOT`` with the most rows, at most.
HOT_ROWS, MOST_HOT = 100_000, 1_000


def spread(key: Column, *by: Column) -> Column:
    """A string key for a join in which null has no partner: nulls, which would all be one task's, become
    keys that nothing has, by a hash of ``by``."""
    return F.coalesce(key, F.concat(F.lit("\0"), F.xxhash64(*by).cast("string")))


def left_join(rows: DataFrame, by_key: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The left join of ``rows`` with ``by_key``, which has a key once.

    Rows of a hot key are dealt by a hash of the row, and its row of ``by_key`` is repeated for each part.
    ``counts`` (keys and ``__n``) is computed where it isn't given; ``rows`` is then read twice.
    """
    counts = rows.groupBy(*on).agg(F.count("*").alias("__n")) if counts is None else counts
    most = counts.where(F.col("__n") > HOT_ROWS).orderBy(F.desc("__n"), *on).limit(MOST_HOT)
    found = most.select(*on, F.ceil(F.col("__n") / HOT_ROWS).cast("int").alias("__parts"))
    listed = found.collect()
    if not listed:
        return rows.join(by_key, on, "left")
    hot = F.broadcast(rows.sparkSession.createDataFrame(listed, found.schema))
    salt = F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.col("__parts")), F.lit(0)).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("__salt", salt).drop("__parts")
    copies = by_key.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [*on, "__salt"], "left").drop("__salt")
