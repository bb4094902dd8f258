"""Connected components of links that no machine needs to hold.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
is one shuffle of the links, and the links turn into stars around each
component's least node. The links of a hub are dealt to several tasks. Steps are cut by ``checkpoint()``, so that a lost
executor costs at most one of them. Up to ``AT_ONCE`` links need no steps: one task joins them, so that the driver
doesn't plan some hundred shuffles for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatlas.llm.base import partitions, salted_join
from vocatlas.session import cut

#: Links of a task: fewer links take fewer tasks than a shuffle has partitions.
LINKS_PER_TASK = 20_000
#: Links that one task joins at once, 16 bytes each; more take star steps.
AT_ONCE = 500_000
#: Steps needed grow with the log of the longest chain; this is for chains beyond any data.
MAX_ROUNDS = 60


def _least_joined(links: DataFrame, tasks: int, n: int) -> DataFrame:
    """``links`` with ``m``, the least of a and its ends b."""
    least = links.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("__n")).coalesce(tasks)
    if tasks == 1:
        return links.join(least.drop("__n"), "a")
    return salted_join(links, least.drop("__n"), "a", least.drop("m"), n)


def _large_star(links: DataFrame, tasks: int, n: int) -> DataFrame:
    """Each node's larger neighbours now point at its least neighbour."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _least_joined(both, tasks, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    moved = moved.coalesce(tasks).distinct().coalesce(tasks)
    return moved if tasks == 1 else cut(moved)


def _small_star(links: DataFrame, tasks: int, n: int) -> DataFrame:
    """Each node and its smaller neighbours now point at the least of them. a > b."""
    joined = _least_joined(links, tasks, n)
    moved = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(joined.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct().coalesce(tasks)


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the least that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        if np.array_equal(p, q):
            return nodes, nodes[root]
        # Every root that has a lesser one beside it goes to the least of them, then each node to its new root.
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(root, up := root[root]):
            root = up


def _at_once(links: DataFrame) -> DataFrame:
    """``components`` of links that fit in a task."""
    kind = links.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(2)] for b in batches]
        if got:
            found = least_reached(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))


def components(links: DataFrame, a: str = "a", b: str = "b", tasks: int | None = None) -> DataFrame:
    """``node`` and ``root``, the least node that it reaches, for all nodes of ``links``.

    Links of a node to itself and repeated links are of no effect, null ends
    are dropped, and without links the result is empty. ``tasks`` that write the links at most, as for ``cut``.
    """
    whole = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cur = cut(whole.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), tasks)
    signs = None
    n, most = cur.count(), partitions(links.sparkSession)
    if n <= AT_ONCE:
        return cut(_at_once(cur))
    for _ in range(MAX_ROUNDS):
        tasks = max(1, min(most, -(-n // LINKS_PER_TASK)))
        nxt = cut(_small_star(_large_star(cur.coalesce(tasks), tasks, n), tasks, n))
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        cur = nxt
        if now == signs or now[0] == 0:
            break
        signs, n = now, now[0]
    else:
        raise RuntimeError("links did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
