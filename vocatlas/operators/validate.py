"""Resolving identifiers and judging proposed ones against the graph.

A term is judged by the first rule that fits: it does not parse
(malformed_id); it is no node (not_in_graph); the node is revoked and the
policy is ``repair`` and its replacement is loaded (valid, repaired, under the
replacement); it is revoked (invalid, with the replacement's id if any); it is
deprecated and that is not allowed; else it is valid. A replacement's own
status is not looked at, and repairs are not chained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocatlas.functions.ids import canonical_id, strip
from vocatlas.operators.graph import Graph
from vocatlas.operators.skew import spread

POLICIES = ("reject", "repair")


def resolve(graph: Graph, terms: DataFrame, col: str = "term") -> DataFrame:
    """``terms`` with ``node_id``: what parses resolves by identifier only,
    anything else by exact name or alias, ignoring case."""
    parsed = terms.withColumn("__id", canonical_id(F.col(col))).withColumn("__label", F.when(F.col("__id").isNull(), F.lower(strip(F.col(col)))))
    by_id = graph.nodes.select(F.col("node_id").alias("__id"), F.col("node_id").alias("__n1"))
    by_name = graph.names.select(F.col("label").alias("__label"), F.col("node_id").alias("__n2"))
    out = parsed.join(by_id, "__id", "left").join(by_name, "__label", "left")
    return out.select(*terms.columns, F.coalesce("__n1", "__n2").alias("node_id"))


def validate(graph: Graph, terms: DataFrame, col: str = "term", allow_deprecated: bool = False, revoked_policy: str = "reject") -> DataFrame:
    """``terms`` with valid, canonical_id, reject_reason, replacement_id,
    repaired, node_name and original_id (the canonical id before a repair)."""
    if revoked_policy not in POLICIES:
        raise ValueError(f"unknown policy {revoked_policy!r}; known: {POLICIES}")
    node = graph.nodes.select(F.col("node_id").alias("__k"), F.lit(True).alias("__known"), F.col("status").alias("__status"), F.col("revoked_by").alias("__by"), F.col("name").alias("__name"))
    successor = graph.nodes.select(F.col("node_id").alias("__b"), F.lit(True).alias("__loaded"), F.col("name").alias("__by_name"))
    # Most terms are no identifier, and most nodes have no successor.
    rows = terms.withColumn("__id", canonical_id(F.col(col))).withColumn("__k", spread(F.col("__id"), F.col(col))).join(node, "__k", "left")
    rows = rows.withColumn("__b", spread(F.col("__by"), F.col(col))).join(successor, "__b", "left")
    revoked = F.coalesce(F.col("__status") == "revoked", F.lit(False))
    repaired = revoked & F.col("__loaded").isNotNull() & F.lit(revoked_policy == "repair")
    deprecated = F.coalesce(F.col("__status") == "deprecated", F.lit(False)) & F.lit(not allow_deprecated)
    reason = (
        F.when(F.col("__id").isNull(), "malformed_id").when(F.col("__known").isNull(), "not_in_graph").when(revoked, "revoked").when(deprecated, "deprecated")
    )
    return rows.select(
        *terms.columns,
        (repaired | reason.isNull()).alias("valid"),
        F.when(repaired, F.col("__by")).otherwise(F.col("__id")).alias("canonical_id"),
        reason.alias("reject_reason"),
        F.when(revoked, F.col("__by")).alias("replacement_id"),
        repaired.alias("repaired"),
        F.when(repaired, F.col("__by_name")).otherwise(F.col("__name")).alias("node_name"),
        F.col("__id").alias("original_id"),
    )


def known_cves(terms: DataFrame, cves: DataFrame, col: str = "term") -> DataFrame:
    """Extension: terms that are listed vulnerability ids. ``cves``: cve_id."""
    return terms.join(cves.select(F.upper("cve_id").alias("__cve")).distinct(), F.upper(strip(F.col(col))) == F.col("__cve"), "left_semi")
