"""The ontology graph as frames: construction, neighbourhoods and counts.

Nodes and edges of catalogues are a few thousand rows, yet nothing here relies
on that: all look-ups are equi-joins, which Spark broadcasts where a side is
small and shuffles where it is not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocatlas.functions.ids import parent_of, strip
from vocatlas.session import cut
from vocatlas.sources import catalogs

HIERARCHY = ("subtechnique_of", "child_of")
#: Edges of a task, at most, about, where they are made distinct.
EDGES_PER_TASK = 500_000
EDGE_TYPES = (*HIERARCHY, "in_tactic", "maps_to", "member_of", "revoked_by")


@dataclass
class Graph:
    """``nodes``: one row a node; ``names``: label to node; ``edges``: kept ones;
    ``dangling``: those with an absent end, repeats included; ``warnings``;
    ``tasks``: how many tasks the edges are for."""

    nodes: DataFrame
    names: DataFrame
    edges: DataFrame
    dangling: DataFrame
    warnings: DataFrame
    tasks: int = 1


def winners(nodes: DataFrame) -> DataFrame:
    """A node's row with the longest description, the earliest of equals."""
    best = Window.partitionBy("node_id").orderBy(F.desc(F.length("description")), "load_seq")
    return nodes.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def name_index(nodes: DataFrame) -> DataFrame:
    """``label`` (lower case, stripped) to ``node_id``, the first writer's.

    A node's row writes its labels only if it was the node's first or had a
    longer description than all rows of the node before it.
    """
    before = Window.partitionBy("node_id").orderBy("load_seq").rowsBetween(Window.unboundedPreceding, -1)
    wrote = nodes.withColumn("__max", F.max(F.length("description")).over(before)).where("__max is null or length(description) > __max")
    labels = wrote.select("node_id", "load_seq", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "raw"))
    labels = labels.withColumn("label", F.lower(strip(F.col("raw")))).where("label != ''")
    first = Window.partitionBy("label").orderBy("load_seq", "at")
    return labels.withColumn("__k", F.row_number().over(first)).where("__k = 1").select("label", "node_id")


def _dealt(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to ``tasks`` tasks if that is several, as sizes of shuffles say little about memory."""
    return rows.repartition(tasks, *keys) if tasks > 1 else rows


def keep_edges(nodes: DataFrame, edges: DataFrame, tasks: int = 1) -> tuple[DataFrame, DataFrame]:
    """Edges between known nodes, each (src, dst, type) once; edges that dangle."""
    known = nodes.select(F.col("node_id").alias("__n"))
    src, dst = known.select(F.col("__n").alias("src"), F.lit(True).alias("__s")), known.select(F.col("__n").alias("dst"), F.lit(True).alias("__d"))
    dealt = _dealt(edges, tasks, "src", "dst", "edge_type")
    marked = dealt.join(src, "src", "left").join(dst, "dst", "left").withColumn("__ok", F.col("__s").isNotNull() & F.col("__d").isNotNull())
    kept = marked.where("__ok").groupBy("src", "dst", "edge_type").agg(F.min("load_seq").alias("load_seq"))
    return kept, marked.where("not __ok").select("src", "dst", "edge_type", "load_seq")


def build(catalog: catalogs.Catalog) -> Graph:
    """A catalog's nodes without repeats, its names, and its kept and dangling edges."""
    nodes = winners(catalog.nodes)
    tasks = -(-catalog.edges.count() // EDGES_PER_TASK)
    kept, dangling = keep_edges(nodes, catalog.edges, tasks)
    return Graph(nodes, name_index(catalog.nodes), kept, dangling, catalog.warnings, tasks)


def from_files(spark: SparkSession, attack=None, cwe: str | None = None, capec: str | None = None, domains=None) -> Graph:
    return build(catalogs.load_all(spark, attack, cwe, capec, domains))


# Neighbourhoods: frames of (node_id, <neighbour>, ord), for all nodes at once.


def neighbours(graph: Graph, *types: str, reverse: bool = False) -> DataFrame:
    """``node_id`` and ``other`` over edges of given types, by type then order of loading."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    rank = reduce(lambda c, t: c.when(F.col("edge_type") == t[1], t[0]), enumerate(types), F.when(F.lit(False), 0))
    return graph.edges.where(F.col("edge_type").isin(*types)).select(F.col(a).alias("node_id"), F.col(b).alias("other"), F.struct(rank.alias("t"), "load_seq").alias("ord"))


def parents(graph: Graph) -> DataFrame:
    """Subtechnique's technique (by its spelling where no edge says so and it is loaded), then child_of."""
    stated = neighbours(graph, *HIERARCHY)
    has = stated.where("ord.t = 0").select("node_id").distinct()
    spelled = graph.nodes.select("node_id", parent_of(F.col("node_id")).alias("other")).where("other is not null").join(has, "node_id", "left_anti")
    spelled = spelled.join(graph.nodes.select(F.col("node_id").alias("other")), "other", "left_semi")
    return stated.unionByName(spelled.select("node_id", "other", F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("load_seq")).alias("ord")))


def children(graph: Graph) -> DataFrame:
    return neighbours(graph, *HIERARCHY, reverse=True)


def siblings(graph: Graph) -> DataFrame:
    """Other children of a node's parents, distinct."""
    up = parents(graph).select("node_id", F.col("other").alias("parent"))
    down = children(graph).select(F.col("node_id").alias("parent"), "other")
    return up.join(down, "parent").where("node_id != other").select("node_id", "other").distinct()


def tactics(graph: Graph) -> DataFrame:
    """A node's own tactics, else those of the technique that an edge names."""
    own = neighbours(graph, "in_tactic").select("node_id", "other").distinct()
    up = neighbours(graph, "subtechnique_of").select("node_id", F.col("other").alias("parent")).join(own.select("node_id").distinct(), "node_id", "left_anti")
    inherited = up.join(own.select(F.col("node_id").alias("parent"), "other"), "parent").select("node_id", "other")
    return own.unionByName(inherited).distinct()


def mapped(graph: Graph) -> DataFrame:
    """Nodes of other catalogues, by maps_to edges of either direction."""
    both = F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    return _dealt(graph.edges.where("edge_type = 'maps_to'").select(F.inline(both)), 2 * graph.tasks if graph.tasks > 1 else 1, "node_id", "other").distinct()


def _ordered(rows: DataFrame, name: str) -> DataFrame:
    packed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "other"))), lambda x: x["other"])
    return rows.groupBy("node_id").agg(packed.alias(name))


def _sorted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("node_id").agg(F.sort_array(F.collect_set("other")).alias(name))


def context(graph: Graph) -> DataFrame:
    """Per node, its fields with arrays of parents, children, siblings, tactics and mapped nodes."""
    out = graph.nodes
    none = F.array().cast("array<string>")
    for name, part in (
        ("parents", _ordered(parents(graph), "parents")),
        ("children", _ordered(children(graph), "children")),
        ("siblings", _sorted(siblings(graph), "siblings")),
        ("tactics", _sorted(tactics(graph), "tactics")),
        ("mapped", _sorted(mapped(graph), "mapped")),
    ):
        out = out.join(part, "node_id", "left").withColumn(name, F.coalesce(name, none))
    return out


def first_spellings(terms: Column) -> Column:
    """An array's strings without blanks and, ignoring case, without repeats; first spellings stay."""
    full = F.filter(terms, lambda t: t.isNotNull() & (t != ""))
    lower = F.transform(full, F.lower)
    return F.filter(full, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def expansion_terms(graph: Graph, include_siblings: bool = False) -> DataFrame:
    """``node_id`` and ``terms``: its id and name, each named parent's id and
    name, and siblings' names if asked for."""
    named = graph.nodes.select(F.col("node_id").alias("other"), F.col("name").alias("other_name")).where("other_name != ''")
    up = parents(graph).join(named, "other").groupBy("node_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "other", "other_name"))), lambda x: F.array(x["other"], x["other_name"]))).alias("up")
    )
    out = graph.nodes.select("node_id", "name").join(up, "node_id", "left")
    none = F.array().cast("array<string>")
    terms = [F.array("node_id", "name"), F.coalesce("up", none)]
    if include_siblings:
        side = siblings(graph).join(named, "other").groupBy("node_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("other", "other_name"))), lambda x: x["other_name"]).alias("side")
        )
        out = out.join(side, "node_id", "left")
        terms.append(F.coalesce("side", none))
    return out.select("node_id", first_spellings(F.concat(*terms)).alias("terms"))


def stats(graph: Graph) -> DataFrame:
    """Counts as rows (measure, value, n): nodes by namespace, type and status,
    edges by type, and the totals of nodes, edges, dangling edges and warnings."""
    pair = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.alias("value"))
    whole = F.lit("all")
    nodes = graph.nodes.select(F.explode(F.array(*(pair(c, F.col(c)) for c in ("namespace", "node_type", "status")), pair("nodes", whole))).alias("x"))
    edges = graph.edges.select(F.explode(F.array(pair("edge_type", F.col("edge_type")), pair("edges", whole))).alias("x"))
    rest = graph.dangling.select(pair("dangling", whole).alias("x")).unionByName(graph.warnings.select(pair("warnings", whole).alias("x")))
    return nodes.unionByName(edges).unionByName(rest).select("x.*").groupBy("measure", "value").agg(F.count("*").alias("n"))


def usable(nodes: DataFrame) -> DataFrame:
    return nodes.where("status = 'active'")


def node_ids(graph: Graph, namespace: str | None = None, active_only: bool = True) -> DataFrame:
    """``node_id`` in order."""
    out = usable(graph.nodes) if active_only else graph.nodes
    if namespace:
        out = out.where(F.col("namespace") == namespace)
    return out.select("node_id").orderBy("node_id")


def closure(graph: Graph, max_depth: int | None = None) -> DataFrame:
    """Extension: ``node_id``, ``ancestor`` and least ``depth`` over hierarchy
    edges, of any depth unless ``max_depth`` is given. Paths double in length
    each round until a round finds nothing new, so that rounds grow with the log
    of the depth; a cycle's nodes are ancestors of themselves.
    """
    paths = cut(parents(graph).select("node_id", F.col("other").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    known = (paths.count(), paths.count())
    while True:
        left, right = paths.alias("l"), paths.alias("r")
        longer = left.join(right, F.col("l.ancestor") == F.col("r.node_id")).select("l.node_id", "r.ancestor", (F.col("l.depth") + F.col("r.depth")).alias("depth"))
        if max_depth is not None:
            longer = longer.where(F.col("depth") <= max_depth)
        paths = cut(paths.unionByName(longer).groupBy("node_id", "ancestor").agg(F.min("depth").alias("depth")))
        now = tuple(paths.agg(F.count("*"), F.sum("depth")).first())
        if now == known:
            return paths
        known = now
