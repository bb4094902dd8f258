"""The queries of the ontology, index and enrichment operators, with their DuckDB SQL.

The driver's tables hold no security data, so stand-ins serve: identifiers are
spelled from line items' keys, the graph is made of regions, nations,
customers, parts and suppliers, texts are ``documents`` and queries
``benchmark``. Where a stand-in is itself SQL, one text serves both engines.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.functions import ids, replies, text
from vocatlas.operators import adjudicate as adj
from vocatlas.operators import bm25, graph, index, metrics, nearest, validate
from vocatlas.plans import config, enrich, model
from vocatlas.session import scratch_path
from vocatlas.sources import catalogs, corpus, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "benchmark", "labels", "conversations")


def query(sql: str | None):
    """Register a query by its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL in which ``{table}`` stands for a driver's table."""
    used = {t: _read(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def _duck(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


# Identifiers

SPELLED = """SELECT l_orderkey, l_linenumber, CASE (l_orderkey * 7 + l_linenumber) % 16
 WHEN 0 THEN concat('cwe ', lpad(cast(l_partkey % 1000 AS string), 4, '0'))
 WHEN 1 THEN concat('t', cast(1000 + l_partkey % 25 AS string), '/', cast(l_suppkey % 1000 AS string))
 WHEN 2 THEN concat('MITRE ATT&CK: T', cast(1000 + l_partkey % 40 AS string))
 WHEN 3 THEN 'CWE-abc'
 WHEN 4 THEN 'heap-based'
 WHEN 5 THEN concat('CAPEC_', cast(l_suppkey % 2000 AS string), '.')
 WHEN 6 THEN concat('TA', lpad(cast(l_partkey % 9 AS string), 4, '0'))
 WHEN 7 THEN concat('ds', lpad(cast(l_partkey % 9 AS string), 4, '0'))
 WHEN 8 THEN concat('sub-technique T', cast(1000 + l_partkey % 25 AS string), '.', cast(l_suppkey % 1000 AS string))
 WHEN 9 THEN cast(l_partkey AS string)
 WHEN 10 THEN concat('  (M', lpad(cast(l_partkey % 99 AS string), 4, '0'), ') ')
 WHEN 11 THEN concat('CVE-2024-', cast(l_partkey AS string))
 WHEN 12 THEN 'S3 bucket'
 WHEN 13 THEN concat('group G', lpad(cast(l_suppkey % 99 AS string), 4, '0'), ';')
 WHEN 14 THEN 'cwe_abc'
 ELSE concat('weakness CWE:', cast(l_partkey % 10000 AS string)) END AS term FROM {lineitem}"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _bare(x: str) -> str:
    marks = ids.MARKS.replace("'", "''")
    return f"regexp_replace({_strip(x)}, '^{marks}|{marks}$', '', 'g')"


def _exact(x: str) -> str:
    up = f"upper(replace({x}, ' ', ''))"
    number = lambda p, pre: f"CASE WHEN regexp_extract({x}, '{p}', 1) != '' THEN '{pre}' || CAST(CAST(regexp_extract({x}, '{p}', 1) AS INT) AS VARCHAR) END"
    sub = f"CASE WHEN regexp_matches({up}, '{ids.SUB}') THEN 'T' || regexp_extract({up}, '{ids.SUB}', 1) || '.' || lpad(regexp_extract({up}, '{ids.SUB}', 2), 3, '0') END"
    return f"coalesce({number(ids.CWE, 'CWE-')}, {number(ids.CAPEC, 'CAPEC-')}, CASE WHEN regexp_matches({up}, '{ids.PLAIN}') THEN {up} END, {sub})"


def _canonical(x: str) -> str:
    raw = _bare(x)
    return f"coalesce({_exact(_bare(f'regexp_replace({raw}, {chr(39)}{ids.PREFIX}{chr(39)}, {chr(39)}{chr(39)})'))}, {_exact(raw)})"


def _shaped(x: str) -> str:
    raw = _bare(x)
    cleaned = _strip(f"regexp_replace({raw}, '{ids.PREFIX}', '')")
    return f"({raw} != '' AND (regexp_matches({raw}, '{ids.SHAPED}') OR regexp_matches({cleaned}, '{ids.SHAPED}')))"


_KIND_SQL = "CASE WHEN {c} LIKE 'T____.%' THEN 'subtechnique' " + " ".join(f"WHEN {{c}} LIKE '{p}%' THEN '{k}'" for p, _, k in ids.TYPES) + " END"
_SPACE_SQL = "CASE WHEN {c} LIKE 'CWE-%' THEN 'cwe' WHEN {c} LIKE 'CAPEC-%' THEN 'capec' WHEN {c} IS NOT NULL THEN 'attack' END"


@query(f"""
WITH t AS (SELECT term, count(*) AS n FROM ({_duck(SPELLED)}) GROUP BY term),
p AS (SELECT term, n, {_canonical('term')} AS canonical, {_shaped('term')} AS shaped FROM t)
SELECT term, n, canonical, {_SPACE_SQL.format(c='canonical')} AS namespace, {_KIND_SQL.format(c='canonical')} AS node_type,
  CASE WHEN canonical LIKE 'T____.%' THEN split_part(canonical, '.', 1) END AS parent_id, canonical IS NOT NULL AS structural, shaped
FROM p""")
def ids_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling parsed."""
    t = _sql(spark, sf_dir, SPELLED).groupBy("term").agg(F.count("*").alias("n"))
    return t.withColumn("p", ids.parse_id(F.col("term"))).select(
        "term", "n", "p.canonical", "p.namespace", "p.node_type", "p.parent_id", ids.looks_structural(F.col("term")).alias("structural"), ids.is_id_shaped(F.col("term")).alias("shaped")
    )


PROSE = f"""SELECT l_orderkey, array_join(array_sort(collect_list(concat(lpad(cast(l_linenumber AS string), 3, '0'), ' uses ', term, ', then'))), ' ') AS body
FROM ({SPELLED}) GROUP BY l_orderkey"""


@query(f"""
WITH p AS (SELECT l_orderkey, string_agg(lpad(cast(l_linenumber AS string), 3, '0') || ' uses ' || term || ', then', ' '
    ORDER BY lpad(cast(l_linenumber AS string), 3, '0') || ' uses ' || term || ', then') AS body FROM ({_duck(SPELLED)}) GROUP BY l_orderkey),
f AS (SELECT l_orderkey, unnest(regexp_extract_all(body, '{ids.EMBEDDED}')) AS m FROM p),
c AS (SELECT DISTINCT l_orderkey, {_canonical('m')} AS id FROM f)
SELECT p.l_orderkey, coalesce(string_agg(id, ',' ORDER BY id), '') AS ids, count(id) AS n FROM p LEFT JOIN c ON p.l_orderkey = c.l_orderkey GROUP BY p.l_orderkey""")
def ids_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: identifiers embedded in prose."""
    found = ids.extract_ids(F.col("body"))
    return _sql(spark, sf_dir, PROSE).select("l_orderkey", F.array_join(F.array_sort(found), ",").alias("ids"), F.size(found).cast("long").alias("n"))


@query("""SELECT event_id, CASE event_id % 4
  WHEN 0 THEN CASE WHEN upper(event_type) LIKE 'CVE-%' THEN event_type ELSE 'CVE-' || event_type END
  WHEN 1 THEN CASE WHEN upper(event_type) LIKE 'CWE-%' THEN event_type ELSE 'CWE-' || event_type END
  WHEN 2 THEN CASE WHEN upper(event_type) LIKE 'CAPEC-%' THEN event_type ELSE 'CAPEC-' || event_type END
  ELSE CASE WHEN upper(event_type) LIKE 'T%' THEN event_type ELSE 'T' || event_type END END AS doc_id,
  CASE WHEN lower(trim(event_type)) IN ('deprecated', 'obsolete') THEN 'deprecated' ELSE 'active' END AS status FROM events""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document ids by kind; status attributes."""
    kind = F.element_at(F.array(*map(F.lit, ("cve", "cwe", "capec", "mitre"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", ids.document_id(kind, F.col("event_type")).alias("doc_id"), ids.status_of(F.col("event_type")).alias("status"))


# The graph of stand-ins

NODES = """
SELECT concat('TA', lpad(cast(r_regionkey AS string), 4, '0')) AS node_id, 'attack' AS namespace, 'tactic' AS node_type, r_name AS name,
  concat('region ', r_name) AS description, 'active' AS status, cast(NULL AS string) AS revoked_by, r_name AS alias, cast(r_regionkey AS bigint) AS load_seq FROM {region}
UNION ALL
SELECT concat('T', cast(1000 + n_nationkey AS string)), 'attack', 'technique', n_name, concat('nation ', n_name), 'active', NULL, 'land', cast(100 + n_nationkey AS bigint) FROM {nation}
UNION ALL
SELECT concat('T', cast(1000 + c_nationkey AS string), '.', lpad(cast(c_custkey % 1000 AS string), 3, '0')), 'attack', 'subtechnique', c_name,
  concat(c_mktsegment, CASE WHEN c_acctbal > 0 THEN ' in credit' ELSE '' END), 'active', NULL, c_mktsegment, cast(1000 + c_custkey AS bigint) FROM {customer}
UNION ALL
SELECT concat('CWE-', cast(p_partkey AS string)), 'cwe', 'weakness', p_name, p_type,
  CASE WHEN p_partkey % 11 = 1 THEN 'revoked' WHEN p_partkey % 7 = 0 THEN 'deprecated' ELSE 'active' END,
  CASE WHEN p_partkey % 22 = 1 THEN concat('CWE-', cast(p_partkey + 1 AS string)) END, p_brand, cast(100000000 + 2 * p_partkey AS bigint) FROM {part}
UNION ALL
SELECT concat('CWE-', cast(p_partkey AS string)), 'cwe', 'weakness', concat(p_name, ' again'), concat(p_type, CASE WHEN p_partkey % 2 = 0 THEN ' longer' ELSE '' END),
  CASE WHEN p_partkey % 11 = 1 THEN 'revoked' WHEN p_partkey % 7 = 0 THEN 'deprecated' ELSE 'active' END,
  CASE WHEN p_partkey % 22 = 1 THEN concat('CWE-', cast(p_partkey + 1 AS string)) END, concat('again ', p_brand), cast(100000000 + 2 * p_partkey + 1 AS bigint) FROM {part} WHERE p_partkey % 5 = 0
UNION ALL
SELECT concat('CAPEC-', cast(s_suppkey AS string)), 'capec', 'attack_pattern', s_name, 'supplier', 'active', NULL, upper(s_name), cast(1000000000 + s_suppkey AS bigint) FROM {supplier}"""

EDGES = """
SELECT concat('T', cast(1000 + n_nationkey AS string)) AS src, concat('TA', lpad(cast(n_regionkey AS string), 4, '0')) AS dst, 'in_tactic' AS edge_type, cast(n_nationkey AS bigint) AS load_seq FROM {nation}
UNION ALL
SELECT concat('T', cast(1000 + c_nationkey AS string), '.', lpad(cast(c_custkey % 1000 AS string), 3, '0')), concat('T', cast(1000 + c_nationkey AS string)), 'subtechnique_of',
  cast(1000 + c_custkey AS bigint) FROM {customer} WHERE c_custkey % 3 != 0
UNION ALL
SELECT concat('CWE-', cast(p_partkey AS string)), concat('CWE-', cast(floor(p_partkey / 8) AS bigint)), 'child_of', cast(100000000 + p_partkey AS bigint) FROM {part}
UNION ALL
SELECT concat('CWE-', cast(p_partkey AS string)), concat('CWE-', cast(p_partkey + 1 AS string)), 'revoked_by', cast(200000000 + p_partkey AS bigint) FROM {part} WHERE p_partkey % 22 = 1
UNION ALL
SELECT concat('CAPEC-', cast(l_suppkey AS string)), concat('CWE-', cast(l_partkey + CASE WHEN l_linenumber = 7 THEN 9000000 ELSE 0 END AS string)), 'maps_to', cast(300000000 + l_orderkey * 10 + l_linenumber AS bigint)
FROM {lineitem}"""

GRAPH_SQL = f"""
n AS ({_duck(NODES)}),
e AS ({_duck(EDGES)}),
win AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY length(description) DESC, load_seq) AS k FROM n) WHERE k = 1),
wrote AS (SELECT * FROM (SELECT *, max(length(description)) OVER (PARTITION BY node_id ORDER BY load_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM n)
  WHERE m IS NULL OR length(description) > m),
lab AS (SELECT node_id, load_seq, 0 AS place, lower(trim(name)) AS label FROM wrote UNION ALL SELECT node_id, load_seq, 1, lower(trim(alias)) FROM wrote),
names AS (SELECT label, node_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY load_seq, place) AS k FROM lab WHERE label != '') WHERE k = 1),
kept AS (SELECT src, dst, edge_type, min(load_seq) AS load_seq FROM e WHERE src IN (SELECT node_id FROM win) AND dst IN (SELECT node_id FROM win) GROUP BY src, dst, edge_type),
dang AS (SELECT * FROM e WHERE NOT (src IN (SELECT node_id FROM win) AND dst IN (SELECT node_id FROM win))),
par AS (
  SELECT src AS node_id, dst AS other, CASE edge_type WHEN 'subtechnique_of' THEN 0 ELSE 1 END AS t, load_seq FROM kept WHERE edge_type IN ('subtechnique_of', 'child_of')
  UNION ALL
  SELECT node_id, split_part(node_id, '.', 1), 0, 0 FROM win WHERE node_id LIKE 'T____.%' AND split_part(node_id, '.', 1) IN (SELECT node_id FROM win)
    AND node_id NOT IN (SELECT src FROM kept WHERE edge_type = 'subtechnique_of')),
chi AS (SELECT dst AS node_id, src AS other, CASE edge_type WHEN 'subtechnique_of' THEN 0 ELSE 1 END AS t, load_seq FROM kept WHERE edge_type IN ('subtechnique_of', 'child_of')),
sib AS (SELECT DISTINCT p.node_id, c.other FROM par p JOIN chi c ON p.other = c.node_id WHERE p.node_id != c.other),
own AS (SELECT DISTINCT src AS node_id, dst AS other FROM kept WHERE edge_type = 'in_tactic'),
tac AS (SELECT * FROM own UNION SELECT k.src, o.other FROM kept k JOIN own o ON k.dst = o.node_id WHERE k.edge_type = 'subtechnique_of' AND k.src NOT IN (SELECT node_id FROM own)),
map AS (SELECT src AS node_id, dst AS other FROM kept WHERE edge_type = 'maps_to' UNION SELECT dst, src FROM kept WHERE edge_type = 'maps_to')"""


def stand_in_catalog(spark: SparkSession, sf_dir: str) -> catalogs.Catalog:
    nodes = _sql(spark, sf_dir, NODES).select(
        "node_id", "namespace", "node_type", "name", "description", "status", "revoked_by", F.array("alias").alias("aliases"), F.lit(None).cast(catalogs.ATTRS).alias("attrs"), "load_seq"
    )
    return catalogs.Catalog(nodes, _sql(spark, sf_dir, EDGES), spark.createDataFrame([], catalogs.WARNINGS))


def stand_in_graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build(stand_in_catalog(spark, sf_dir))


@query(f"WITH {GRAPH_SQL} SELECT node_id, namespace, node_type, name, description, status, revoked_by, load_seq FROM win")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-1, G4: one row a node, its longest description."""
    return stand_in_graph(spark, sf_dir).nodes.drop("aliases", "attrs")


@query(f"WITH {GRAPH_SQL} SELECT label, node_id FROM names")
def graph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name index: first writers of labels."""
    return stand_in_graph(spark, sf_dir).names


@query(f"WITH {GRAPH_SQL} SELECT src, dst, edge_type, load_seq FROM kept")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3, G5, H-2: kept edges."""
    return stand_in_graph(spark, sf_dir).edges


@query(f"WITH {GRAPH_SQL} SELECT src, dst, edge_type, load_seq FROM dang")
def graph_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with an absent end."""
    return stand_in_graph(spark, sf_dir).dangling


@query(f"""WITH {GRAPH_SQL}, x AS (
  SELECT 'namespace' AS measure, namespace AS value FROM win UNION ALL SELECT 'node_type', node_type FROM win UNION ALL SELECT 'status', status FROM win
  UNION ALL SELECT 'nodes', 'all' FROM win UNION ALL SELECT 'edge_type', edge_type FROM kept UNION ALL SELECT 'edges', 'all' FROM kept UNION ALL SELECT 'dangling', 'all' FROM dang)
SELECT measure, value, count(*) AS n FROM x GROUP BY measure, value""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return graph.stats(stand_in_graph(spark, sf_dir))


@query(f"WITH {GRAPH_SQL} SELECT node_id FROM win WHERE status = 'active' AND namespace = 'cwe'")
def graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable ids of a namespace."""
    return graph.node_ids(stand_in_graph(spark, sf_dir), "cwe")


def _pairs(rel: str) -> str:
    return f"WITH {GRAPH_SQL} SELECT DISTINCT node_id, other FROM {rel}"


@query(_pairs("par"))
def graph_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-7, H-8."""
    return graph.parents(stand_in_graph(spark, sf_dir)).select("node_id", "other").distinct()


@query(_pairs("chi"))
def graph_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-9."""
    return graph.children(stand_in_graph(spark, sf_dir)).select("node_id", "other").distinct()


@query(f"WITH {GRAPH_SQL} SELECT node_id, count(*) AS n, min(other) AS first, max(other) AS last FROM sib GROUP BY node_id")
def graph_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9, H-10."""
    return graph.siblings(stand_in_graph(spark, sf_dir)).groupBy("node_id").agg(F.count("*").alias("n"), F.min("other").alias("first"), F.max("other").alias("last"))


@query(_pairs("tac"))
def graph_tactics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-11."""
    return graph.tactics(stand_in_graph(spark, sf_dir))


@query(_pairs("map"))
def graph_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-12."""
    return graph.mapped(stand_in_graph(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL},
pars AS (SELECT node_id, string_agg(other, ',' ORDER BY t, load_seq, other) AS parents FROM par GROUP BY node_id), chis AS (SELECT node_id, count(*) AS n_children FROM chi GROUP BY node_id),
sibs AS (SELECT node_id, count(*) AS n_siblings FROM sib GROUP BY node_id), tacs AS (SELECT node_id, string_agg(other, ',' ORDER BY other) AS tactics FROM tac GROUP BY node_id),
maps AS (SELECT node_id, string_agg(other, ',' ORDER BY other) AS mapped FROM map GROUP BY node_id)
SELECT node_id, name, status, coalesce(parents, '') AS parents, coalesce(n_children, 0) AS n_children, coalesce(n_siblings, 0) AS n_siblings, coalesce(tactics, '') AS tactics, coalesce(mapped, '') AS mapped
FROM win LEFT JOIN pars USING (node_id) LEFT JOIN chis USING (node_id) LEFT JOIN sibs USING (node_id) LEFT JOIN tacs USING (node_id) LEFT JOIN maps USING (node_id)""")
def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-13."""
    c = graph.context(stand_in_graph(spark, sf_dir))
    j = lambda n: F.array_join(n, ",").alias(n)
    size = lambda n: F.size(n).cast("long").alias(f"n_{n}")
    return c.select("node_id", "name", "status", j("parents"), size("children"), size("siblings"), j("tactics"), j("mapped"))


@query(f"""WITH {GRAPH_SQL}, x AS (
  SELECT node_id, 0 AS a, 0 AS b, 0 AS c, node_id AS term FROM win UNION ALL SELECT node_id, 1, 0, 0, name FROM win
  UNION ALL SELECT p.node_id, 2, row_number() OVER (PARTITION BY p.node_id ORDER BY t, p.load_seq, other), 0, other FROM par p JOIN win w ON w.node_id = p.other AND w.name != ''
  UNION ALL SELECT p.node_id, 2, row_number() OVER (PARTITION BY p.node_id ORDER BY t, p.load_seq, other), 1, w.name FROM par p JOIN win w ON w.node_id = p.other AND w.name != ''),
d AS (SELECT *, row_number() OVER (PARTITION BY node_id, lower(term) ORDER BY a, b, c) AS k FROM x WHERE term != '')
SELECT node_id, string_agg(term, '|' ORDER BY a, b, c) AS terms FROM d WHERE k = 1 GROUP BY node_id""")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3, H-14."""
    return graph.expansion_terms(stand_in_graph(spark, sf_dir)).select("node_id", F.array_join("terms", "|").alias("terms"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, up AS (SELECT DISTINCT node_id, other FROM par),
walk(node_id, ancestor, depth) AS (SELECT node_id, other, 1 FROM up UNION ALL SELECT w.node_id, u.other, w.depth + 1 FROM walk w JOIN up u ON w.ancestor = u.node_id WHERE w.depth < 48)
SELECT node_id, ancestor, min(depth) AS depth FROM walk GROUP BY node_id, ancestor""")
def graph_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: all ancestors. The SQL stops cycles at a depth that no shortest path has; the operator has no bound."""
    return graph.closure(stand_in_graph(spark, sf_dir))


TERMS = f"SELECT DISTINCT term FROM ({SPELLED}) UNION SELECT p_name FROM {{part}} UNION SELECT concat('  ', p_brand, ' ') FROM {{part}}"


@query(f"""WITH {GRAPH_SQL}, t AS (SELECT term, {_canonical('term')} AS id FROM ({_duck(TERMS)}))
SELECT term, CASE WHEN id IS NOT NULL THEN (SELECT node_id FROM win WHERE node_id = id) ELSE (SELECT node_id FROM names WHERE label = lower(trim(term))) END AS node_id FROM t""")
def graph_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, E10, H-4: by identifier, else by name."""
    return validate.resolve(stand_in_graph(spark, sf_dir), _sql(spark, sf_dir, TERMS))


def _validated(repair: bool, allow: bool) -> str:
    return f"""WITH {GRAPH_SQL}, t AS (SELECT term, {_canonical('term')} AS id FROM ({_duck(TERMS)})),
j AS (SELECT t.*, w.node_id IS NOT NULL AS known, w.status, w.revoked_by, w.name, r.node_id AS loaded, r.name AS r_name
  FROM t LEFT JOIN win w ON w.node_id = t.id LEFT JOIN win r ON r.node_id = w.revoked_by),
v AS (SELECT *, {'TRUE' if repair else 'FALSE'} AND status = 'revoked' AND loaded IS NOT NULL AS rep,
  CASE WHEN id IS NULL THEN 'malformed_id' WHEN NOT known THEN 'not_in_graph' WHEN status = 'revoked' THEN 'revoked' WHEN status = 'deprecated' AND {'FALSE' if allow else 'TRUE'} THEN 'deprecated' END AS reason FROM j)
SELECT term, coalesce(rep, FALSE) OR reason IS NULL AS valid, CASE WHEN rep THEN revoked_by ELSE id END AS canonical_id, reason AS reject_reason,
  CASE WHEN status = 'revoked' THEN revoked_by END AS replacement_id, coalesce(rep, FALSE) AS repaired, CASE WHEN rep THEN r_name ELSE name END AS node_name FROM v"""


@query(_validated(False, False))
def validate_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5, H-5, H-6 under the default policy."""
    return validate.validate(stand_in_graph(spark, sf_dir), _sql(spark, sf_dir, TERMS)).drop("original_id")


@query(_validated(True, True))
def validate_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H-5 with repairs, deprecated nodes allowed."""
    return validate.validate(stand_in_graph(spark, sf_dir), _sql(spark, sf_dir, TERMS), allow_deprecated=True, revoked_policy="repair").drop("original_id")


# The index

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
INDEX_SQL = f"""
tok AS (SELECT doc_id, unnest({_TOKENS.format("coalesce(text, '')")}) AS token FROM documents),
post AS (SELECT doc_id, token, count(*) AS tf FROM tok GROUP BY doc_id, token),
lens AS (SELECT doc_id, len({_TOKENS.format("coalesce(text, '')")}) AS dl FROM documents),
tstat AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY token),
whole AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens)"""


#: Documents of a task that makes their postings, about.
DOCS_PER_TASK = 4_096


def stand_in_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build(_read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {INDEX_SQL} SELECT token, df, cf FROM tstat")
def index_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of all tokens."""
    return stand_in_index(spark, sf_dir).term_stats.select("token", "df", "cf")


@query(f"""WITH {INDEX_SQL} SELECT post.doc_id, CAST(dl AS BIGINT) AS dl, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, max(tf) AS max_tf
FROM post JOIN lens USING (doc_id) GROUP BY post.doc_id, dl""")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings, summed up by document, with its length."""
    # Once texts are dealt by id, postings, sums and lengths meet without being shuffled.
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    i = index.build(docs.repartition(-(-docs.count() // DOCS_PER_TASK) or 1, "doc_id"))
    by_doc = i.postings.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))
    return by_doc.join(i.doc_stats.select("doc_id", "dl"), "doc_id")


ASKED = """SELECT DISTINCT lower(substring(text, 1, 24)) AS term FROM {documents} UNION SELECT concat(p_name, ' the') FROM {part} UNION SELECT '...'"""


@query(f"""WITH {INDEX_SQL}, asked AS (SELECT term, c AS combine FROM ({_duck(ASKED)}) CROSS JOIN (SELECT unnest(['max', 'min']) AS c)),
each AS (SELECT term, combine, unnest({_TOKENS.format('term')}) AS token FROM asked),
f AS (SELECT term, combine, CASE combine WHEN 'max' THEN max(coalesce(df, 0)) ELSE min(coalesce(df, 0)) END AS df FROM each LEFT JOIN tstat USING (token) GROUP BY term, combine)
SELECT asked.term, asked.combine, coalesce(df, 0) AS doc_freq, coalesce(df, 0) / (SELECT n FROM whole) > 0.1 AS too_common FROM asked LEFT JOIN f ON f.term = asked.term AND f.combine = asked.combine""")
def index_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency of terms under both rules, and whether it is too common."""
    docs = _read(spark, sf_dir, "documents")
    asked = _sql(spark, sf_dir, ASKED).select("term", F.explode(F.array(F.lit("max"), F.lit("min"))).alias("combine"))
    found = index.term_df(asked, stand_in_index(spark, sf_dir).term_stats)
    return found.withColumn("too_common", index.too_common(F.col("doc_freq"), F.lit(docs.count())))


@query(f"""WITH {INDEX_SQL}, t AS (SELECT unnest([0.05, 0.1, 0.15, 0.25, 0.3]::DOUBLE[]) AS ratio)
SELECT ratio, sum(CASE WHEN df / (SELECT n FROM whole) > ratio THEN 0 ELSE 1 END)::BIGINT AS accepted, sum(CASE WHEN df / (SELECT n FROM whole) > ratio THEN 1 ELSE 0 END)::BIGINT AS rejected
FROM tstat CROSS JOIN t GROUP BY ratio""")
def index_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms accepted by frequency ratio."""
    i = stand_in_index(spark, sf_dir)
    return index.sweep(i.term_stats.select(F.col("df").alias("doc_freq")), index.total_docs(i), [0.05, 0.1, 0.15, 0.25, 0.3])


def _bm25(field: str = "", q: str = "q") -> str:
    """Scores of the queries in ``q`` (query_id, token, qtf), from relations with a suffix."""
    return f"""SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * dl / avgdl))) AS score
FROM {q} JOIN tstat{field} USING (token) JOIN post{field} USING (token) JOIN lens{field} USING (doc_id) CROSS JOIN whole{field} GROUP BY query_id, doc_id"""


QUERY_SQL = f"q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS token FROM benchmark) GROUP BY query_id, token)"
TOP_SQL = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM {s}"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {INDEX_SQL}, {QUERY_SQL}, s AS ({_bm25()}), r AS ({TOP_SQL.format(s='s')}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each query."""
    return bm25.search(stand_in_index(spark, sf_dir), _queries(spark, sf_dir), 10).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


ENRICHED_SQL = f"""
x AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, '') || ' ' || coalesce(source, '') || ' zzcanary' ELSE '' END AS expansion FROM documents),
tok_e AS (SELECT doc_id, unnest({_TOKENS.format('expansion')}) AS token FROM x),
post_e AS (SELECT doc_id, token, count(*) AS tf FROM tok_e GROUP BY doc_id, token),
lens_e AS (SELECT doc_id, len({_TOKENS.format('expansion')}) AS dl FROM x),
tstat_e AS (SELECT token, count(*) AS df FROM post_e GROUP BY token),
whole_e AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avgdl FROM lens_e)"""


def stand_in_enriched(spark: SparkSession, sf_dir: str) -> index.Index:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    extra = docs.where("doc_id % 3 = 0").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" zzcanary")).alias("expansion"), F.lit(1).alias("load_seq"))
    return index.build_enriched(docs.select("doc_id", "text"), extra)


FIELD_QUERIES = "SELECT 1 AS query_id, 'zzcanary the' AS text UNION ALL SELECT 2, 'en src3' UNION ALL SELECT 3, 'of and'"


@query(f"""WITH {INDEX_SQL}, {ENRICHED_SQL}, q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format('text')}) AS token FROM ({FIELD_QUERIES})) GROUP BY query_id, token),
a AS ({_bm25()}), b AS ({_bm25('_e')}), s AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT query_id, doc_id, 0.5 * score FROM b) GROUP BY query_id, doc_id),
r AS ({TOP_SQL.format(s='s')}) SELECT query_id, doc_id, round(score, 6) AS score FROM r WHERE rank <= 50""")
def bm25_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with half the weight of the expansion field."""
    scored = bm25.fielded(stand_in_enriched(spark, sf_dir), spark.sql(FIELD_QUERIES), {"contents": 1.0, "expansion": 0.5})
    return bm25.top(scored, 50).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, text AS raw FROM documents WHERE doc_id IN (3, 14, 15)")
def index_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents by id."""
    return index.fetch(stand_in_index(spark, sf_dir), 3, 14, 15)


FUSED_SQL = f"""
{QUERY_SQL}, qx AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("CASE WHEN item_id % 2 = 0 THEN 'the of ' || substring(text, 1, 12) ELSE '' END")}) AS token FROM benchmark) GROUP BY query_id, token),
a AS ({_bm25()}), b AS ({_bm25(q='qx')}), s AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT query_id, doc_id, 0.7 * score FROM b) GROUP BY query_id, doc_id),
r AS ({TOP_SQL.format(s='s')})"""


@query(f"WITH {INDEX_SQL}, {FUSED_SQL} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's score plus its weighted expansion's."""
    q = _queries(spark, sf_dir).withColumn("expansion", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("the of "), F.substring("text", 1, 12))).otherwise(""))
    return bm25.top(bm25.fused(stand_in_index(spark, sf_dir), q, 0.7, k=10), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


QRELS_SQL = "SELECT item_id AS query_id, doc_id, quality AS gain FROM benchmark JOIN labels ON labels.doc_id % 40 = benchmark.item_id % 40"


@query(f"""WITH {INDEX_SQL}, {QUERY_SQL}, s AS ({_bm25()}), r AS (SELECT * FROM ({TOP_SQL.format(s='s')}) WHERE rank <= 100), g AS (SELECT * FROM ({QRELS_SQL}) WHERE gain > 0),
i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN k <= 10 THEN gain / log2(k + 1.0) ELSE 0 END) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS k FROM g) GROUP BY query_id),
h AS (SELECT query_id, sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS h10, count(*) AS h100, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1.0) ELSE 0 END) AS dcg
  FROM r JOIN g USING (query_id, doc_id) GROUP BY query_id)
SELECT query_id, coalesce(round(h1 / relevant, 9), 0) AS recall_1, coalesce(round(h10 / relevant, 9), 0) AS recall_10, coalesce(round(h100 / relevant, 9), 0) AS recall_100, coalesce(round(dcg / ideal, 9), 0) AS ndcg_10
FROM i LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and NDCG by query."""
    b, lab = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "labels")
    qrels = b.join(lab, F.col("doc_id") % 40 == F.col("item_id") % 40).select(F.col("item_id").alias("query_id"), "doc_id", F.col("quality").alias("gain"))
    ranked = bm25.search(stand_in_index(spark, sf_dir), _queries(spark, sf_dir), 100)
    m = metrics.retrieval(ranked, qrels)
    return m.select("query_id", *(F.round(c, 9).alias(c) for c in m.columns[1:]))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, v.vec_id AS doc_id, list_dot_product(q.e::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS score
  FROM q, embeddings v WHERE v.vec_id != query_id),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def dense_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stated set of query vectors against all vectors, by cosine."""
    v = _read(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return bm25.dense_search(v.select(F.col("vec_id").alias("doc_id"), "embedding"), q, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {INDEX_SQL}, ex AS (SELECT item_id AS query_id, k AS ord, split_part(text, '.', k + 2) AS text FROM benchmark CROSS JOIN (SELECT unnest([0, 1, 2]) AS k)),
asked AS (SELECT item_id AS query_id, -1 AS ord, text FROM benchmark UNION ALL SELECT * FROM ex WHERE ord < 2),
q AS (SELECT query_id * 10 + ord + 1 AS query_id, token, count(*) AS qtf FROM (SELECT query_id, ord, unnest({_TOKENS.format('text')}) AS token FROM asked) GROUP BY query_id, ord, token),
a AS ({_bm25()}), s AS (SELECT query_id // 10 AS query_id, doc_id, max(score) AS score FROM a GROUP BY 1, 2), r AS ({TOP_SQL.format(s='s')})
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def bm25_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a budget of two of its extra queries."""
    q = _queries(spark, sf_dir)
    extra = q.select("query_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ord"), "text").select("query_id", "ord", F.split_part("text", F.lit("."), F.col("ord") + 2).alias("text"))
    s = bm25.synthesis(stand_in_index(spark, sf_dir), q, extra, 2, k=10)
    return bm25.top(s, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# Proposals, adjudication, records

PROPOSED = f"""SELECT l_orderkey, l_linenumber, term, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'structural' WHEN 1 THEN 'symptom' WHEN 2 THEN 'structural' ELSE 'product' END AS kind
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey * 7 + l_linenumber) % 16 = 4 AND l_orderkey % 2 = 0 THEN 'the and' ELSE term END AS term FROM ({SPELLED}))"""

JUDGED_SQL = f"""{GRAPH_SQL}, {INDEX_SQL},
p AS ({_duck(PROPOSED)}),
d AS (SELECT term, {_canonical('term')} AS id, {_shaped('term')} AS shaped FROM (SELECT DISTINCT term FROM p)),
j AS (SELECT d.*, w.node_id IS NOT NULL AS known, w.status, w.revoked_by, r.node_id AS loaded FROM d LEFT JOIN win w ON w.node_id = d.id LEFT JOIN win r ON r.node_id = w.revoked_by),
v AS (SELECT *, status = 'revoked' AND loaded IS NOT NULL AS rep,
  CASE WHEN id IS NULL THEN 'malformed_id' WHEN NOT known THEN 'not_in_graph' WHEN status = 'revoked' AND loaded IS NULL THEN 'revoked' WHEN status = 'deprecated' THEN 'deprecated' END AS reason FROM j),
k AS (SELECT l_orderkey, l_linenumber, term, CASE WHEN kind = 'structural' AND id IS NULL AND NOT shaped THEN 'colloquial' ELSE kind END AS kind, id, coalesce(rep, FALSE) AS rep, reason, revoked_by FROM p JOIN v USING (term)),
g AS (SELECT *, kind = 'structural' AS is_id, CASE WHEN kind = 'structural' THEN reason END AS why, CASE WHEN kind = 'structural' THEN CASE WHEN rep THEN revoked_by ELSE coalesce(id, term) END END AS sid FROM k),
i AS (SELECT *, CASE WHEN why IS NULL THEN CASE WHEN is_id THEN sid ELSE term END END AS body FROM g),
b AS (SELECT DISTINCT body, is_id FROM i WHERE body IS NOT NULL),
f AS (SELECT body, is_id, CASE WHEN is_id THEN min(coalesce(df, 0)) ELSE max(coalesce(df, 0)) END AS df FROM (SELECT body, is_id, unnest({_TOKENS.format('body')}) AS token FROM b) LEFT JOIN tstat USING (token) GROUP BY body, is_id),
t AS (SELECT i.*, CASE WHEN why IS NULL THEN coalesce(f.df, 0) END AS doc_freq, why IS NULL AND coalesce(f.df, 0) / (SELECT n FROM whole) > 0.1 AS common FROM i LEFT JOIN f ON f.body = i.body AND f.is_id = i.is_id),
o AS (SELECT l_orderkey, l_linenumber, term, kind, sid AS structural_id, CASE WHEN is_id THEN why IS NULL END AS graph_validated, doc_freq, why IS NULL AND NOT common AS accepted,
  CASE WHEN why IS NOT NULL THEN why WHEN common THEN 'too_common' END AS reject_reason, CASE WHEN is_id AND rep AND NOT common THEN id END AS repaired_from_id FROM t)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = stand_in_index(spark, sf_dir)
    return adj.adjudicate(_sql(spark, sf_dir, PROPOSED), stand_in_graph(spark, sf_dir), i.term_stats, index.total_docs(i), revoked_policy="repair")


@query(f"WITH {JUDGED_SQL} SELECT * REPLACE (coalesce(doc_freq, -1) AS doc_freq, coalesce(CAST(graph_validated AS VARCHAR), '') AS graph_validated) FROM o")
def adjudicated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every proposal through both gates."""
    out = _judged(spark, sf_dir).select("l_orderkey", "l_linenumber", "t.*")
    return out.withColumn("doc_freq", F.coalesce("doc_freq", F.lit(-1).cast("long"))).withColumn("graph_validated", F.coalesce(F.col("graph_validated").cast("string"), F.lit("")))


@query(f"""WITH {JUDGED_SQL}
SELECT count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (repaired_from_id IS NOT NULL) AS repaired,
  round(count(*) FILTER (kind = 'structural' AND (repaired_from_id IS NOT NULL OR reject_reason = 'revoked')) / count(*) FILTER (kind = 'structural'), 9) AS staleness_rate FROM o""")
def terms_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """totals over all terms."""
    return metrics.summarize(_judged(spark, sf_dir)).withColumn("staleness_rate", F.round("staleness_rate", 9))


@query(f"WITH {JUDGED_SQL} SELECT reject_reason, count(*) AS n FROM o WHERE NOT accepted GROUP BY reject_reason")
def rejected_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rejections by reason."""
    return metrics.rejected_by_reason(_judged(spark, sf_dir))


@query(f"""WITH {JUDGED_SQL} SELECT l_orderkey, round(avg(CASE WHEN kind = 'structural' THEN CASE WHEN accepted THEN 0.0 ELSE 1.0 END END), 9) AS rejection_rate FROM o GROUP BY l_orderkey""")
def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """by document; null without identifiers."""
    return metrics.rejection_rate(_judged(spark, sf_dir), True, "l_orderkey").withColumn("rejection_rate", F.round("rejection_rate", 9))


RECORD_OF = "'src' || CAST(l_orderkey AS VARCHAR)"


@query(f"""WITH {JUDGED_SQL}, c AS (SELECT l_orderkey, string_agg(term, ' ' ORDER BY l_linenumber, term) FILTER (accepted) AS expansion, count(*) FILTER (accepted) AS n_accepted,
  count(*) FILTER (kind = 'structural') AS n_structural, count(*) FILTER (repaired_from_id IS NOT NULL) AS n_repaired FROM o GROUP BY l_orderkey)
SELECT {RECORD_OF} AS doc_id, coalesce(expansion, '') AS expansion, n_accepted, n_structural, n_repaired, TRUE AS same FROM c""")
def records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked records to JSON and back, their views and expansion text."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "t"))), lambda x: x["t"])
    rec = _judged(spark, sf_dir).groupBy("l_orderkey").agg(terms.alias("proposed_terms"))
    zero = F.lit(0).cast("long")
    rec = rec.select(
        F.concat(F.lit("src"), F.col("l_orderkey").cast("string")).alias("doc_id"), F.lit("report").alias("source"), F.lit("naïve").alias("original_text"), "proposed_terms", F.lit(1).cast("long").alias("llm_calls"),
        F.struct(zero.alias("prompt"), zero.alias("completion")).alias("tokens"), zero.alias("latency_ms"), F.lit("none").alias("model"), F.lit(records.SCHEMA_VERSION).alias("schema_version"),
    )
    line = records.to_json(F.struct(*records.FIELDS))
    back = records.checked(rec).select(line.alias("line")).select("line", records.from_json(F.col("line")).alias("r"))
    out = back.select("r.*", (records.to_json(F.col("r")) == F.col("line")).alias("same"))
    t = F.col("proposed_terms")
    n = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id", records.expansion_text(t).alias("expansion"), n(records.accepted_terms(t)).alias("n_accepted"), n(records.structural_terms(t)).alias("n_structural"), n(records.repaired_terms(t)).alias("n_repaired"), "same"
    )


REPLIES = """SELECT event_id, event_id % 12 AS c, concat('{{"term": "', event_type, ' ', cast(event_id AS string), ' ", "kind": "symptom"}}') AS item FROM {events}"""
REPLY = """SELECT event_id, c, CASE c
 WHEN 0 THEN concat('[', item, ']')
 WHEN 1 THEN concat('```json', chr(10), '[', item, ',', item, ']', chr(10), '```')
 WHEN 2 THEN concat('Sure: [', item, '] as asked')
 WHEN 3 THEN '[]'
 WHEN 4 THEN concat('{{"terms": [', item, ']}}')
 WHEN 5 THEN concat('[', item, ', "text"]')
 WHEN 6 THEN '[{{"kind": "symptom"}}]'
 WHEN 7 THEN concat('[', item, ', {{"term": "x", "kind": "rumour"}}]')
 WHEN 8 THEN 'I cannot help with that.'
 WHEN 9 THEN '[{{"term": 3, "kind": "symptom"}}]'
 WHEN 10 THEN concat('[', item, '] trailing')
 ELSE '' END AS reply FROM (""" + REPLIES + ")"


@query("""SELECT event_id, CASE WHEN event_id % 12 IN (0, 1, 2, 3, 10) THEN 'ok' ELSE 'malformed' END AS status,
  CASE WHEN event_id % 12 IN (0, 2, 10) THEN 1 WHEN event_id % 12 = 1 THEN 2 ELSE 0 END::BIGINT AS n,
  CASE WHEN event_id % 12 IN (0, 1, 2, 10) THEN event_type || ' ' || CAST(event_id AS VARCHAR) END AS first_term FROM events""")
def replies_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with fences, prose, wrong shapes and refusals."""
    p = _sql(spark, sf_dir, REPLY).select("event_id", replies.parse_reply(F.col("reply")).alias("p"))
    return p.select("event_id", "p.status", F.size("p.proposals").cast("long").alias("n"), F.get("p.proposals", F.lit(0))["term"].alias("first_term"))


@query("""SELECT doc_id, sha256('Document ' || CAST(doc_id AS VARCHAR) || ' from ' || source || ':' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Name at most 12 terms.') AS prompt_sha256,
  substring(sha256(coalesce(text, '')), 1, 12) AS text_hash FROM documents""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of prompts and short content hashes."""
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(replies.build_prompt(F.col("source"), F.col("doc_id").cast("string"), F.col("text"), 12), 256).alias("prompt_sha256"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12).alias("text_hash"))


CALLS = """SELECT event_type AS tag, concat('u', cast(user_id % 10 AS string)) AS scope, 'stub' AS model, cast(event_id % 90 AS bigint) AS prompt, cast(event_id % 17 AS bigint) AS completion,
  cast(floor(value) AS bigint) AS latency_ms, event_id % 13 != 0 AS ok FROM {events}"""
_CALL_SUMS = "count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(prompt + completion)::BIGINT AS tokens, sum(latency_ms)::BIGINT AS latency_ms, count(*) FILTER (NOT ok) AS failures"


@query(f"SELECT tag, {_CALL_SUMS} FROM ({_duck(CALLS)}) GROUP BY tag")
def call_log_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the cost log by tag."""
    return metrics.call_log(_sql(spark, sf_dir, CALLS), "tag")


@query(f"SELECT scope, {_CALL_SUMS} FROM (SELECT unnest([scope, 'run']) AS scope, prompt, completion, latency_ms, ok FROM ({_duck(CALLS)})) GROUP BY scope")
def call_log_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scopes both see a call."""
    return metrics.by_scope(_sql(spark, sf_dir, CALLS).withColumn("scopes", F.array("scope", F.lit("run"))).drop("scope"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a record."""
    return enrich.pending(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "source")


@query(f"""WITH t AS (SELECT item_id, trim(split_part(text, '.', 1)) AS term FROM benchmark), d AS (SELECT doc_id, {_TOKENS.format("coalesce(text, '')")} AS w FROM documents)
SELECT item_id, doc_id FROM t JOIN d ON contains(chr(31) || array_to_string(w, chr(31)) || chr(31), chr(31) || array_to_string({_TOKENS.format('term')}, chr(31)) || chr(31)) WHERE len({_TOKENS.format('term')}) > 0""")
def terms_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First sentences of the benchmark's items that documents already have, a stated set of terms against all documents."""
    t = _read(spark, sf_dir, "benchmark").select("item_id", F.trim(F.split_part("text", F.lit("."), F.lit(1))).alias("term"))
    return nearest.containing(_read(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens")), t.select("item_id", text.tokens(F.col("term")).alias("tokens")), bm25.QUERY_BLOCK)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 5""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source."""
    return metrics.stratified(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 5)


# Sources, sinks and the run, over files that are written from the driver's tables


#: Elements of a stand-in catalogue's file, at most: a task reads a file whole.
FILE_ELEMENTS = 8_192


def _write_whole(rows: DataFrame, head: str, sep: str, foot: str, path: str) -> None:
    """``rows`` (part, key and ``o``, an element's text) as a folder of whole catalogues
    of so many elements, whose files by name have the elements by part and key."""
    chunk = rows.withColumn("chunk", F.floor(F.col("key") / FILE_ELEMENTS)).groupBy("part", "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "o"))), lambda x: x["o"]), sep)
    text = chunk.agg(F.concat(F.lit(head), joined, F.lit(foot)).alias("value"))
    text.orderBy("part", "chunk").select("value").write.option("maxRecordsPerFile", 1).text(path)


def _catalog_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of catalogues and knowledge bases spelled from the driver's tables."""
    at = scratch_path(spark, "catalog-files")
    n, c, r, p, s = (_read(spark, sf_dir, t) for t in ("nation", "customer", "region", "part", "supplier"))
    technique = lambda k: F.concat(F.lit("T"), (1000 + k).cast("string"))
    ref = lambda i: F.array(
        F.struct(F.lit("elsewhere").alias("source_name"), F.lit("T9999").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), i.alias("external_id"))
    )
    none = F.lit(None)

    def objects(rows: DataFrame, kind: str, order: str, **cols: Column) -> DataFrame:
        names = ("id", "name", "description", "external_references", "revoked", "x_mitre_deprecated", "x_mitre_shortname", "x_mitre_domains", "kill_chain_phases", "relationship_type", "source_ref", "target_ref")
        types = {"external_references": "array<struct<source_name:string,external_id:string>>", "revoked": "boolean", "x_mitre_deprecated": "boolean", "x_mitre_domains": "array<string>", "kill_chain_phases": "array<struct<kill_chain_name:string,phase_name:string>>"}
        o = F.struct(F.lit(kind).alias("type"), *(cols.get(x, none).cast(types.get(x, "string")).alias(x) for x in names))
        return rows.select(F.lit(order).alias("part"), cols["key"].alias("key"), F.to_json(o).alias("o"))

    parts = [
        objects(r, "x-mitre-tactic", "0", key=F.col("r_regionkey").cast("long"), id=F.concat(F.lit("tactic--"), F.col("r_regionkey").cast("string")), name=F.col("r_name"), x_mitre_shortname=F.lower("r_name"),
                external_references=ref(F.concat(F.lit("TA"), F.lpad(F.col("r_regionkey").cast("string"), 4, "0")))),
        objects(n.join(r, n.n_regionkey == r.r_regionkey), "attack-pattern", "1", key=F.col("n_nationkey").cast("long"), id=F.concat(F.lit("nation--"), F.col("n_nationkey").cast("string")), name=F.col("n_name"),
                description=F.concat(F.lit("  nation "), "n_name", F.lit(" ")), external_references=ref(technique(F.col("n_nationkey"))), x_mitre_deprecated=F.col("n_nationkey") % 7 == 3,
                x_mitre_domains=F.array(F.when(F.col("n_nationkey") % 5 == 4, "mobile").otherwise("enterprise")),
                kill_chain_phases=F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lower("r_name").alias("phase_name")))),
        objects(c, "attack-pattern", "2", key=F.col("c_custkey"), id=F.concat(F.lit("customer--"), F.col("c_custkey").cast("string")), name=F.col("c_name"),
                external_references=ref(F.when(F.col("c_custkey") % 50 == 7, "odd id").otherwise(F.concat(technique(F.col("c_nationkey")), F.lit("."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))))),
        objects(n, "course-of-action", "3", key=F.col("n_nationkey").cast("long"), id=F.concat(F.lit("legacy--"), F.col("n_nationkey").cast("string")), name=F.lit("legacy"), external_references=ref(technique(F.col("n_nationkey")))),
        objects(c, "relationship", "4", key=F.col("c_custkey"), relationship_type=F.when(F.col("c_custkey") % 4 == 0, "uses").otherwise("subtechnique-of"), source_ref=F.concat(F.lit("customer--"), F.col("c_custkey").cast("string")), target_ref=F.concat(F.lit("nation--"), F.col("c_nationkey").cast("string"))),
        objects(n.where("n_nationkey % 6 = 1"), "relationship", "5", key=F.col("n_nationkey").cast("long"), relationship_type=F.lit("revoked-by"), source_ref=F.concat(F.lit("nation--"), F.col("n_nationkey").cast("string")), target_ref=F.concat(F.lit("nation--"), (F.col("n_nationkey") + 1).cast("string"))),
    ]
    every = functools.reduce(DataFrame.unionByName, parts)
    _write_whole(every, '{"type": "bundle", "objects": [', ",\n", "]}", f"{at}/attack.json")
    weak = p.select(F.col("p_partkey").alias("key"), F.concat(
        F.lit('<Weakness ID="'), F.col("p_partkey").cast("string"), F.lit('" Name="'), "p_name", F.lit('" Abstraction="Base" Structure="Simple" Status="'), F.when(F.col("p_partkey") % 7 == 0, "Deprecated").otherwise("Draft"),
        F.lit('"><Description> <b>'), "p_type", F.lit("</b> &amp; more </Description><Related_Weaknesses>"),
        F.lit('<Related_Weakness Nature="ChildOf" CWE_ID="'), F.floor(F.col("p_partkey") / 8).cast("string"), F.lit('" View_ID="1000"/><Related_Weakness Nature="PeerOf" CWE_ID="1"/></Related_Weaknesses>'),
        F.lit('<Related_Attack_Patterns><Related_Attack_Pattern CAPEC_ID="'), (F.col("p_partkey") % 13 + 1).cast("string"), F.lit('"/></Related_Attack_Patterns></Weakness>'),
    ).alias("o"))
    # A category has as many members as there are parts of a size, so each is a file.
    boxes = p.groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit('<Has_Member CWE_ID="'), k.cast("string"), F.lit('" View_ID="1000"/>'))), "").alias("m")).select(
        (F.col("p_size").cast("long") * FILE_ELEMENTS).alias("key"), F.concat(F.lit('<Category ID="'), (10_000_000 + F.col("p_size")).cast("string"), F.lit('" Name="size" Status="Draft"><Summary>Of a size.</Summary><Relationships>'), "m", F.lit("</Relationships></Category>")).alias("o")
    )
    comment = '<!-- <Weakness ID="99999999" Name="not there" Status="Draft"></Weakness> -->'
    head = f'<?xml version="1.0"?><Weakness_Catalog xmlns="http://example.org/cwe">{comment}'
    # Which of its two lists an element stands in says the element's part.
    listed = lambda rows, part, tag: rows.select(F.lit(part).alias("part"), "key", F.concat(F.lit(f"<{tag}>"), "o", F.lit(f"</{tag}>")).alias("o"))
    _write_whole(listed(weak, "0", "Weaknesses").unionByName(listed(boxes, "1", "Categories")), head, "\n", "</Weakness_Catalog>", f"{at}/cwe.xml")
    patterns = s.select(F.lit("0").alias("part"), F.col("s_suppkey").alias("key"), F.concat(
        F.lit('<Attack_Pattern ID="'), F.col("s_suppkey").cast("string"), F.lit('" Name="'), "s_name", F.lit('" Abstraction="Meta" Status="Stable"><Description>supplier</Description>'),
        F.lit('<Related_Attack_Patterns><Related_Attack_Pattern Nature="ChildOf" CAPEC_ID="'), F.floor(F.col("s_suppkey") / 4).cast("string"), F.lit('"/></Related_Attack_Patterns>'),
        F.lit('<Related_Weaknesses><Related_Weakness CWE_ID="'), F.col("s_suppkey").cast("string"), F.lit('"/></Related_Weaknesses>'),
        F.lit('<Taxonomy_Mappings><Taxonomy_Mapping Taxonomy_Name="ATTACK"><Entry_ID>'), (1000 + F.col("s_nationkey")).cast("string"), F.lit("</Entry_ID></Taxonomy_Mapping>"),
        F.lit('<Taxonomy_Mapping Taxonomy_Name="WASC"><Entry_ID>11</Entry_ID></Taxonomy_Mapping></Taxonomy_Mappings></Attack_Pattern>'),
    ).alias("o"))
    _write_whole(patterns, '<?xml version="1.0"?><Attack_Pattern_Catalog xmlns="http://example.org/capec"><Attack_Patterns>', "\n", "</Attack_Patterns></Attack_Pattern_Catalog>", f"{at}/capec.xml")
    return at


_CUST_ID = "'T' || CAST(1000 + c_nationkey AS VARCHAR) || '.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')"
_NATION_ID = "'T' || CAST(1000 + n_nationkey AS VARCHAR)"


@query(f"""
SELECT 'TA' || lpad(CAST(r_regionkey AS VARCHAR), 4, '0') AS node_id, 'tactic' AS node_type, r_name AS name, '' AS description, 'active' AS status, CAST(NULL AS VARCHAR) AS revoked_by, 'tactic--' || CAST(r_regionkey AS VARCHAR) AS stix_id FROM region
UNION ALL
SELECT {_NATION_ID}, 'technique', n_name, 'nation ' || n_name, CASE WHEN n_nationkey % 6 = 1 AND n_nationkey < 24 AND (n_nationkey + 1) % 5 != 4 THEN 'revoked' WHEN n_nationkey % 7 = 3 THEN 'deprecated' ELSE 'active' END,
  CASE WHEN n_nationkey % 6 = 1 AND n_nationkey < 24 AND (n_nationkey + 1) % 5 != 4 THEN 'T' || CAST(1001 + n_nationkey AS VARCHAR) END, 'nation--' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 5 != 4
UNION ALL
SELECT {_CUST_ID}, 'subtechnique', c_name, '', 'active', NULL, 'customer--' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 != 7""")
def source_attack_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a bundle's enterprise objects."""
    nodes = catalogs.load_attack(spark, f"{_catalog_files(spark, sf_dir)}/attack.json", ["enterprise"]).nodes
    return nodes.select("node_id", "node_type", "name", "description", "status", "revoked_by", F.col("attrs.stix_id").alias("stix_id"))


@query(f"""
SELECT {_NATION_ID} AS src, 'TA' || lpad(CAST(n_regionkey AS VARCHAR), 4, '0') AS dst, 'in_tactic' AS edge_type FROM nation
UNION ALL SELECT {_CUST_ID}, 'T' || CAST(1000 + c_nationkey AS VARCHAR), 'subtechnique_of' FROM customer WHERE c_custkey % 50 != 7 AND c_custkey % 4 != 0
UNION ALL SELECT {_NATION_ID}, 'T' || CAST(1001 + n_nationkey AS VARCHAR), 'revoked_by' FROM nation WHERE n_nationkey % 6 = 1 AND n_nationkey < 24""")
def source_attack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a bundle, by references and by phases."""
    return catalogs.load_attack(spark, f"{_catalog_files(spark, sf_dir)}/attack.json").edges.drop("load_seq")


@query("""SELECT warning, count(*) AS n FROM (
SELECT 'unparseable id odd id' AS warning FROM customer WHERE c_custkey % 50 = 7
UNION ALL SELECT 'legacy course-of-action T' || CAST(1000 + n_nationkey AS VARCHAR) || ' skipped' FROM nation) GROUP BY warning""")
def source_attack_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: what a bundle's loader skips."""
    return catalogs.load_attack(spark, f"{_catalog_files(spark, sf_dir)}/attack.json").warnings.groupBy("warning").agg(F.count("*").alias("n"))


@query("""
SELECT 'CWE-' || CAST(p_partkey AS VARCHAR) AS node_id, 'weakness' AS node_type, p_name AS name, p_type || ' & more' AS description, CASE WHEN p_partkey % 7 = 0 THEN 'deprecated' ELSE 'active' END AS status, 'Base' AS abstraction FROM part
UNION ALL SELECT DISTINCT 'CWE-' || CAST(10000000 + p_size AS VARCHAR), 'weakness_category', 'size', 'Of a size.', 'active', CAST(NULL AS VARCHAR) FROM part
UNION ALL SELECT 'CAPEC-' || CAST(s_suppkey AS VARCHAR), 'attack_pattern', s_name, 'supplier', 'active', 'Meta' FROM supplier""")
def source_xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the weakness and pattern catalogues, none from a comment."""
    at = _catalog_files(spark, sf_dir)
    nodes = catalogs.load_all(spark, cwe=f"{at}/cwe.xml", capec=f"{at}/capec.xml").nodes
    return nodes.select("node_id", "node_type", "name", "description", "status", F.col("attrs.abstraction").alias("abstraction"))


@query("""
SELECT 'CWE-' || CAST(p_partkey AS VARCHAR) AS src, 'CWE-' || CAST(p_partkey // 8 AS VARCHAR) AS dst, 'child_of' AS edge_type FROM part
UNION ALL SELECT 'CWE-' || CAST(p_partkey AS VARCHAR), 'CAPEC-' || CAST(p_partkey % 13 + 1 AS VARCHAR), 'maps_to' FROM part
UNION ALL SELECT 'CWE-' || CAST(p_partkey AS VARCHAR), 'CWE-' || CAST(10000000 + p_size AS VARCHAR), 'member_of' FROM part
UNION ALL SELECT 'CAPEC-' || CAST(s_suppkey AS VARCHAR), 'CAPEC-' || CAST(s_suppkey // 4 AS VARCHAR), 'child_of' FROM supplier
UNION ALL SELECT 'CAPEC-' || CAST(s_suppkey AS VARCHAR), 'CWE-' || CAST(s_suppkey AS VARCHAR), 'maps_to' FROM supplier
UNION ALL SELECT 'CAPEC-' || CAST(s_suppkey AS VARCHAR), 'T' || CAST(1000 + s_nationkey AS VARCHAR), 'maps_to' FROM supplier""")
def source_xml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: hierarchy, mappings and members of the XML catalogues."""
    at = _catalog_files(spark, sf_dir)
    return catalogs.load_all(spark, cwe=f"{at}/cwe.xml", capec=f"{at}/capec.xml").edges.drop("load_seq")


def _kb(spark: SparkSession, sf_dir: str) -> str:
    """Four knowledge bases of the documents, by id."""
    at = scratch_path(spark, "kb")
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("i"), (F.col("doc_id") % 4).alias("k"), "source", "text")
    for k, (kind, field) in enumerate(corpus.ID_FIELDS.items()):
        lines = docs.where(F.col("k") == k).select(F.to_json(F.struct(F.col("i").alias(field), F.lit("other").alias("id"), F.col("source").alias("title"), F.col("text").alias("contents"))).alias("value"))
        lines.unionByName(lines.limit(1).select(F.lit("  ").alias("value"))).write.text(f"{at}/{kind}.jsonl")
    return at


_KB_SQL = """SELECT (CASE doc_id % 4 WHEN 0 THEN 'CVE-' WHEN 1 THEN 'CWE-' WHEN 2 THEN 'CAPEC-' ELSE 'T' END) || CAST(doc_id AS VARCHAR) AS doc_id,
  CASE doc_id % 4 WHEN 0 THEN 'cve' WHEN 1 THEN 'cwe' WHEN 2 THEN 'capec' ELSE 'attack' END AS source, coalesce(source, '') AS title,
  regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM documents"""


@query(f"SELECT doc_id, source, title, sha256(text) AS sha256 FROM ({_KB_SQL})")
def source_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four knowledge bases as documents."""
    docs = corpus.load_corpus(spark, _kb(spark, sf_dir))
    return docs.select("doc_id", "source", "title", F.sha2("text", 256).alias("sha256"))


@query(f"SELECT source, count(*) AS n FROM (SELECT source, CASE source WHEN 'cve' THEN 0 WHEN 'cwe' THEN 1 WHEN 'capec' THEN 2 ELSE 3 END AS k FROM ({_KB_SQL}) ORDER BY k LIMIT 120) GROUP BY source")
def source_corpus_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit across all bases takes them in order."""
    return corpus.load_corpus(spark, _kb(spark, sf_dir), limit=120).groupBy("source").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS id, sha256(text) AS sha256, CASE WHEN source = 'cwe' THEN 'more' ELSE '' END AS expansion FROM ({_KB_SQL})")
def sink_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged collection with its expansions, read back."""
    docs = corpus.load_corpus(spark, _kb(spark, sf_dir))
    # The record that was made last counts.
    made = docs.where("source = 'cwe'").select("doc_id", F.explode(F.array(F.struct(F.lit("old").alias("expansion"), F.lit(1).alias("s")), F.struct(F.lit("more").alias("expansion"), F.lit(2).alias("s")))).alias("x"))
    path = scratch_path(spark, "collection")
    corpus.write_collection(index.with_expansion(docs, made.select("doc_id", "x.expansion", F.col("x.s").cast("long").alias("load_seq"))), path)
    return spark.read.schema("id string, contents string, expansion string").json(path).select("id", F.sha2("contents", 256).alias("sha256"), "expansion")


def _refusing(prompt: str, system: str | None) -> str:
    """A model's replies: one term each, or a refusal where a text has a certain word."""
    return "I would rather not." if "stupid" in prompt else '```json\n[{"term": " xyzzy ", "kind": "product"}]\n```'


def _stub_client() -> model.StubClient:
    return model.StubClient(responder=_refusing, fail_times=1, backoff_s=0.0)


def _run(spark: SparkSession, sf_dir: str) -> tuple[list[enrich.RunSummary], str]:
    """Two runs over the documents: the second asks again for what the first failed at."""
    docs = _read(spark, sf_dir, "documents").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", F.lit("report").alias("source"), "text")
    # They are read some ten times, so their texts are shuffled once only.
    path = scratch_path(spark, "run-docs")
    docs.write.parquet(path)
    docs = spark.read.schema(docs.schema).parquet(path)
    g = graph.build(catalogs.empty(spark))
    ix = index.build(docs)
    at = scratch_path(spark, "run")
    return [enrich.run_enrichment(docs, _stub_client, g, ix, at, concurrency=2, kinds=["report"]) for _ in range(2)], at


_RUN_SQL = "d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, max(coalesce(text, '')) AS text FROM documents GROUP BY 1), r AS (SELECT *, contains(text, 'stupid') AS refused FROM d)"


@query(f"""WITH {_RUN_SQL} SELECT doc_id, 'report' AS source, sha256(text) AS sha256, 'xyzzy' AS terms, 'stub' AS model, true AS called FROM r WHERE NOT refused""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a run, as written and read back."""
    got = records.read_records(spark, _run(spark, sf_dir)[1])
    return got.select("doc_id", "source", F.sha2("original_text", 256).alias("sha256"), records.expansion_text(F.col("proposed_terms")).alias("terms"), "model", (F.col("llm_calls") >= 1).alias("called"))


@query(f"""WITH {_RUN_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE refused) AS bad FROM r)
SELECT unnest(['total', 'done before', 'processed', 'failed', 'again total', 'again done before', 'again processed', 'again failed', 'calls', 'calls failed', 'prompt tokens', 'completion tokens', 'failures written']) AS measure,
  unnest([total, 0, total - bad, bad, total, total - bad, 0, bad, total + 2 + bad + 2, 4, 10 * (total + bad), 5 * (total + bad), 2 * bad]) AS n FROM n""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs count, and the calls and failures that they wrote."""
    runs, at = _run(spark, sf_dir)
    rows = [(pre + name, n) for pre, s in zip(("", "again "), runs) for name, n in (("total", s.total_docs), ("done before", s.already_done), ("processed", s.processed), ("failed", s.failed))]
    calls = spark.read.schema("doc_id string, prompt long, completion long, ok boolean").json(f"{at}.calls")
    sums = calls.agg(F.count("*"), F.count_if(~F.col("ok")), F.sum("prompt"), F.sum("completion")).first()
    rows += list(zip(("calls", "calls failed", "prompt tokens", "completion tokens"), sums))
    rows.append(("failures written", spark.read.schema("doc_id string, error string").json(f"{at}.failures").count()))
    return spark.createDataFrame(rows, "measure string, n long")


@query("SELECT 'stub' AS model, 'report' AS kinds, true AS has_prompt, substr(sha256('abc' || chr(10)), 1, 12) AS hash")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's manifest, and the hash of a configuration file."""
    made = enrich.read_manifest(spark, f"{_run(spark, sf_dir)[1]}.manifest")
    path = scratch_path(spark, "configuration")
    spark.createDataFrame([("abc",)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(made["model"], ",".join(made["kinds"]), bool(made["prompt_version"]), config.file_hash(spark, f"{path}/*.txt"))], "model string, kinds string, has_prompt boolean, hash string")
