"""Threat catalogues (STIX JSON, weakness XML, attack-pattern XML) as node and edge frames.

A catalogue is a file, or a folder of files that are each whole and follow by
name. A task reads a file whole, so that a large catalogue has to be a folder.
``load_seq`` keeps the order of the source, which later decides between
repeated nodes and names.

Explicit schemas are used throughout: inferred ones turn lone members into
structs and identifiers such as 1110.001 into numbers.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from io import BytesIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.functions import ids

ATTRS = "struct<stix_id:string,platforms:array<string>,domains:array<string>,detection:string,abstraction:string,structure:string>"
NODES = (
    "node_id string, namespace string, node_type string, name string, description string, status string,"
    f" revoked_by string, aliases array<string>, attrs {ATTRS}, load_seq long"
)
EDGES = "src string, dst string, edge_type string, load_seq long"
WARNINGS = "warning string, load_seq long"

#: The publishers' names in external references and kill chains.
PUBLISHERS = ("mitre-attack", "mitre-mobile-attack", "mitre-ics-attack")
#: STIX types that are kept, with their node type.
STIX_TYPES = {
    "attack-pattern": "technique",
    "x-mitre-tactic": "tactic",
    "course-of-action": "mitigation",
    "intrusion-set": "group",
    "malware": "software",
    "tool": "software",
    "x-mitre-data-source": "data_source",
    "campaign": "campaign",
}
#: How far apart the sequences of two sources are.
SOURCE_STRIDE = 1 << 40
#: How far apart those of two files of a source are, and of two kinds of elements in a file.
FILE_STRIDE, KIND_STRIDE = 1 << 24, 1 << 22

_OBJECT = (
    "struct<type:string,id:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_shortname:string,"
    "x_mitre_detection:string,x_mitre_domains:array<string>,x_mitre_platforms:array<string>,x_mitre_aliases:array<string>,aliases:array<string>,"
    "external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,"
    "relationship_type:string,source_ref:string,target_ref:string>"
)
_MEMBERS = "struct<Has_Member:array<struct<_CWE_ID:string>>>"
_RELATED_CAPEC = "struct<Related_Attack_Pattern:array<struct<_Nature:string,_CAPEC_ID:string>>>"
_RELATED_CWE = "struct<Related_Weakness:array<struct<_Nature:string,_CWE_ID:string>>>"


@dataclass
class Catalog:
    """What a source gives: ``nodes`` (NODES), ``edges`` (EDGES), ``warnings`` (WARNINGS)."""

    nodes: DataFrame
    edges: DataFrame
    warnings: DataFrame

    def extend(self, other: Catalog) -> Catalog:
        """Both, in this order; the other's sequence must lie beyond this one's."""
        return Catalog(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges), self.warnings.unionByName(other.warnings))

    def shifted(self, by: int) -> Catalog:
        move = lambda df: df.withColumn("load_seq", F.col("load_seq") + by)
        return Catalog(move(self.nodes), move(self.edges), move(self.warnings))


def empty(spark: SparkSession) -> Catalog:
    return Catalog(*(spark.createDataFrame([], s) for s in (NODES, EDGES, WARNINGS)))


def _attrs(**given: Column) -> Column:
    lists = {"platforms", "domains"}
    names = ("stix_id", "platforms", "domains", "detection", "abstraction", "structure")
    return F.struct(*(given.get(n, F.lit(None)).cast("array<string>" if n in lists else "string").alias(n) for n in names))


def _external_id(refs: Column) -> Column:
    """The first publisher's reference with an id."""
    fit = F.filter(refs, lambda r: r["source_name"].isin(*PUBLISHERS) & (F.coalesce(r["external_id"], F.lit("")) != ""))
    return F.try_element_at(fit, F.lit(1))["external_id"]


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Each file at ``path`` as a row: ``value``, and ``began``, where the sequence of its elements begins."""
    # Contents aren't read for the names.
    names = sorted(r.file for r in spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")).collect())
    read = spark.read.text(path, wholetext=True)
    if len(names) < 2:
        return read.select("value", F.lit(0).cast("long").alias("began"))
    began = spark.createDataFrame([(n, i * FILE_STRIDE) for i, n in enumerate(names)], "file string, began long")
    return read.select("value", F.col("_metadata.file_path").alias("file")).join(F.broadcast(began), "file").select("value", "began")


def load_attack(spark: SparkSession, path: str, domains: Iterable[str] | None = None) -> Catalog:
    """A STIX bundle, or a bare list of objects; or a folder of them, as one.

    Objects of other domains than ``domains`` are left out if they name any;
    edges are made regardless, so that their ends may dangle.
    """
    raw = _whole(spark, path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    bundle = F.from_json("value", f"objects array<{_OBJECT}>", {"mode": "FAILFAST"})["objects"]
    bare = F.from_json("value", f"array<{_OBJECT}>", {"mode": "FAILFAST"})
    listed = raw.select("began", F.posexplode(F.when(F.col("value").rlike(r"^\s*\["), bare).otherwise(bundle)).alias("pos", "o"))
    rows = listed.select((F.col("began") + F.col("pos")).alias("load_seq"), "o.*").withColumn("ext", _external_id(F.col("external_references")))
    rows = rows.withColumn("parsed", ids.parse_id(F.col("ext")))

    kind = F.lit(None).cast("string")
    for t, n in STIX_TYPES.items():
        kind = F.when(F.col("type") == t, n).otherwise(kind)
    kept = rows.withColumn("kind", kind).where("kind is not null and ext is not null")
    if domains:
        named = F.size(F.coalesce("x_mitre_domains", F.array().cast("array<string>"))) > 0
        kept = kept.where(~named | F.arrays_overlap("x_mitre_domains", F.array(*(F.lit(d) for d in domains))))
    legacy = (F.col("type") != "attack-pattern") & (F.col("parsed.node_type") != F.col("kind"))
    warnings = kept.where(F.col("parsed").isNull() | legacy).select(
        F.when(F.col("parsed").isNull(), F.concat(F.lit("unparseable id "), "ext")).otherwise(F.concat(F.lit("legacy "), "type", F.lit(" "), "ext", F.lit(" skipped"))).alias("warning"),
        "load_seq",
    )
    good = kept.where(F.col("parsed").isNotNull() & ~F.coalesce(legacy, F.lit(False)))
    none = F.array().cast("array<string>")
    filled = lambda c: F.when(F.size(F.coalesce(c, none)) > 0, F.col(c))
    nodes = good.select(
        F.col("parsed.canonical").alias("node_id"), F.lit("attack").alias("namespace"),
        F.when(F.col("type") == "attack-pattern", F.col("parsed.node_type")).otherwise(F.col("kind")).alias("node_type"),
        F.coalesce("name", F.lit("")).alias("name"), ids.strip(F.coalesce("description", F.lit(""))).alias("description"),
        F.when(F.col("revoked"), "revoked").when(F.col("x_mitre_deprecated"), "deprecated").otherwise("active").alias("status"),
        F.coalesce(filled("x_mitre_aliases"), filled("aliases"), none).alias("aliases"),
        _attrs(
            stix_id=F.col("id"), platforms=F.coalesce("x_mitre_platforms", none), domains=F.coalesce("x_mitre_domains", none),
            detection=F.coalesce("x_mitre_detection", F.lit("")), abstraction=F.lit(None), structure=F.lit(None),
        ).alias("attrs"),
        "load_seq",
    )

    # The last object of an id or short name counts.
    last = lambda key: F.max_by("canonical", "load_seq").alias(key)
    known = good.select(F.col("parsed.canonical").alias("canonical"), "id", "type", "x_mitre_shortname", "load_seq")
    by_ref = known.where("id is not null").groupBy("id").agg(last("node_id"))
    by_short = known.where("type = 'x-mitre-tactic' and x_mitre_shortname is not null").groupBy("x_mitre_shortname").agg(last("node_id"))
    phases = rows.where("type = 'attack-pattern' and parsed is not null").select(F.col("parsed.canonical").alias("src"), "load_seq", F.explode("kill_chain_phases").alias("p"))
    in_tactic = phases.where(F.col("p.kill_chain_name").isin(*PUBLISHERS)).join(by_short, F.col("p.phase_name") == F.col("x_mitre_shortname")).select(
        "src", F.col("node_id").alias("dst"), F.lit("in_tactic").alias("edge_type"), "load_seq"
    )
    links = rows.where("type = 'relationship'").where(F.col("relationship_type").isin("subtechnique-of", "revoked-by"))
    related = (
        links.join(by_ref.select(F.col("id").alias("source_ref"), F.col("node_id").alias("src")), "source_ref")
        .join(by_ref.select(F.col("id").alias("target_ref"), F.col("node_id").alias("dst")), "target_ref")
        .select("src", "dst", F.when(F.col("relationship_type") == "revoked-by", "revoked_by").otherwise("subtechnique_of").alias("edge_type"), "load_seq")
    )
    edges = in_tactic.unionByName(related)
    successor = edges.where("edge_type = 'revoked_by'").groupBy(F.col("src").alias("node_id")).agg(F.max_by("dst", "load_seq").alias("revoked_by"))
    nodes = nodes.join(successor, "node_id", "left").withColumn("status", F.when(F.col("revoked_by").isNotNull(), "revoked").otherwise(F.col("status")))
    return Catalog(nodes.select(*_names(NODES)), edges.select(*_names(EDGES)), warnings)


def _names(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).fieldNames()


def unzipped(spark: SparkSession, path: str) -> str | None:
    """The text of a zip archive's first ``.xml`` member; None if ``path`` is no archive.

    Spark's readers have no zip codec. The archive comes through Spark, so that
    any store will do; a catalogue is a few megabytes.
    """
    if not path.lower().endswith(".zip"):
        return None
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    with zipfile.ZipFile(BytesIO(bytes(content))) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".xml")]
        if not names:
            raise ValueError(f"no .xml member in {path}")
        return z.read(names[0]).decode("utf-8")


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """All elements of a name, with ``load_seq`` their order in the file.

    The document is cut into elements in order on the spot, each then parsed with
    its schema; namespaces of the root are of no effect on local names.
    """
    text = unzipped(spark, path)
    whole = spark.createDataFrame([(text, 0)], "value string, began long") if text is not None else _whole(spark, path)
    # Prefixes of element names are dropped, as only local names count.
    # Comments hold no elements.
    local = F.regexp_replace(F.regexp_replace("value", r"(?s)<!--.*?-->", ""), r"(</?)[A-Za-z_][\w.\-]*:", "$1")
    found = F.regexp_extract_all(local, F.lit(rf"(?s)<{tag}(?:\s[^>]*?)?(?:/>|>.*?</{tag}\s*>)"), F.lit(0))
    rows = whole.select("began", F.posexplode(found).alias("pos", "xml"))
    return rows.select((F.col("began") + F.col("pos")).alias("load_seq"), F.from_xml("xml", schema, {"mode": "FAILFAST", "valueTag": "_VALUE"}).alias("e"), "xml").select("load_seq", "e.*", "xml")


def _inner_text(tag: str) -> Column:
    """An element's first child of a name: its text without markup, entities resolved."""
    t = F.regexp_extract("xml", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]+>", "")
    t = F.regexp_replace(t, r"(?s)^<!\[CDATA\[|\]\]>$", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return ids.strip(t)


def _number_id(prefix: str, raw: Column) -> Column:
    return F.concat(F.lit(prefix), raw.cast("int").cast("string"))


def _edges(rows: DataFrame, members: str, target: str, edge: str, prefix: str, slot: int, child_of: bool = False, reverse: bool = False) -> DataFrame:
    out = rows.select("node_id", "load_seq", F.posexplode(members).alias("i", "m")).where(F.coalesce(F.col(f"m.{target}"), F.lit("")) != "")
    if child_of:
        out = out.where(F.lower("m._Nature") == "childof")
    other = _number_id(prefix, F.col(f"m.{target}"))
    ends = (other, F.col("node_id")) if reverse else (F.col("node_id"), other)
    # An element's edges go by their place in the element: slot by slot, member by member.
    return out.select(ends[0].alias("src"), ends[1].alias("dst"), F.lit(edge).alias("edge_type"), (F.col("load_seq") * 4_000_000 + slot * 1_000_000 + F.col("i")).alias("load_seq"))


def _xml_nodes(rows: DataFrame, namespace: str, node_type: str, description: Column, **attrs: Column) -> DataFrame:
    return rows.select(
        "node_id", F.lit(namespace).alias("namespace"), F.lit(node_type).alias("node_type"), F.coalesce("_Name", F.lit("")).alias("name"), description.alias("description"),
        ids.status_of(F.col("_Status")).alias("status"), F.lit(None).cast("string").alias("revoked_by"), F.array().cast("array<string>").alias("aliases"),
        _attrs(**attrs).alias("attrs"), "load_seq",
    )


def load_cwe(spark: SparkSession, path: str) -> Catalog:
    """Weaknesses, categories and views with their hierarchy, members and attack patterns."""
    weak = _elements(
        spark, path, "Weakness",
        f"_ID string, _Name string, _Abstraction string, _Structure string, _Status string, Related_Weaknesses {_RELATED_CWE}, Related_Attack_Patterns {_RELATED_CAPEC}",
    ).where("coalesce(_ID, '') != ''").withColumn("node_id", _number_id("CWE-", F.col("_ID")))
    blank = F.lit("")
    nodes = _xml_nodes(
        weak, "cwe", "weakness", _inner_text("Description"), abstraction=F.coalesce("_Abstraction", blank), structure=F.coalesce("_Structure", blank)
    )
    edges = _edges(weak, "Related_Weaknesses.Related_Weakness", "_CWE_ID", "child_of", "CWE-", 0, child_of=True).unionByName(
        _edges(weak, "Related_Attack_Patterns.Related_Attack_Pattern", "_CAPEC_ID", "maps_to", "CAPEC-", 1)
    )
    for at, (tag, kind) in enumerate((("Category", "weakness_category"), ("View", "weakness_view")), start=1):
        box = _elements(spark, path, tag, f"_ID string, _Name string, _Status string, Relationships {_MEMBERS}, Members {_MEMBERS}")
        box = box.where("coalesce(_ID, '') != ''").withColumn("node_id", _number_id("CWE-", F.col("_ID"))).withColumn("load_seq", F.col("load_seq") + at * KIND_STRIDE)
        text = F.coalesce(F.nullif(_inner_text("Summary"), F.lit("")), _inner_text("Objective"))
        nodes = nodes.unionByName(_xml_nodes(box, "cwe", kind, text))
        for slot, members in enumerate(("Relationships.Has_Member", "Members.Has_Member")):
            edges = edges.unionByName(_edges(box, members, "_CWE_ID", "member_of", "CWE-", slot, reverse=True))
    return Catalog(nodes, edges, spark.createDataFrame([], WARNINGS))


def load_capec(spark: SparkSession, path: str) -> Catalog:
    """Attack patterns with their hierarchy, weaknesses and technique mappings."""
    rows = _elements(
        spark, path, "Attack_Pattern",
        f"_ID string, _Name string, _Abstraction string, _Status string, Related_Attack_Patterns {_RELATED_CAPEC}, Related_Weaknesses {_RELATED_CWE},"
        " Taxonomy_Mappings struct<Taxonomy_Mapping:array<struct<_Taxonomy_Name:string,Entry_ID:string>>>",
    ).where("coalesce(_ID, '') != ''").withColumn("node_id", _number_id("CAPEC-", F.col("_ID")))
    nodes = _xml_nodes(rows, "capec", "attack_pattern", _inner_text("Description"), abstraction=F.coalesce("_Abstraction", F.lit("")))
    edges = _edges(rows, "Related_Attack_Patterns.Related_Attack_Pattern", "_CAPEC_ID", "child_of", "CAPEC-", 0, child_of=True).unionByName(
        _edges(rows, "Related_Weaknesses.Related_Weakness", "_CWE_ID", "maps_to", "CWE-", 1)
    )
    entry = F.col("m.Entry_ID")
    taxa = rows.select("node_id", "load_seq", F.posexplode("Taxonomy_Mappings.Taxonomy_Mapping").alias("i", "m")).where(
        (F.upper("m._Taxonomy_Name") == "ATTACK") & (F.coalesce(ids.strip(entry), F.lit("")) != "")
    )
    taxa = taxa.withColumn("entry", ids.strip(entry)).withColumn("dst", ids.canonical_id(F.when(F.col("entry").rlike(r"^\p{L}"), F.col("entry")).otherwise(F.concat(F.lit("T"), "entry"))))
    edges = edges.unionByName(taxa.where("dst is not null").select(F.col("node_id").alias("src"), "dst", F.lit("maps_to").alias("edge_type"), (F.col("load_seq") * 4_000_000 + 2_000_000 + F.col("i")).alias("load_seq")))
    warnings = taxa.where("dst is null").select(F.concat("node_id", F.lit(": unparseable technique "), "entry").alias("warning"), "load_seq")
    return Catalog(nodes, edges, warnings)


def load_all(spark: SparkSession, attack: str | Iterable[str] | None = None, cwe: str | None = None, capec: str | None = None, domains: Iterable[str] | None = None) -> Catalog:
    """Whatever is given, in this order: techniques (one bundle or several), weaknesses, patterns."""
    domains = list(domains) if domains else None
    parts = [load_attack(spark, p, domains) for p in ([attack] if isinstance(attack, str) else list(attack or []))]
    parts += [load_cwe(spark, cwe)] * bool(cwe) + [load_capec(spark, capec)] * bool(capec)
    out = empty(spark)
    for i, part in enumerate(parts):
        out = out.extend(part.shifted(i * SOURCE_STRIDE))
    return out
