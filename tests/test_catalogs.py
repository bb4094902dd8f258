"""Catalogue loaders and the graph made of them."""

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocatlas.operators import graph, validate
from vocatlas.sources import catalogs

HERE = Path(__file__).parent / "fixtures"


@pytest.fixture(scope="module")
def g(spark):
    g = graph.from_files(spark, str(HERE / "attack.json"), str(HERE / "cwe.xml"), str(HERE / "capec.xml"))
    return graph.Graph(*(df.coalesce(1).persist() for df in (g.nodes, g.names, g.edges, g.dangling, g.warnings)))


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_nodes(g):
    got = {r.node_id: r for r in g.nodes.collect()}
    assert len(got) == 9 + 6 + 2
    assert got["T2000"].name == "Guess Keys" and got["T2000"].description == "Guessing of keys." and got["T2000"].attrs.platforms == ["Linux"]
    assert got["T2000.001"].node_type == "subtechnique" and got["T2000.001"].aliases == ["Short Guess"]
    assert (got["T1999"].status, got["T1999"].revoked_by) == ("revoked", "T2001")
    assert got["T2002"].status == "deprecated"
    assert got["CWE-20"].description == "Keys are <weak> & short." and got["CWE-20"].attrs.abstraction == "Base"
    assert {k: got[k].status for k in ("CWE-40", "CWE-100", "CAPEC-6", "CWE-30")} == {"CWE-40": "deprecated", "CWE-100": "deprecated", "CAPEC-6": "deprecated", "CWE-30": "active"}
    assert got["CWE-100"].description == "All about keys." and got["CWE-200"].description == "A view."


def test_edges_and_warnings(g):
    assert rows(g.edges, "src", "dst", "edge_type") == sorted(
        [
            ("T2000", "TA0001", "in_tactic"), ("T3000", "TA0001", "in_tactic"), ("T2000.001", "T2000", "subtechnique_of"), ("T1999", "T2001", "revoked_by"),
            ("CWE-20", "CWE-10", "child_of"), ("CWE-30", "CWE-10", "child_of"), ("CWE-20", "CAPEC-5", "maps_to"), ("CWE-20", "CWE-100", "member_of"), ("CWE-30", "CWE-100", "member_of"),
            ("CWE-10", "CWE-200", "member_of"), ("CAPEC-5", "CAPEC-6", "child_of"), ("CAPEC-5", "CWE-20", "maps_to"), ("CAPEC-5", "T2000.001", "maps_to"),
        ]
    )
    assert rows(g.dangling, "src", "dst") == [("CAPEC-5", "CWE-999")]
    assert g.warnings.count() == 3  # an odd id, a legacy mitigation, a taxonomy entry


def test_domains_drop_nodes_but_not_edges(spark):
    c = catalogs.load_attack(spark, str(HERE / "attack.json"), ["enterprise-attack"])
    assert c.nodes.where("node_id = 'T3000'").isEmpty() and not c.nodes.where("node_id = 'T2001'").isEmpty()
    assert rows(graph.build(c).dangling, "src", "dst") == [("T3000", "TA0001")]


def test_bare_list_and_zip(spark, tmp_path):
    whole = (HERE / "attack.json").read_text()
    bare = tmp_path / "bare.json"
    bare.write_text(whole[whole.index("[") : whole.rindex("]") + 1])
    assert catalogs.load_attack(spark, str(bare)).nodes.count() == 9
    with zipfile.ZipFile(tmp_path / "cwe.xml.zip", "w") as z:
        z.write(HERE / "cwe.xml", "cwe.xml")
    assert catalogs.load_cwe(spark, str(tmp_path / "cwe.xml.zip")).nodes.count() == 6
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.txt", "")
    with pytest.raises(ValueError):
        catalogs.load_cwe(spark, str(tmp_path / "none.zip"))


def test_neighbourhoods(g):
    c = {r.node_id: r for r in graph.context(g).collect()}
    assert c["T2000.001"].parents == ["T2000"] and c["T2000"].children == ["T2000.001"]
    assert c["T2000.001"].tactics == ["TA0001"] and c["T2002"].tactics == []
    assert c["CWE-20"].siblings == ["CWE-30"] and c["CWE-20"].mapped == ["CAPEC-5"] and c["CAPEC-5"].mapped == ["CWE-20", "T2000.001"]
    terms = {r.node_id: r.terms for r in graph.expansion_terms(g, include_siblings=True).collect()}
    assert terms["CWE-20"] == ["CWE-20", "Weak Keys", "CWE-10", "Weakness", "Weak Locks"]


def test_spelled_parent_where_no_edge_says_so(spark):
    nodes = spark.createDataFrame(
        [("T1.0", 0)], "a string, load_seq long"
    ).select(F.explode(F.array(F.lit("T4000"), F.lit("T4000.001"), F.lit("T4001.001"))).alias("node_id"))
    nodes = nodes.select("node_id", F.lit("attack").alias("namespace"), F.lit("technique").alias("node_type"), F.lit("n").alias("name"), F.lit("").alias("description"), F.lit("active").alias("status"),
                         F.lit(None).cast("string").alias("revoked_by"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast(catalogs.ATTRS).alias("attrs"), F.lit(0).cast("long").alias("load_seq"))
    g = graph.build(catalogs.Catalog(nodes, spark.createDataFrame([], catalogs.EDGES), spark.createDataFrame([], catalogs.WARNINGS)))
    assert rows(graph.parents(g), "node_id", "other") == [("T4000.001", "T4000")]
    assert graph.tactics(g).isEmpty() and graph.closure(g).count() == 1


def test_resolve_by_id_then_name(spark, g):
    t = spark.createDataFrame([("t2000",), ("  OLD trick ",), ("short guess",), ("wormy",), ("guess keys",), ("T9999",), (None,)], "term string")
    got = {r.term: r.node_id for r in validate.resolve(g, t).collect()}
    assert got == {"t2000": "T2000", "  OLD trick ": "T1999", "short guess": "T2000.001", "wormy": "S1000", "guess keys": "T2000", "T9999": None, None: None}


def test_validation_table(spark, g):
    t = spark.createDataFrame([("T2000",), ("T1999",), ("T2002",), ("T9999",), ("nonsense",), (None,)], "term string")

    def run(**kw):
        return {r.term: (r.valid, r.canonical_id, r.reject_reason, r.replacement_id, r.repaired) for r in validate.validate(g, t, **kw).collect()}

    plain = run()
    assert plain["T2000"] == (True, "T2000", None, None, False)
    assert plain["T1999"] == (False, "T1999", "revoked", "T2001", False)
    assert plain["T2002"] == (False, "T2002", "deprecated", None, False)
    assert plain["T9999"] == (False, "T9999", "not_in_graph", None, False)
    assert plain["nonsense"] == plain[None] == (False, None, "malformed_id", None, False)
    other = run(allow_deprecated=True, revoked_policy="repair")
    assert other["T1999"] == (True, "T2001", "revoked", "T2001", True) and other["T2002"][0]
    assert not run(allow_deprecated=True)["T1999"][0]
    with pytest.raises(ValueError):
        run(revoked_policy="maybe")


def test_names_come_only_from_rows_that_won(spark):
    def node(i, name, description):
        return ("N", "cwe", "weakness", name, description, "active", None, [], None, i)

    nodes = spark.createDataFrame([node(0, "first", "aa"), node(1, "shorter", "a"), node(2, "longer", "aaa"), node(3, "equal", "bbb")], catalogs.NODES)
    assert graph.winners(nodes).first().name == "longer"
    assert rows(graph.name_index(nodes), "label") == [("first",), ("longer",)]


def test_empty_catalog(spark):
    g = graph.build(catalogs.empty(spark))
    assert graph.context(g).isEmpty() and graph.stats(g).isEmpty() and graph.expansion_terms(g).isEmpty()


def test_folder_of_whole_files_is_one_catalogue(spark, tmp_path):
    def weak(i, name):
        return f'<Weakness ID="{i}" Name="{name}" Status="Draft"><Description>d</Description><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="1"/></Related_Weaknesses></Weakness>'

    def thing(i, name):
        return f'{{"type": "tool", "id": "tool--{i}", "name": "{name}", "external_references": [{{"source_name": "mitre-attack", "external_id": "S000{i}"}}]}}'

    link = '{"type": "relationship", "relationship_type": "revoked-by", "source_ref": "tool--1", "target_ref": "tool--2"}'
    for folder, parts in (("cwe.xml", [weak(1, "a") + weak(2, "b"), weak(3, "c") + weak(2, "late")]), ("attack.json", [f"{thing(1, 'x')}, {link}", thing(2, "y")])):
        (tmp_path / folder).mkdir()
        for k, body in enumerate(parts):
            text = f"<W><Weaknesses>{body}</Weaknesses></W>" if folder == "cwe.xml" else f'{{"objects": [{body}]}}'
            (tmp_path / folder / f"part-{k}").write_text(text)
    c = catalogs.load_cwe(spark, str(tmp_path / "cwe.xml"))
    assert [r.name for r in c.nodes.orderBy("load_seq").collect()] == ["a", "b", "c", "late"]
    assert {r.node_id: r.name for r in graph.winners(c.nodes).collect()} == {"CWE-1": "a", "CWE-2": "b", "CWE-3": "c"}
    assert c.edges.count() == 4 and c.edges.select("load_seq").distinct().count() == 4
    a = catalogs.load_attack(spark, str(tmp_path / "attack.json"))
    assert rows(a.nodes, "node_id", "revoked_by") == [("S0001", "S0002"), ("S0002", None)] and rows(a.edges, "src", "dst") == [("S0001", "S0002")]


def test_edges_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    nodes = [(f"CWE-{i}", "cwe", "weakness", f"n{i}", "", "active", None, [], None, i) for i in range(30)]
    edges = [(f"CWE-{i % 30}", f"CWE-{i * 7 % 40}", "maps_to", i) for i in range(300)]
    c = catalogs.Catalog(spark.createDataFrame(nodes, catalogs.NODES), spark.createDataFrame(edges, catalogs.EDGES), spark.createDataFrame([], catalogs.WARNINGS))
    once = graph.build(c)
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 20)
    many = graph.build(c)
    assert (once.tasks, many.tasks) == (1, 15)
    for a, b in ((once.edges, many.edges), (once.dangling, many.dangling), (graph.mapped(once), graph.mapped(many)), (graph.stats(once), graph.stats(many))):
        assert rows(a, *a.columns) == rows(b, *b.columns) != []
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert ", 15), REPARTITION_BY_NUM" in planned(many.edges) and ", 30), REPARTITION_BY_NUM" in planned(graph.mapped(many))
    assert "REPARTITION_BY_NUM" not in planned(graph.mapped(once))
