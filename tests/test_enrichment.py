"""Adjudication, records, cost, and the resumable run."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vocatlas.operators import adjudicate as adj
from vocatlas.operators import graph, index, metrics
from vocatlas.plans import enrich
from vocatlas.plans.model import ModelError, StubClient
from vocatlas.sources import records
from vocatlas.streaming import incremental

HERE = Path(__file__).parent / "fixtures"


@pytest.fixture(scope="module")
def g(spark):
    g = graph.from_files(spark, str(HERE / "attack.json"), str(HERE / "cwe.xml"), str(HERE / "capec.xml"))
    return graph.Graph(*(df.coalesce(1).persist() for df in (g.nodes, g.names, g.edges, g.dangling, g.warnings)))


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("contents", t, n, n) for t, n in (("cwe", 9), ("20", 1), ("10", 5), ("common", 6), ("rare", 1), ("t2001", 0), ("t2000", 4))]
    return spark.createDataFrame(rows, "field string, token string, df long, cf long").coalesce(1).persist()


PROPOSALS = [
    (0, "CWE-20", "structural"), (1, "cwe 10", "structural"), (2, "T1999", "structural"), (3, "T2002", "structural"), (4, "T9999", "structural"), (5, "CWE-abc", "structural"),
    (6, "heap-based", "structural"), (7, "common thing", "symptom"), (8, "rare thing", "product"), (9, "CWE-20", "colloquial"), (10, "...", "symptom"),
]


def test_both_gates(spark, g, stats):
    df = spark.createDataFrame(PROPOSALS, "ord int, term string, kind string")
    got = {r.ord: tuple(r.t) for r in adj.adjudicate(df, g, stats, 10, 0.4, revoked_policy="repair").collect()}
    assert got == {
        0: ("CWE-20", "structural", "CWE-20", True, 1, True, None, None),
        1: ("cwe 10", "structural", "CWE-10", True, 5, False, "too_common", None),
        2: ("T1999", "structural", "T2001", True, 0, True, None, "T1999"),
        3: ("T2002", "structural", "T2002", False, None, False, "deprecated", None),
        4: ("T9999", "structural", "T9999", False, None, False, "not_in_graph", None),
        5: ("CWE-abc", "structural", "CWE-abc", False, None, False, "malformed_id", None),
        6: ("heap-based", "colloquial", None, None, 0, True, None, None),
        7: ("common thing", "symptom", None, None, 6, False, "too_common", None),
        8: ("rare thing", "product", None, None, 1, True, None, None),
        9: ("CWE-20", "colloquial", None, None, 9, False, "too_common", None),
        10: ("...", "symptom", None, None, 0, True, None, None),
    }


def test_repaired_but_common_loses_its_origin(spark, g):
    stats = spark.createDataFrame([("contents", "t2001", 9, 9)], "field string, token string, df long, cf long")
    t = adj.adjudicate(spark.createDataFrame([("T1999", "structural")], "term string, kind string"), g, stats, 10, revoked_policy="repair").first().t
    assert (t.reject_reason, t.structural_id, t.graph_validated, t.repaired_from_id) == ("too_common", "T2001", True, None)


def test_index_gate(spark, stats):
    df = spark.createDataFrame([("rare",), ("absent",)], "term string").select(adj.accept(F.col("term"), F.lit("symptom")).alias("t"))
    assert sorted((r.t.term, r.t.reject_reason) for r in adj.index_gate(df, stats).collect()) == [("absent", "not_in_index"), ("rare", None)]


def test_rules_of_terms(spark):
    good = ("x", "symptom", None, None, 1, True, None, None)
    bad = [
        (" ", "symptom", None, None, 1, True, None, None), ("x", "rumour", None, None, 1, True, None, None), ("x", "structural", None, True, 1, True, None, None),
        ("x", "structural", "X", None, 1, True, None, None), ("x", "symptom", "X", None, 1, True, None, None), ("x", "symptom", None, None, 1, True, "too_common", None),
        ("x", "symptom", None, None, 1, False, None, None), ("x", "symptom", None, None, -1, True, None, None), ("x", "symptom", None, None, 1, False, "odd", None),
        ("x", "structural", "X", True, 1, False, "too_common", "Y"), ("x", "structural", "X", True, 1, True, None, "X"),
    ]
    df = spark.createDataFrame([(t,) for t in [good, *bad]], f"t {adj.TERM}")
    assert [r[0] for r in df.select(adj.is_valid_term(F.col("t"))).collect()] == [True] + [False] * len(bad)


TERMS = [
    ("a", "structural", "T2001", True, 1, True, None, "T1999"), ("b", "structural", "B", False, None, False, "revoked", None),
    ("c", "structural", "C", False, None, False, "malformed_id", None), ("d é", "symptom", None, None, 2, True, None, None),
]


def record(spark, terms, doc_id="D", source="cve"):
    return spark.createDataFrame([(doc_id, source, "naïve text", terms, 1, (3, 4), 5, "m", "1.1.0")], records.RECORD)


def test_record_views(spark):
    df = record(spark, TERMS).unionByName(record(spark, [], "E"))
    t = F.col("proposed_terms")
    got = df.select("doc_id", records.rejection_rate(t).alias("r"), records.rejection_rate(t, False).alias("all"), records.staleness_rate(t).alias("s"), records.expansion_text(t).alias("x"),
                    records.expansion_text(t, True).alias("c")).collect()
    assert tuple(got[0]) == ("D", pytest.approx(2 / 3), 0.5, pytest.approx(2 / 3), "a d é", "T2001 d é")
    assert tuple(got[1]) == ("E", None, None, None, "", "")
    summary = metrics.summarize(metrics.exploded(df)).first()
    assert tuple(summary) == (2, 2, 1, pytest.approx(2 / 3))
    assert metrics.summarize(metrics.exploded(df.where("doc_id = 'E'"))).first().staleness_rate is None


def test_record_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    assert records.write_records(record(spark, TERMS), path) == 1
    assert records.write_records(record(spark, [], "E"), path, append=True) == 1
    back = {r.doc_id: r for r in records.read_records(spark, path).collect()}
    assert [tuple(t) for t in back["D"].proposed_terms] == TERMS and tuple(back["D"].tokens) == (3, 4) and back["D"].original_text == "naïve text"
    assert '"reject_reason":null' in "".join(p.read_text() for p in Path(path).glob("part-*"))


def test_old_and_malformed_records(spark, tmp_path):
    (tmp_path / "old.jsonl").write_text('{"doc_id": "D", "source": "cve", "proposed_terms": [{"term": "x", "kind": "symptom", "accepted": true}]}\n\n')
    r = records.read_records(spark, str(tmp_path / "old.jsonl")).first()
    assert r.proposed_terms[0].repaired_from_id is None and r.llm_calls == 0 and tuple(r.tokens) == (0, 0)
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="malformed record"):
        records.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    for wrong in (record(spark, [], ""), record(spark, [], "D", "odd"), record(spark, [("x", "structural", None, None, 0, True, None, None)])):
        with pytest.raises(Exception, match="record"):
            records.write_records(wrong, str(tmp_path / "w"))


def test_client_attempts():
    slept = []
    client = StubClient(responder=lambda p, s: "hi", fail_times=2, sleep=slept.append)
    reply, attempts = client.generate("p", tag="t")
    assert reply == "hi" and [a.ok for a in attempts] == [False, False, True] and slept == [1.0, 2.0]
    assert [(a.prompt, a.completion) for a in attempts] == [(0, 0), (0, 0), (10, 5)] and attempts[0].to_dict()["error"] == "stub failure"
    with pytest.raises(ModelError) as e:
        StubClient(fail_times=9, sleep=slept.append).generate("p")
    assert len(e.value.attempts) == 3 and slept == [1.0, 2.0, 1.0, 2.0]


def test_call_log(spark):
    rows = [("m", 10, 5, 7, True, "a", None, 0.0, ["run", "doc1"]), ("m", 0, 0, 3, False, "a", "x", 0.0, ["run"]), ("m", 1, 1, 1, True, "b", None, 0.0, ["run", "doc1"])]
    calls = spark.createDataFrame(rows, "model string, prompt long, completion long, latency_ms long, ok boolean, tag string, error string, started_at double, scopes array<string>")
    assert tuple(metrics.call_log(calls).first()) == (3, 11, 6, 17, 11, 1)
    assert {r.scope: (r.calls, r.tokens, r.failures) for r in metrics.by_scope(calls).collect()} == {"run": (3, 17, 1), "doc1": (2, 17, 0)}
    assert tuple(metrics.call_log(calls.limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def answer(prompt, system):
    if "BROKEN" in prompt:
        return "I refuse."
    if "DOWN" in prompt:
        raise ConnectionError("down")
    terms = [{"term": "rare", "kind": "symptom"}, {"term": "T1999", "kind": "structural"}, {"term": "one too many", "kind": "symptom"}]
    return json.dumps(terms)


def client():
    return StubClient(responder=answer, max_retries=1, backoff_s=0.0)


def mended():
    return StubClient(responder=lambda p, s: "[]")


DOCS = [("D1", "cve", "one"), ("D2", "cwe", "BROKEN"), ("D3", "cve", "DOWN"), ("D4", "cve", None)]


def test_run_resumes(spark, g, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id string, source string, text string")
    base = index.build(docs.select("doc_id", "text"))
    out = str(tmp_path / "records")
    dry = enrich.run_enrichment(docs, client, g, base, out, max_terms=2, dry_run=True)
    assert (dry.processed, dry.failed) == (2, 2) and not Path(out).exists()
    first = enrich.run_enrichment(docs, client, g, base, out, max_terms=2, concurrency=2, kinds=["cve"])
    assert (first.total_docs, first.already_done, first.processed, first.failed) == (4, 0, 2, 2)
    assert [d for d, _ in first.failures] == ["D2", "D3"] and first.failures[0][1].startswith("Malformed") and first.failures[1][1].startswith("ModelError")
    got = {r.doc_id: r for r in records.read_records(spark, out).collect()}
    assert [t.term for t in got["D1"].proposed_terms] == ["rare", "T1999"] and got["D1"].proposed_terms[1].reject_reason == "revoked"
    assert got["D1"].llm_calls == 1 and tuple(got["D1"].tokens) == (10, 5)
    calls = spark.read.json(f"{out}.calls")
    assert calls.where("doc_id = 'D3'").count() == 2 and spark.read.json(f"{out}.failures").count() == 2
    assert enrich.read_manifest(spark, f"{out}.manifest")["model"] == "stub"
    second = enrich.run_enrichment(docs, mended, g, base, out)
    assert (second.already_done, second.processed, second.failed) == (2, 2, 0)
    assert records.read_records(spark, out).count() == 4
    with pytest.raises(ValueError):
        enrich.run_enrichment(docs, mended, g, base, out, prompt_version="other", check_prompt=True)


def test_stream_of_documents(spark, g, tmp_path):
    folder, out = str(tmp_path / "docs"), str(tmp_path / "records")
    base = index.build(spark.createDataFrame(DOCS, "doc_id string, source string, text string").select("doc_id", "text"))
    run = lambda batch: enrich.run_enrichment(batch, client, g, base, out)
    spark.createDataFrame(DOCS[:2], incremental.DOCUMENT).write.parquet(folder)
    incremental.stream(spark, folder, str(tmp_path / "cp"), run)
    spark.createDataFrame(DOCS[3:] + DOCS[:1], incremental.DOCUMENT).write.mode("append").parquet(folder)
    incremental.stream(spark, folder, str(tmp_path / "cp"), run)
    assert sorted(r.doc_id for r in records.read_records(spark, out).collect()) == ["D1", "D4"]
    incremental.retry(spark, folder, lambda batch: enrich.run_enrichment(batch, mended, g, base, out))
    assert sorted(r.doc_id for r in records.read_records(spark, out).collect()) == ["D1", "D2", "D4"]


def test_already_in_document(spark):
    rows = [("the remote attacker, T1003.001.", "remote attacker"), ("remote or attacker", "remote attacker"), ("uses T1003.001.", "T1003.001"), (None, "x"), ("x", "...")]
    df = spark.createDataFrame(rows, "text string, term string")
    from vocatlas.functions.text import tokens

    got = df.select(adj.already_in_document(F.col("text"), F.col("term"), tokens(F.col("term")), tokens(F.col("text")))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False]


def test_rounds_keep_their_clients(spark, tmp_path, monkeypatch):
    """Texts beyond a partition's share are asked in rounds, by as many clients as without."""
    docs = spark.range(60).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("doc_id"), F.lit("report").alias("source"), F.lit("x" * 100).alias("text"))
    dealt = []
    ask = enrich.ask
    monkeypatch.setattr(enrich, "ROUND_BYTES", 1_000)
    monkeypatch.setattr(enrich, "ask", lambda d, *a: dealt.append(d.count()) or ask(d, *a))

    def client():
        return StubClient(responder=lambda prompt, system: "[]", fail_times=1, backoff_s=0.0)

    enrich.ask_in_rounds(docs, client, str(tmp_path / "replies"), concurrency=2)
    got = spark.read.schema(enrich.REPLIES).parquet(str(tmp_path / "replies"))
    assert got.select("doc_id").distinct().count() == got.count() == sum(dealt) == 60 and len(dealt) == 3
    assert got.select(F.inline("attempts")).where("not ok").count() == 2 and got.where("reply = '[]'").count() == 60
