"""The command line, from sources to the enriched index."""

import json
from pathlib import Path

import pytest

from vocatlas import cli
from vocatlas.operators import bm25, index
from vocatlas.plans.model import StubClient

HERE = Path(__file__).parent / "fixtures"


@pytest.fixture()
def config(tmp_path):
    cfg = {
        "graph": {"attack_path": [str(HERE / "attack.json")], "cwe_path": str(HERE / "cwe.xml"), "capec_path": str(HERE / "capec.xml")},
        "corpus": {"kb_dir": str(HERE / "kb"), "kinds": ["cve", "cwe", "capec", "mitre"]},
        "index": {"base_dir": str(tmp_path / "base"), "enriched_dir": str(tmp_path / "rich"), "enrichment_path": str(tmp_path / "records")},
        "enrichment": {"max_terms_per_doc": 3, "df_max_ratio": 0.5, "concurrency": 2},
        "llm": {"backend": "other", "model": "m"},
    }
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps(cfg))
    return str(path), cfg


def test_stages_in_order(spark, config, monkeypatch):
    path, cfg = config
    assert cli.main(["enrich", "--config", path], spark) == 1  # no base index yet
    assert cli.main(["index", "--config", path, "--stage", "enriched"], spark) == 1  # no enrichment yet
    assert cli.main(["index", "--config", path, "--stage", "base", "--dry-run"], spark) == 0 and not Path(cfg["index"]["base_dir"]).exists()
    assert cli.main(["index", "--config", path, "--stage", "base"], spark) == 0
    assert cli.main(["enrich", "--config", path], spark) == 1  # unsupported backend
    said = []
    make = lambda: StubClient(responder=lambda p, s: '[{"term": "zanzibar", "kind": "symptom"}]')
    assert cli.enrich(spark, cfg, limit=2, client_factory=make, say=said.append) == 0
    assert said[0].startswith("2 documents, 0 done before, 2 processed, 0 failed") and json.loads(said[1])["accepted"] == 2
    assert cli.main(["index", "--config", path, "--stage", "enriched"], spark) == 0
    rich = index.load(spark, cfg["index"]["enriched_dir"])
    q = spark.createDataFrame([("q", "zanzibar")], "query_id string, text string")
    assert {r.doc_id for r in bm25.search(rich, q, field="expansion").collect()} == {"CVE-2030-1", "CVE-2030-2"} and bm25.search(rich, q).isEmpty()


def test_graph_command(spark, config, tmp_path, capsys, monkeypatch):
    path, cfg = config
    out = str(tmp_path / "stats.json")
    assert cli.main(["graph", "--config", path, "--stats-out", out], spark) == 1  # the fixtures lack the well-known identifiers
    assert json.loads(Path(out).read_text())["dangling"] == {"all": 1} and "FAIL T1110" in capsys.readouterr().out
    monkeypatch.setattr(cli, "SPOT_CHECKS", (("t2000/1", True), ("T9999", False)))
    monkeypatch.setattr(cli, "SPINE", ("CAPEC-5",))
    assert cli.main(["graph", "--config", path], spark) == 0 and "CAPEC-5 -> CWE-20, T2000.001" in capsys.readouterr().out
    cfg["graph"]["cwe_path"] = str(tmp_path / "gone.xml")
    assert cli.build_graph(spark, cfg, say=lambda x: None) == 1
