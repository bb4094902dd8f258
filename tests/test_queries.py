"""Every query of the library's own operators against its SQL, on the driver's smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from tests.helpers import assert_same, duck
from vocatlas.plans import catalog_queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_against_sql(spark, con, name):
    assert_same(q.QUERIES[name](spark, SF), q.ORACLE_SQL[name], con)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_optional_part_may_be_missing(tmp_path):
    """A copy of the tree without the optional folders still has all other queries."""
    here = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(here, "vocatlas"), tmp_path / "vocatlas", ignore=lambda d, names: ["llm"] if os.path.basename(d) == "vocatlas" else [])
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(here, name)):
            shutil.copy(os.path.join(here, name), tmp_path)
    script = "import __spark_entry__ as e; print(*sorted(e.queries()), sep=',', end=';'); print(*sorted(e.oracle_sql()), sep=',', end='')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert out.split(";") == [",".join(sorted(q.QUERIES)), ",".join(sorted(q.ORACLE_SQL))]


def test_errors_inside_the_optional_part_are_raised(monkeypatch):
    def broken(name):
        raise ImportError("inside")

    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: True)
    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ImportError):
        entry.queries()


def test_stand_in_catalogues_are_files_of_bounded_size(spark, con, monkeypatch):
    monkeypatch.setattr(q, "FILE_ELEMENTS", 7)
    at = q._catalog_files(spark, SF)
    for name in ("attack.json", "cwe.xml", "capec.xml"):
        files = [r.value for r in spark.read.text(f"{at}/{name}", wholetext=True).collect()]
        assert len(files) > 1 and all(sum(f.count(x) for x in ('"type":', "<Weakness ", "<Category ", "<Attack_Pattern ")) <= 8 for f in files)
    for name in ("source_attack_nodes", "source_attack_edges", "source_attack_warnings", "source_xml_nodes", "source_xml_edges"):
        assert_same(q.QUERIES[name](spark, SF), q.ORACLE_SQL[name], con)


def test_postings_are_not_shuffled(spark, con, monkeypatch):
    """Only texts are, to tasks of so many documents."""
    monkeypatch.setattr(q, "DOCS_PER_TASK", 50)
    df = q.index_postings(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == plan.count("REPARTITION_BY_NUM") >= 1
    assert_same(df, q.ORACLE_SQL["index_postings"], con)
