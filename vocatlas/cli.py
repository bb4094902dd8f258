"""Command line: build and check the graph, build the indexes, enrich the corpus.

    python -m vocatlas.cli graph --config c.yaml [--stats-out stats.json]
    python -m vocatlas.cli index --config c.yaml --stage base|enriched [--limit N] [--dry-run]
    python -m vocatlas.cli enrich --config c.yaml [--output P] [--limit N] [--concurrency N] [--dry-run]

The stages run in this order: base index, enrichment, enriched index.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vocatlas.functions.replies import PROMPT_VERSION
from vocatlas.operators import graph as graphs
from vocatlas.operators import index as indexes
from vocatlas.operators import metrics, validate
from vocatlas.plans import enrich as enriching
from vocatlas.plans.config import file_hash, load_config
from vocatlas.plans.enrich import _exists
from vocatlas.plans.model import Client, OllamaClient
from vocatlas.sources import corpus, records

# Identifiers that every release should treat alike, and whether each is valid.
SPOT_CHECKS = (("T1110", True), ("t1110/001", True), ("CWE-307", True), ("CAPEC-49", True), ("T9999", False), ("T1110.099", False), ("T99", False), ("brute force login", False))
SPINE = ("CWE-307", "CAPEC-49")


def _paths(value) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def _missing(spark: SparkSession, cfg: dict) -> list[str]:
    return [p for p in (*_paths(cfg.get("attack_path")), *_paths(cfg.get("cwe_path")), *_paths(cfg.get("capec_path"))) if not _exists(spark, p)]


def _graph(spark: SparkSession, cfg: dict) -> graphs.Graph:
    return graphs.from_files(spark, _paths(cfg.get("attack_path")), cfg.get("cwe_path"), cfg.get("capec_path"), cfg.get("domains"))


def build_graph(spark: SparkSession, cfg: dict, stats_out: str | None = None, say=print) -> int:
    """Statistics, spot checks and cross-catalogue mappings; 1 if a source is missing or a check fails."""
    cfg = cfg["graph"]
    if missing := _missing(spark, cfg):
        say("missing sources: " + ", ".join(missing))
        return 1
    g = _graph(spark, cfg)
    stats: dict = {}
    for r in graphs.stats(g).orderBy("measure", "value").collect():
        stats.setdefault(r.measure, {})[r.value] = r.n
    say(json.dumps(stats, indent=2))
    for r in g.warnings.orderBy("load_seq").limit(10).collect():
        say(f"warning: {r.warning}")
    terms = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(SPOT_CHECKS)], "ord int, term string, expected boolean")
    failures = 0
    for r in validate.validate(g, terms).orderBy("ord").collect():
        failures += r.valid != r.expected
        say(f"{'ok  ' if r.valid == r.expected else 'FAIL'} {r.term}: {r.reject_reason or 'valid'}")
    spine = graphs.mapped(g).where(F.col("node_id").isin(*SPINE)).groupBy("node_id").agg(F.sort_array(F.collect_list("other")).alias("to"))
    for r in spine.orderBy("node_id").collect():
        say(f"{r.node_id} -> {', '.join(r.to)}")
    if stats_out:
        with open(stats_out, "w", encoding="utf-8") as f:
            json.dump(stats, f, indent=2)
    return 1 if failures else 0


def build_index(spark: SparkSession, cfg: dict, stage: str, limit: int | None = None, dry_run: bool = False, config_hash: str | None = None, say=print) -> int:
    kb, idx = cfg["corpus"], cfg["index"]
    docs = corpus.load_corpus(spark, kb["kb_dir"], kb["kinds"], limit)
    say(f"{docs.count()} documents")
    manifest = {"kind": stage, "kb_dir": kb["kb_dir"], "kinds": list(kb["kinds"]), "config_hash": config_hash, "created_at": time.time()}
    if stage == "base":
        if not dry_run:
            indexes.save(indexes.build(docs, "english"), idx["base_dir"], manifest)
        return 0
    if not _exists(spark, idx["enrichment_path"]):
        say(f"no enrichment at {idx['enrichment_path']}: run enrich first")
        return 1
    made = enriching.read_manifest(spark, f"{idx['enrichment_path']}.manifest") or {}
    manifest |= {"enrichment_path": idx["enrichment_path"], "enrichment_prompt_version": made.get("prompt_version"), "enrichment_model": made.get("model")}
    extra = records.expansions(records.read_records(spark, idx["enrichment_path"]))
    if not dry_run:
        indexes.save(indexes.build_enriched(docs, extra, "english"), idx["enriched_dir"], manifest)
    return 0


def _client_factory(cfg: dict):
    def make() -> Client:
        return OllamaClient(model=cfg["model"], host=cfg.get("host", "http://localhost:11434"), temperature=cfg.get("temperature", 0.0), max_retries=cfg.get("max_retries", 2))

    return make


def enrich(
    spark: SparkSession, cfg: dict, output: str | None = None, limit: int | None = None, concurrency: int | None = None, dry_run: bool = False, config_hash: str | None = None,
    client_factory=None, say=print,
) -> int:
    output, e, g = output or cfg["index"]["enrichment_path"], cfg["enrichment"], cfg["graph"]
    if not _exists(spark, f"{cfg['index']['base_dir']}/manifest"):
        say(f"no base index at {cfg['index']['base_dir']}: build it first")
        return 1
    if missing := _missing(spark, g):
        say("missing sources: " + ", ".join(missing))
        return 1
    if client_factory is None:
        if cfg["llm"]["backend"] != "ollama":
            say(f"backend {cfg['llm']['backend']!r} is not supported")
            return 1
        client_factory = _client_factory(cfg["llm"])
    docs = corpus.load_corpus(spark, cfg["corpus"]["kb_dir"], cfg["corpus"]["kinds"], limit)
    summary = enriching.run_enrichment(
        docs, client_factory, _graph(spark, g), indexes.load(spark, cfg["index"]["base_dir"]), output, e["max_terms_per_doc"], e["df_max_ratio"], g.get("allow_deprecated", False),
        g.get("revoked_policy", "reject"), e.get("concurrency", 1) if concurrency is None else concurrency, PROMPT_VERSION, config_hash, cfg["corpus"]["kinds"], dry_run,
    )
    say(f"{summary.total_docs} documents, {summary.already_done} done before, {summary.processed} processed, {summary.failed} failed, {summary.elapsed_s:.1f} s")
    for doc_id, error in summary.failures[:10]:
        say(f"{doc_id}: {error}")
    if not dry_run and _exists(spark, output):
        terms = metrics.exploded(records.read_records(spark, output))
        say(json.dumps(metrics.summarize(terms).first().asDict()))
        for r in metrics.rejected_by_reason(terms).orderBy("reject_reason").collect():
            say(f"{r.reject_reason}: {r.n}")
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("graph", "index", "enrich"):
        p = sub.add_parser(name)
        p.add_argument("--config", required=True)
        if name == "graph":
            p.add_argument("--stats-out")
        else:
            p.add_argument("--limit", type=int)
            p.add_argument("--dry-run", action="store_true")
        if name == "index":
            p.add_argument("--stage", choices=("base", "enriched"), required=True)
        if name == "enrich":
            p.add_argument("--output")
            p.add_argument("--concurrency", type=int)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("vocatlas").getOrCreate()
    cfg = load_config(a.config)
    if a.command == "graph":
        return build_graph(spark, cfg, a.stats_out)
    hashed = file_hash(spark, a.config)
    if a.command == "index":
        return build_index(spark, cfg, a.stage, a.limit, a.dry_run, hashed)
    return enrich(spark, cfg, a.output, a.limit, a.concurrency, a.dry_run, hashed)


if __name__ == "__main__":
    sys.exit(main())
