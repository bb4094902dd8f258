"""Corpus enrichment: one model call a document, strict reading, two gates, resumable output.

The stages are frames. Only asking the model runs Python per row, in partitions
as many as may call it at once; its replies are written before anything reads
them, since a recomputed plan would call the model again. Judging and writing
are joins over the written replies.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.functions.replies import PROMPT_VERSION, SYSTEM_PROMPT, build_prompt, parse_reply
from vocatlas.operators.adjudicate import MAX_TERMS, TERM, adjudicate
from vocatlas.operators.graph import Graph
from vocatlas.operators.index import DF_MAX_RATIO, Index, total_docs
from vocatlas.plans.model import Client, ModelError
from vocatlas.session import scratch_path
from vocatlas.sources import records

ATTEMPT = "struct<model:string,prompt:bigint,completion:bigint,latency_ms:bigint,ok:boolean,tag:string,error:string,started_at:double>"
REPLIES = f"doc_id string, source string, text string, reply string, error string, model string, attempts array<{ATTEMPT}>"
TAG = "corpus_enrich"
#: Bytes of texts of a partition that asks the model, about.
ROUND_BYTES = 256 << 20


@dataclass
class RunSummary:
    total_docs: int = 0
    already_done: int = 0
    processed: int = 0
    failed: int = 0
    elapsed_s: float = 0.0
    failures: list[tuple[str, str]] = field(default_factory=list)


def pending(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without a record. A failed document has none, so it is tried again."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def ask(
    docs: DataFrame, client_factory: Callable[[], Client], max_terms: int = MAX_TERMS, concurrency: int = 1, clients: dict[int, bytes] | None = None,
) -> DataFrame:
    """``REPLIES`` of (doc_id, source, text): one client a partition, ``concurrency`` partitions.

    With ``clients``, pickled ones of an earlier round by partition, each goes on
    where it is, and a row a partition has ``lane``, and ``client`` as it is then.
    """
    dealt = docs.select("doc_id", "source", "text").repartition(max(1, concurrency))
    # A text and its prompt are nearly the same, so only the text is dealt.
    prompts = dealt.withColumn("prompt", build_prompt(F.col("source"), F.col("doc_id").cast("string"), F.col("text"), max_terms))
    names = ["doc_id", "source", "text", "reply", "error", "model", "attempts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane = TaskContext.get().partitionId()
        client = cloudpickle.loads(clients[lane]) if clients and lane in clients else client_factory()
        for b in batches:
            out = []
            for doc_id, source, text, prompt in b.itertuples(index=False):
                try:
                    reply, attempts = client.generate(prompt, SYSTEM_PROMPT, TAG)
                    error = None
                except ModelError as e:
                    reply, attempts, error = None, e.attempts, f"ModelError: {e}"
                out.append((doc_id, source, text, reply, error, client.model, [a.to_dict() for a in attempts]))
            made = pd.DataFrame(out, columns=names)
            yield made if clients is None else made.assign(lane=None, client=None)
        if clients is not None:
            yield pd.DataFrame([(*[None] * len(names), lane, _pickled(client))], columns=[*names, "lane", "client"])

    return prompts.mapInPandas(run, REPLIES if clients is None else f"{REPLIES}, lane int, client binary")


def _pickled(client: Client) -> bytes | None:
    """None for a client that can't be moved, such as one with an open connection: the next round makes a new one."""
    try:
        return cloudpickle.dumps(client)
    except Exception:  # noqa: BLE001  whatever a backend's parts raise
        return None


def ask_in_rounds(docs: DataFrame, client_factory: Callable[[], Client], batch: str, max_terms: int = MAX_TERMS, concurrency: int = 1) -> None:
    """``ask`` about ``docs`` and write the replies to ``batch``, in as many rounds as keep a partition's texts
    below some ``ROUND_BYTES``: no more than ``concurrency`` partitions may call the model at once."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "pending")
    docs.select("doc_id", "source", "text").write.parquet(path)
    waiting = spark.read.schema(docs.select("doc_id", "source", "text").schema).parquet(path)
    size = waiting.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    rounds = max(1, -(-size // (max(1, concurrency) * ROUND_BYTES)))
    if rounds == 1:
        return ask(waiting, client_factory, max_terms, concurrency).write.parquet(batch)
    clients: dict[int, bytes] = {}
    for i in range(rounds):
        part = waiting.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i)
        at = scratch_path(spark, "round")
        ask(part, client_factory, max_terms, concurrency, clients).write.parquet(at)
        made = spark.read.schema(f"{REPLIES}, lane int, client binary").parquet(at)
        made.where("lane is null").drop("lane", "client").write.mode("append").parquet(batch)
        clients = {r.lane: bytes(r.client) for r in made.where("client is not null").select("lane", "client").collect()}


def judge(
    replies: DataFrame, graph: Graph, index: Index, max_terms: int = MAX_TERMS, ratio: float = DF_MAX_RATIO, allow_deprecated: bool = False, revoked_policy: str = "reject",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, failures (doc_id, error, ts) and calls, from written replies.

    The shape of a whole reply is checked, then its first ``max_terms`` count.
    """
    parsed = replies.withColumn("p", parse_reply(F.col("reply")))
    ok = parsed.where("error is null and p.status = 'ok'")
    failed = parsed.where("error is not null or p.status != 'ok'").select(
        "doc_id", F.coalesce("error", F.concat(F.lit("MalformedReplyError: "), "doc_id", F.lit(": "), "p.error")).alias("error"), F.unix_timestamp().cast("double").alias("ts")
    )
    proposals = ok.select("doc_id", F.posexplode(F.slice("p.proposals", 1, max_terms)).alias("ord", "x")).select("doc_id", "ord", "x.term", "x.kind")
    judged = adjudicate(proposals, graph, index.term_stats, total_docs(index), ratio, allow_deprecated, revoked_policy, index.analyzer)
    packed = judged.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]).alias("proposed_terms"))
    total = lambda f: F.aggregate("attempts", F.lit(0).cast("long"), lambda s, a: s + a[f])
    out = ok.join(packed, "doc_id", "left").select(
        "doc_id", "source", F.col("text").alias("original_text"), F.coalesce("proposed_terms", F.array().cast(f"array<{TERM}>")).alias("proposed_terms"),
        F.size("attempts").cast("long").alias("llm_calls"), F.struct(total("prompt").alias("prompt"), total("completion").alias("completion")).alias("tokens"),
        total("latency_ms").alias("latency_ms"), "model", F.lit(records.SCHEMA_VERSION).alias("schema_version"),
    )
    calls = replies.select("doc_id", F.inline("attempts"))
    return out, failed, calls


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_manifest(spark: SparkSession, path: str, **values) -> None:
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    return json.loads(spark.read.text(path, wholetext=True).first().value) if _exists(spark, path) else None


def run_enrichment(
    docs: DataFrame, client_factory: Callable[[], Client], graph: Graph, index: Index, output: str, max_terms: int = MAX_TERMS, ratio: float = DF_MAX_RATIO,
    allow_deprecated: bool = False, revoked_policy: str = "reject", concurrency: int = 1, prompt_version: str = PROMPT_VERSION, config_hash: str | None = None,
    kinds: Iterable[str] = (), dry_run: bool = False, on_batch: Callable[[DataFrame], None] | None = None, check_prompt: bool = False,
) -> RunSummary:
    """Enrich the documents that ``output`` has no record of.

    ``output`` holds records; beside it, ``.replies`` the written replies,
    ``.failures``, ``.calls`` and ``.manifest``. ``dry_run`` asks and judges and
    leaves ``output`` alone. With ``check_prompt`` a run refuses to add to records
    made with another prompt.
    """
    spark = docs.sparkSession
    began = time.perf_counter()
    earlier = read_manifest(spark, f"{output}.manifest")
    if check_prompt and earlier and earlier.get("prompt_version") != prompt_version:
        raise ValueError(f"{output} was made with prompt {earlier.get('prompt_version')}, not {prompt_version}")
    done = records.read_records(spark, output).select("doc_id") if _exists(spark, output) else spark.createDataFrame([], "doc_id string")
    summary = RunSummary(total_docs=docs.count(), already_done=done.distinct().count())
    batch = f"{output}.replies/run={int(time.time() * 1000)}"
    ask_in_rounds(pending(docs, done), client_factory, batch, max_terms, concurrency)
    replies = spark.read.schema(REPLIES).parquet(batch)
    good, failed, calls = judge(replies, graph, index, max_terms, ratio, allow_deprecated, revoked_policy)
    good = good.persist()
    summary.processed = good.count()
    summary.failures = [(r.doc_id, r.error) for r in failed.orderBy("doc_id").collect()]
    summary.failed = len(summary.failures)
    if not dry_run:
        if summary.processed:
            records.write_records(good, output, append=True)
            model = replies.select("model").first()
            write_manifest(spark, f"{output}.manifest", prompt_version=prompt_version, model=model.model, config_hash=config_hash, kinds=list(kinds), created_at=time.time())
        if summary.failed:
            failed.write.mode("append").json(f"{output}.failures")
        calls.write.mode("append").json(f"{output}.calls")
    if on_batch is not None:
        on_batch(good)
    good.unpersist()
    summary.elapsed_s = time.perf_counter() - began
    return summary
