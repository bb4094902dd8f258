"""Adjudicating proposed terms: kind routing, the graph's gate, the frequency gate.

Every proposal is kept as a term (``TERM``), accepted or rejected with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatlas.functions.ids import is_id_shaped, looks_structural
from vocatlas.functions.replies import KINDS
from vocatlas.operators.graph import Graph
from vocatlas.operators.index import DF_MAX_RATIO, term_df, too_common
from vocatlas.operators.skew import left_join
from vocatlas.operators.validate import validate
from vocatlas.session import cut

MAX_TERMS = 12
TERM = "struct<term:string,kind:string,structural_id:string,graph_validated:boolean,doc_freq:bigint,accepted:boolean,reject_reason:string,repaired_from_id:string>"
TERM_FIELDS = ("term", "kind", "structural_id", "graph_validated", "doc_freq", "accepted", "reject_reason", "repaired_from_id")
# Why a term is rejected; the first four are the graph's.
GRAPH_REASONS = ("not_in_graph", "deprecated", "revoked", "malformed_id")
REASONS = (*GRAPH_REASONS, "too_common", "not_in_index")


def route_kind(kind: Column, term: Column) -> Column:
    """``kind``, except that a structural term that attempts no identifier is colloquial."""
    attempt = looks_structural(term) | is_id_shaped(term)
    return F.when((kind == "structural") & ~attempt, "colloquial").otherwise(kind)


def _term(**c: Column) -> Column:
    kinds = {"graph_validated": "boolean", "accepted": "boolean", "doc_freq": "bigint"}
    return F.struct(*(c.get(f, F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in TERM_FIELDS))


def accept(term: Column, kind: Column, structural_id: Column | None = None, doc_freq: Column | None = None) -> Column:
    none = F.lit(None)
    checked = F.when(kind == "structural", F.lit(True))
    return _term(term=term, kind=kind, structural_id=none if structural_id is None else structural_id, graph_validated=checked, doc_freq=none if doc_freq is None else doc_freq, accepted=F.lit(True))


def repair(term: Column, structural_id: Column, repaired_from_id: Column, doc_freq: Column | None = None) -> Column:
    return _term(
        term=term, kind=F.lit("structural"), structural_id=structural_id, graph_validated=F.lit(True), doc_freq=F.lit(None) if doc_freq is None else doc_freq,
        accepted=F.lit(True), repaired_from_id=repaired_from_id,
    )


def reject(term: Column, kind: Column, reason: Column, structural_id: Column | None = None, doc_freq: Column | None = None) -> Column:
    """A structural term has failed the graph for the graph's reasons only, and is its own id if it has none."""
    is_id = kind == "structural"
    given = F.lit(None).cast("string") if structural_id is None else structural_id
    return _term(
        term=term, kind=kind, structural_id=F.when(is_id, F.coalesce(given, term)).otherwise(given), graph_validated=F.when(is_id, ~reason.isin(*GRAPH_REASONS)),
        doc_freq=F.lit(None) if doc_freq is None else doc_freq, accepted=F.lit(False), reject_reason=reason,
    )


def indexable_text(t: Column) -> Column:
    """What a term would bring into the index."""
    return F.when(t["kind"] == "structural", t["structural_id"]).otherwise(t["term"])


def df_combine(t: Column) -> Column:
    """An identifier is as common as its rarest token, other terms as their commonest."""
    return F.when(t["kind"] == "structural", "min").otherwise("max")


def graph_gate(proposals: DataFrame, graph: Graph, allow_deprecated: bool = False, revoked_policy: str = "reject") -> DataFrame:
    """``proposals`` (term, kind and any others) with ``t``, the term after routing and the graph's judgement."""
    routed = proposals.withColumn("kind", route_kind(F.col("kind"), F.col("term")))
    judged = validate(graph, routed, "term", allow_deprecated, revoked_policy)
    term, kind = F.col("term"), F.col("kind")
    t = (
        F.when(kind != "structural", accept(term, kind))
        .when(F.col("repaired"), repair(term, F.col("canonical_id"), F.coalesce("original_id", "term")))
        .when(F.col("valid"), accept(term, kind, F.col("canonical_id")))
        .otherwise(reject(term, kind, F.col("reject_reason"), F.coalesce("canonical_id", "term")))
    )
    return judged.select(*(c for c in routed.columns if c not in ("term", "kind")), t.alias("t"))


def frequency_gate(terms: DataFrame, term_stats: DataFrame, total_docs: int, ratio: float = DF_MAX_RATIO, analyzer: str = "simple") -> DataFrame:
    """``terms`` (``t`` and any others) where accepted terms carry their document
    frequency and the too common ones are rejected. Rejected terms are not looked up."""
    t = F.col("t")
    asked = terms.withColumn("__text", F.when(t["accepted"], indexable_text(t))).withColumn("__rule", df_combine(t))
    known = term_df(asked, term_stats, analyzer, col="__text", combine="__rule")
    df = F.col("doc_freq")
    common = too_common(df, F.lit(total_docs), ratio)
    out = (
        F.when(~t["accepted"], t)
        .when(common, reject(t["term"], t["kind"], F.lit("too_common"), t["structural_id"], df))
        .when(t["repaired_from_id"].isNotNull(), repair(t["term"], t["structural_id"], t["repaired_from_id"], df))
        .otherwise(accept(t["term"], t["kind"], t["structural_id"], df))
    )
    return known.select(*(c for c in terms.columns if c != "t"), out.alias("t"))


def adjudicate(
    proposals: DataFrame, graph: Graph, term_stats: DataFrame, total_docs: int, ratio: float = DF_MAX_RATIO, allow_deprecated: bool = False,
    revoked_policy: str = "reject", analyzer: str = "simple",
) -> DataFrame:
    """Both gates over (term, kind and any others): one row a proposal, as ``t``.

    Each distinct proposal is judged once, and its judgement joined with its rows, of which some have very many.
    """
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"__{c}")
    keys = ["__term", "__kind"]
    counted = cut(proposals.groupBy("term", "kind").agg(F.count("*").alias("__n")).select("*", *map(known, ("term", "kind"))))
    gated = cut(graph_gate(counted.select("term", "kind", *keys), graph, allow_deprecated, revoked_policy))
    judged = frequency_gate(gated, term_stats, total_docs, ratio, analyzer)
    rest = [c for c in proposals.columns if c not in ("term", "kind")]
    return left_join(proposals.select(*rest, *map(known, ("term", "kind"))), judged, keys, counted.select(*keys, "__n")).select(*rest, "t")


def index_gate(terms: DataFrame, term_stats: DataFrame, analyzer: str = "simple", field: str = "contents") -> DataFrame:
    """Extension for queries: accepted terms of which no token is in the index are rejected as not_in_index."""
    t = F.col("t")
    asked = terms.withColumn("__text", F.when(t["accepted"], indexable_text(t))).withColumn("__rule", F.lit("max"))
    known = term_df(asked, term_stats, analyzer, field, "__text", "__rule")
    out = F.when(t["accepted"] & (F.col("doc_freq") == 0), reject(t["term"], t["kind"], F.lit("not_in_index"), t["structural_id"], F.col("doc_freq"))).otherwise(t)
    return known.select(*(c for c in terms.columns if c != "t"), out.alias("t"))


def violations(t: Column) -> Column:
    """Names of the rules that a term breaks, as an array."""
    is_id = t["kind"] == "structural"
    rules = {
        "term is blank": F.coalesce(F.trim(t["term"]) == "", F.lit(True)),
        "kind is unknown": ~F.coalesce(t["kind"].isin(*KINDS), F.lit(False)),
        "reason is unknown": F.coalesce(~t["reject_reason"].isin(*REASONS), F.lit(False)),
        "structural without id or verdict": is_id & (t["structural_id"].isNull() | t["graph_validated"].isNull()),
        "id or verdict without structural": ~is_id & (t["structural_id"].isNotNull() | t["graph_validated"].isNotNull()),
        "accepted with a reason or rejected without": F.coalesce(t["accepted"], F.lit(False)) != t["reject_reason"].isNull(),
        "repaired but not an accepted id": t["repaired_from_id"].isNotNull() & ~(is_id & F.coalesce(t["accepted"], F.lit(False))),
        "repaired to itself": F.coalesce(t["repaired_from_id"] == t["structural_id"], F.lit(False)),
        "negative frequency": F.coalesce(t["doc_freq"] < 0, F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def is_valid_term(t: Column) -> Column:
    return F.size(violations(t)) == 0


def already_in_document(text: Column, term: Column, term_tokens: Column, text_tokens: Column) -> Column:
    """Extension: whether a term's tokens stand together in the text, or it is
    an identifier that the text without marks spells out."""
    mark = F.lit("\x1f")
    run = lambda c: F.concat(mark, F.array_join(c, "\x1f"), mark)
    spelled = F.contains(F.concat(F.lit(" "), F.regexp_replace(text, r"[.,;:()\[\]\"']+(?=\s|$)", ""), F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))
    return F.coalesce((F.size(term_tokens) > 0) & F.contains(run(text_tokens), run(term_tokens)), F.lit(False)) | F.coalesce(looks_structural(term) & spelled, F.lit(False))
