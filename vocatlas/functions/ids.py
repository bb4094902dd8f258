"""Identifiers of attack techniques, weaknesses and attack patterns, as Column expressions.

Digits are ASCII digits only, as Spark cannot cast others. White space is any
Unicode white space. Null and unparseable texts give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that are recognised.
CWE = r"(?i)^CWE[\s\-_:]*([0-9]{1,4})$"
CAPEC = r"(?i)^CAPEC[\s\-_:]*([0-9]{1,4})$"
PLAIN = r"^(?:TA|DS|T|M|G|C|S)[0-9]{4}$"
SUB = r"^T([0-9]{4})[.\-/]([0-9]{1,3})$"
PREFIX = (
    r"(?i)^(?:mitre\s*)?(?:att&ck|attack|att\s*&\s*ck)?[\s:\-]*"
    r"(?:technique|sub[\s\-]?technique|tactic|mitigation|group|software|weakness|attack[\s\-]pattern|pattern|id)?[\s:\-]*"
)
EMBEDDED = r"(?i)\b(?:TA[0-9]{4}|DS[0-9]{4}|T[0-9]{4}(?:[.\-/][0-9]{1,3})?|M[0-9]{4}|G[0-9]{4}|S[0-9]{4}|CWE[\s\-_:]*[0-9]{1,4}|CAPEC[\s\-_:]*[0-9]{1,4})\b"
SHAPED = r"(?i)^(?:mitre|att&ck|att\s*&\s*ck)\b|^(?:cwe|capec|cve)\b|^(?:TA|DS|T|M|G|S|C)[\-_:]?[0-9]"
MARKS = r"""[.,;:()\[\]"']+"""
#: Node types by the letters of an identifier.
TYPES = (
    ("CWE-", "cwe", "weakness"),
    ("CAPEC-", "capec", "attack_pattern"),
    ("TA", "attack", "tactic"),
    ("DS", "attack", "data_source"),
    ("T", "attack", "technique"),
    ("M", "attack", "mitigation"),
    ("G", "attack", "group"),
    ("C", "attack", "campaign"),
    ("S", "attack", "software"),
)

PARSED = "struct<canonical:string,namespace:string,node_type:string,parent_id:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _bare(text: Column) -> Column:
    """Without white space, then without marks, at both ends."""
    return F.regexp_replace(strip(text), f"^{MARKS}|{MARKS}$", "")


def _without_prefix(raw: Column) -> Column:
    return F.regexp_replace(raw, PREFIX, "")


def _number(text: Column, pattern: str, prefix: str) -> Column:
    digits = F.regexp_extract(text, pattern, 1)
    return F.when(digits != "", F.concat(F.lit(prefix), digits.try_cast("int").cast("string")))


def _canonical(candidate: Column) -> Column:
    """The canonical spelling of an exact identifier, or null."""

    def technique(upper: Column) -> Column:
        sub = F.regexp_extract(upper, SUB, 2)
        return F.when(upper.rlike(PLAIN), upper).when(sub != "", F.concat(F.lit("T"), F.regexp_extract(upper, SUB, 1), F.lit("."), F.lpad(sub, 3, "0")))

    spaceless = F.upper(F.replace(candidate, F.lit(" "), F.lit("")))
    return F.coalesce(_number(candidate, CWE, "CWE-"), _number(candidate, CAPEC, "CAPEC-"), _let(spaceless, technique))


def canonical_id(text: Column) -> Column:
    """The canonical identifier that a text is, prose prefixes and marks aside."""
    return _let(_bare(text), lambda raw: F.coalesce(_let(_bare(_without_prefix(raw)), _canonical), _canonical(raw)))


def parent_of(canonical: Column) -> Column:
    """The parent that a subtechnique's spelling names."""
    return F.when(canonical.rlike(r"^T[0-9]{4}\."), F.substring_index(canonical, ".", 1))


def node_type_of(canonical: Column) -> Column:
    out = F.when(canonical.rlike(r"^T[0-9]{4}\."), F.lit("subtechnique"))
    for prefix, _, kind in TYPES:
        out = out.when(canonical.startswith(prefix), kind)
    return out


def namespace_of(canonical: Column) -> Column:
    out = F.when(canonical.startswith("CWE-"), F.lit("cwe")).when(canonical.startswith("CAPEC-"), "capec")
    return out.when(canonical.isNotNull(), "attack")


def _described(c: Column) -> Column:
    return F.when(c.isNotNull(), F.struct(c.alias("canonical"), namespace_of(c).alias("namespace"), node_type_of(c).alias("node_type"), parent_of(c).alias("parent_id")))


def parse_id(text: Column) -> Column:
    """The parsed identifier (``PARSED``), or null."""
    return _let(canonical_id(text), _described)


def looks_structural(text: Column) -> Column:
    return F.coalesce(canonical_id(text).isNotNull(), F.lit(False))


def extract_ids(text: Column) -> Column:
    """Canonical identifiers found in prose, each once, in order of first mention."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMBEDDED), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, canonical_id)))


def extract_parsed(text: Column) -> Column:
    """``extract_ids`` with each identifier parsed."""
    return F.transform(extract_ids(text), _described)


def is_id_shaped(text: Column) -> Column:
    """Whether a text attempts an identifier, well-formed or not."""
    shaped = _let(_bare(text), lambda raw: (raw != "") & (raw.rlike(SHAPED) | strip(_without_prefix(raw)).rlike(SHAPED)))
    return F.coalesce(shaped, F.lit(False))


def document_id(kind: Column | str, raw: Column) -> Column:
    """A knowledge-base row's document id: prefixed as its kind asks, never re-cased."""
    k = F.lit(kind) if isinstance(kind, str) else kind
    up = F.upper(raw)
    return (
        F.when(k == "cve", F.when(up.startswith("CVE-"), raw).otherwise(F.concat(F.lit("CVE-"), raw)))
        .when(k == "mitre", F.when(up.startswith("T"), raw).otherwise(F.concat(F.lit("T"), raw)))
        .when(k == "cwe", F.when(up.startswith("CWE-"), raw).otherwise(F.concat(F.lit("CWE-"), raw)))
        .when(k == "capec", F.when(up.startswith("CAPEC-"), raw).otherwise(F.concat(F.lit("CAPEC-"), raw)))
    )


def status_of(attribute: Column) -> Column:
    """A catalogue's status attribute as active or deprecated."""
    return F.when(F.lower(strip(attribute)).isin("deprecated", "obsolete"), "deprecated").otherwise("active")
