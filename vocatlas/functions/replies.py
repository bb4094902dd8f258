"""Prompts for vocabulary proposals, and strict reading of the replies.

No built-in JSON function is strict enough (they coerce numbers to strings,
allow trailing text, or null a whole array), so replies go through Python's
parser in one Arrow function.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of proposed terms.
KINDS = ("colloquial", "symptom", "product", "misspelling", "structural")
_STRING = T.StringType()
PROPOSALS = T.ArrayType(T.StructType([T.StructField("term", _STRING), T.StructField("kind", _STRING)]))
REPLY = T.StructType([T.StructField("status", _STRING), T.StructField("error", _STRING), T.StructField("proposals", PROPOSALS)])

PROMPT_VERSION = "vocabulary-1"
SYSTEM_PROMPT = """You extend the vocabulary of a security search index. For the document you are given, name terms that an analyst may search for and that the document itself does not contain. Each term has one kind:
- colloquial: an informal name
- symptom: what a victim or analyst observes
- product: a product or component that is affected
- misspelling: a common misspelling
- structural: a catalogue identifier, such as a weakness or technique number
Answer with a JSON array of objects {"term": ..., "kind": ...} and nothing else. An empty array is a valid answer. Do not guess identifiers that you are unsure of."""


def build_prompt(source: Column, doc_id: Column, text: Column, max_terms: int) -> Column:
    """The user message for a document."""
    return F.concat(F.lit("Document "), doc_id, F.lit(" from "), source, F.lit(":\n\n"), F.coalesce(text, F.lit("")), F.lit(f"\n\nName at most {max_terms} terms."))


def parse_json_loose(raw: str):
    """The JSON value in a reply: the reply itself, its first fenced block if it
    begins with a fence, else the widest bracketed span, by where spans begin.
    Raises ValueError if there is none."""
    text = raw.strip()
    if text.startswith("```"):
        inner = text[3:]
        text = inner.partition("```")[0].lstrip()
        text = text[4:] if text[:4].lower() == "json" else text
        text = text.strip()
    attempts = [text]
    spans = sorted((text.find(o), text.rfind(c)) for o, c in ("[]", "{}") if o in text and text.rfind(c) > text.find(o))
    attempts += [text[a : b + 1] for a, b in spans]
    for attempt in attempts:
        try:
            return json.loads(attempt)
        except json.JSONDecodeError:
            continue
    raise ValueError(f"no JSON in the reply: {raw[:200]!r}")


def read_proposals(raw: str | None) -> tuple[str, str | None, list[tuple[str, str]]]:
    """('ok', None, [(term, kind)]) or ('malformed', why, []): one bad item spoils the reply."""
    try:
        value = parse_json_loose(raw or "")
    except (ValueError, RecursionError) as e:
        return "malformed", str(e), []
    if not isinstance(value, list):
        return "malformed", f"not an array but {type(value).__name__}", []
    out = []
    for i, item in enumerate(value):
        term, kind = (item.get("term"), item.get("kind")) if isinstance(item, dict) else (None, None)
        if not isinstance(item, dict):
            return "malformed", f"item {i} is not an object", []
        if not isinstance(term, str) or not term.strip():
            return "malformed", f"item {i} has no term", []
        if not isinstance(kind, str) or kind not in KINDS:
            return "malformed", f"item {i} has an unknown kind", []
        out.append((term.strip(), kind))
    return "ok", None, out


@F.pandas_udf(REPLY)
def parse_reply(raw: pd.Series) -> pd.DataFrame:
    """Status, error and proposals of each reply; null and empty replies are malformed."""
    got = [read_proposals(r) for r in raw]
    return pd.DataFrame(
        {"status": [s for s, _, _ in got], "error": [e for _, e, _ in got], "proposals": [[{"term": t, "kind": k} for t, k in p] for _, _, p in got]}
    )
