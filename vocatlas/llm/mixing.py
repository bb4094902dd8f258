"""Mixing sources to target weights, in DataFrame functions only.

Documents fall into cells of source, language and topic. Iterative
proportional fitting rakes the cells' token weights: in turn, each marginal's
weights are scaled to its target, ``ROUNDS`` times. Rounds are repeated by as
many until no marginal's share is farther than ``TOLERANCE`` from its target,
at most ``MAX_ROUNDS`` altogether; where they don't meet by then (stated targets
may ask for cells that have no tokens) a ``NotConverged`` warning gives the
distance, and the weights of the last round count. A cell's raked weight over
its tokens is what a token of it is worth. Documents are sampled, by a hash of
their id, with probability ``scale * worth`` but at most 1, where the scale is
such that ``BUDGET`` of all tokens are expected. A cell whose probability is cut
at 1 has fewer tokens than its weight asks for and gives all of them; all other
cells are in the raked proportions.

Without stated targets a marginal's targets are its token shares to the power
``TEMPERATURE``, which lifts what is rare. Stated targets are frames of (value,
target); values that they lack get no weight.

Only the cells are read more than once: a round is three window sums over
a table with one row a cell. If the cells are counted to be at most ``MAX_CELLS``
they are raked in one task, without a shuffle, and broadcast to the documents;
beyond, sums are shuffled and the documents joined by shuffle (where the adaptive
join splits a cell that holds many documents).

Defined results: null keys are a value of their own, ``''``. Texts that are
null or without words have no tokens; a cell without tokens has probability 0,
and so has every document without tokens. Repeated rows share their fate, as
do all rows of one id. An empty table gives no rows. Columns other than those
named are kept as they are, but for ``probability`` and ``sampled``, which are
replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocatlas.llm.base import table
from vocatlas.session import cut

ROUNDS = 12
MAX_ROUNDS = 240
#: Greatest distance of a marginal's share from its target.
TOLERANCE = 1e-9
TEMPERATURE = 0.7
#: Share of all tokens to sample.
BUDGET = 0.5
MAX_CELLS = 100_000
SEED = 20_240_601
KEYS = ("source", "lang", "topic")
#: Topics of documents that have none of their own: their form, by tokens.
TOPICS = (("note", 100), ("article", 1_000), ("report", 10_000))


class NotConverged(UserWarning):
    """The targets can't all be met, or not within ``MAX_ROUNDS``."""


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(tokens: Column) -> Column:
    out = F.when(tokens < TOPICS[0][1], TOPICS[0][0])
    for name, most in TOPICS[1:]:
        out = out.when(tokens < most, name)
    return out.otherwise("book")


def cells_of(docs: DataFrame, keys=KEYS, tokens: str = "n_tokens") -> DataFrame:
    """Tokens and documents by cell. Partial sums come before the shuffle."""
    return docs.groupBy(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys)).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))


def rake(cells: DataFrame, keys=KEYS, rounds: int = ROUNDS, temperature: float = TEMPERATURE, targets: dict[str, DataFrame] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """``cells`` with ``weight``, the raked share of all tokens, and ``worth``, weight by token."""
    targets = targets or {}
    cur = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for k in keys:
        by = Window.partitionBy(k)
        if k in targets:
            given = targets[k].groupBy(F.coalesce(F.col("value").cast("string"), F.lit("")).alias(k)).agg(F.sum("target").alias(f"t_{k}"))
            cur = cur.join(given, k, "left").withColumn(f"t_{k}", F.coalesce(f"t_{k}", F.lit(0.0)).cast("double"))
        else:
            cur = cur.withColumn(f"t_{k}", F.pow(F.sum(F.col("tokens").cast("double")).over(by), F.lit(temperature)))
    # Targets are made shares: each value's target counts once, whatever its number of cells.
    totals = {}
    cur = cut(cur)
    # One task's rows need no shuffle for a window by any key.
    placed = (lambda df: df.coalesce(1)) if cur.count() <= max_cells else (lambda df: df)
    for k in keys:
        totals[k] = float(cur.select(k, f"t_{k}").distinct().agg(F.sum(f"t_{k}")).first()[0] or 1.0)
    cur = placed(cur.withColumns({f"t_{k}": F.col(f"t_{k}") / F.lit(totals[k]) for k in keys}))
    sums = {k: F.sum("weight").over(Window.partitionBy(k)) for k in keys}
    for done in range(rounds, max(MAX_ROUNDS, rounds) + 1, rounds):
        for _ in range(rounds):
            for k in keys:
                cur = cur.withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(F.col(f"t_{k}"), sums[k]), F.lit(0.0)))
        cur = placed(cut(cur))
        far = cur.select(F.greatest(F.lit(0.0), *(F.abs(sums[k] - F.col(f"t_{k}")) for k in keys)).alias("far")).agg(F.max("far")).first()[0] or 0.0
        if far <= TOLERANCE:
            break
    else:
        warnings.warn(f"after {done} rounds a marginal's share is {far:.3g} from its target", NotConverged, stacklevel=2)
    whole = float(cur.agg(F.sum("weight")).first()[0] or 1.0)
    return cur.select(*keys, "tokens", "docs", (F.col("weight") / whole).alias("weight"), (F.col("weight") / whole / F.col("tokens")).alias("worth"))


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``probability``. Each pass over the cells finds those that
    the scale so far cuts at 1; they only become more, and mostly few passes do."""
    wanted = budget * float(raked.agg(F.sum("tokens")).first()[0] or 0)
    scale, cut_before = 0.0, -1
    while True:
        full = F.lit(scale) * F.col("worth") >= 1
        n, tokens, weight = raked.agg(
            F.coalesce(F.sum(F.when(full, 1)), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == cut_before or not weight:
            break
        scale, cut_before = max(scale, (wanted - tokens) / weight), n
    return raked.withColumn("probability", F.least(F.lit(1.0), F.lit(scale) * F.col("worth")))


def unit(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def with_probability(docs: DataFrame, cells: DataFrame, keys=KEYS, tokens: str = "n_tokens", max_cells: int = MAX_CELLS) -> DataFrame:
    """``docs`` with ``probability`` of their cell."""
    names = [f"__cell_{i}" for i in range(len(keys))]
    small = cells.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("probability").alias("__probability"))
    if small.limit(max_cells + 1).count() <= max_cells:
        small = F.broadcast(small)
    docs = docs.drop("probability", *names, "__probability")
    on = [F.coalesce(F.col(k).cast("string"), F.lit("")) == F.col(n) for k, n in zip(keys, names)]
    p = F.when(F.col(tokens) > 0, F.coalesce("__probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return docs.join(small, on, "left").withColumn("probability", p).drop(*names, "__probability")


def mix(docs: DataFrame, id_col: str = "doc_id", keys=KEYS, tokens: str = "n_tokens", budget: float = BUDGET, seed: int = SEED, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``docs`` (``id_col``, ``keys``, ``tokens`` and any others) with
    ``probability`` and ``sampled``."""
    docs = docs.drop("sampled")
    cells = cut(calibrate(rake(cut(cells_of(docs, keys, tokens)), keys, targets=targets), budget))
    return with_probability(docs, cells, keys, tokens).withColumn("sampled", unit(F.col(id_col), seed) < F.col("probability"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and fate of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", count_tokens(F.col("text")).alias("n_tokens"))
    docs = docs.withColumn("topic", topic_of(F.col("n_tokens")))
    out = mix(docs)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled")


def _sql_round(rows: str) -> str:
    """One round over ``rows``, with each marginal's weights after it."""
    for k in KEYS:
        rows = f"SELECT * REPLACE (weight * t_{k} / sum(weight) OVER (PARTITION BY {k}) AS weight) FROM ({rows})"
    return f"SELECT *, {', '.join(f'sum(weight) OVER (PARTITION BY {k}) AS m_{k}' for k in KEYS)} FROM ({rows})"


_SQL_FAR = f"greatest({', '.join(f'abs(m_{k} - t_{k})' for k in KEYS)})"
_SQL_CELL = f"{', '.join(KEYS)}, tokens, weight, {', '.join(f't_{k}' for k in KEYS)}"
_SQL_TOPIC = "CASE " + " ".join(f"WHEN n_tokens < {most} THEN '{name}'" for name, most in TOPICS) + " ELSE 'book' END"
QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL = {
    "op8_mixing": rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, lang, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT *, {_SQL_TOPIC} AS topic, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM t),
cells AS (SELECT s AS source, l AS lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
raw AS (SELECT *, tokens AS weight, {', '.join(f'pow(sum(tokens) OVER (PARTITION BY {k}), {TEMPERATURE}) AS p_{k}' for k in KEYS)} FROM cells),
{', '.join(f'z_{k} AS (SELECT sum(p) AS z FROM (SELECT DISTINCT {k}, p_{k} AS p FROM raw))' for k in KEYS)},
shares AS (SELECT source, lang, topic, tokens, weight, {', '.join(f'p_{k} / (SELECT z FROM z_{k}) AS t_{k}' for k in KEYS)} FROM raw),
rounds AS (
  SELECT {_SQL_CELL}, 0 AS n, CAST(1 AS DOUBLE) AS far FROM shares
  UNION ALL
  SELECT {_SQL_CELL}, n + 1, max({_SQL_FAR}) OVER () FROM ({_sql_round(f"SELECT * FROM rounds WHERE (n % {ROUNDS} != 0 OR far > {TOLERANCE}) AND n < {MAX_ROUNDS}")})),
last AS (SELECT * FROM rounds WHERE n = (SELECT max(n) FROM rounds)),
worths AS (SELECT source, lang, topic, tokens, weight / (SELECT sum(weight) FROM last) AS weight, weight / (SELECT sum(weight) FROM last) / tokens AS worth FROM last),
runs AS (SELECT *, sum(tokens) OVER o - tokens AS above, sum(weight) OVER (ORDER BY worth, source DESC, lang DESC, topic DESC) AS rest FROM worths WINDOW o AS (ORDER BY worth DESC, source, lang, topic)),
scales AS (SELECT ({BUDGET} * (SELECT sum(tokens) FROM worths) - above) / rest AS scale, worth FROM runs),
probs AS (SELECT source, lang, topic, least(1.0, worth * (SELECT scale FROM scales WHERE scale * worth < 1 ORDER BY worth DESC LIMIT 1)) AS p FROM worths),
done AS (
  SELECT doc_id, d.source, d.lang, d.topic, n_tokens, CASE WHEN n_tokens > 0 THEN coalesce(p, 0.0) ELSE 0.0 END AS p
  FROM d LEFT JOIN probs ON probs.source = s AND probs.lang = l AND probs.topic = d.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS probability,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 < p AS sampled
FROM done
"""
}
