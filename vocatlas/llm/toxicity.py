"""Toxic passages by maximum-scoring segments.

A word's score is its log-odds of standing in toxic against other labelled
texts under an informative Dirichlet prior (Monroe, Colaresi and Quinn, 2008),
one standard deviation nearer to zero; words whose log-odds are not ``Z_MIN``
deviations from zero, on either side, score ``-DRIFT``. A linear-time scan finds
all maximal scoring segments of a text (Ruzzo and Tompa, 1999): as all other
words score the same, it need only visit the scored words and the gaps between
them. A segment of score S in a text of n words has the expected count
``K n exp(-lambda S)`` in other texts (Karlin and Altschul, 1990), where lambda
solves ``sum p_i exp(lambda s_i) = 1`` over the scores of words in such texts and
``K``, that sum over the positive scores (a segment begins with one), bounds the
constant. Segments of at most
``E_MAX`` are passages; a text's statistic is the sum of ``-ln E`` over them
(without any, the best segment's if positive), and a logistic curve turns it
into a score. The curve is fitted to statistics of labelled texts under words
learned from the other half of these texts.

Fitted on a bounded sample: ``TRAIN_DOCS`` labelled texts (expected, chosen by
the hash of their ids; all if there are fewer), copies of a text counting once.
Its significant words, all of them, are broadcast to the workers: each is in
``MIN_TEXTS`` of the sampled texts at least. All texts are then scored whole.

Defined results: null and empty texts, and texts without scored words, get the
curve's lowest value. Labels that are null are ignored; a text with several
labels has their majority, ties toxic. Without labels of both kinds every text
gets the share of toxic labels (0 if none). Repeated rows are scored each.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatlas.llm.base import ascii_lower, id_crc, small_batches, table
from vocatlas.llm.bytewords import Lookup, Words, chunks, hash_words, tokenize
from vocatlas.session import cut

TRAIN_DOCS = 40_000
MIN_TEXTS = 3
Z_MIN = 4.0
PRIOR = 0.1
DRIFT = 0.05
E_MAX = 0.05
PASSAGE = T.StructType(
    [T.StructField(n, t) for n, t in (("first_word", T.IntegerType()), ("last_word", T.IntegerType()), ("score", T.DoubleType()), ("e_value", T.DoubleType()), ("text", T.StringType()))]
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """A bounded sample of (text, toxic), copies of a text once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    n = known.count()
    parts = 1 << 20
    kept = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(parts)) < math.ceil(parts * min(1.0, most / max(1, n))))
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(kept), "doc_id")
    once = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(once), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])


def lexicon(rows: DataFrame) -> tuple[list[tuple[str, float, float]], float, float]:
    """(word, score, share of other texts' words) of the significant words;
    words of toxic and of other texts. Words count once a text."""
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(ascii_lower(F.col("text")), NOT_WORD))).alias("word")).where("word != ''")
    counts = words.groupBy("word").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    totals = counts.agg(F.sum("yes"), F.sum("no")).first()
    yes, no = float(totals[0] or 0), float(totals[1] or 0)
    if not yes or not no:
        return [], yes, no
    prior = PRIOR * (F.col("yes") + F.col("no"))
    whole = PRIOR * (yes + no)
    odds = lambda y, n: F.log((y + prior) / (n + whole - y - prior))
    scored = (
        counts.where(F.col("yes") + F.col("no") >= MIN_TEXTS)
        .withColumn("delta", odds(F.col("yes"), yes) - odds(F.col("no"), no))
        .withColumn("sd", F.sqrt(1 / (F.col("yes") + prior) + 1 / (F.col("no") + prior)))
        .where(F.abs("delta") >= Z_MIN * F.col("sd"))
        .select("word", (F.col("delta") - F.signum("delta") * F.col("sd")).alias("score"), ((F.col("no") + prior) / (no + whole)).alias("share"))
    )
    return [(r.word, r.score, r.share) for r in scored.orderBy("word").collect()], yes, no


def solve_lambda(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of the scores' moment equation; shares sum to at most 1 and the mean is negative."""
    rest = max(0.0, 1 - shares.sum())
    f = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(-x * drift) - 1)
    lo, hi = 1e-9, 1.0
    while f(hi) < 0:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text
    whose scored words stand at ``positions`` and whose others score ``-drift``."""
    kept: list[list[float]] = []  # first, last, sum before, sum after
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total -= drift * (p - at - 1)
        if s <= 0:
            total, at = total + s, p
            continue
        seg = [p, p, total, total + s]
        total += s
        at = p
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= seg[2]:
                j -= 1
            if j < 0 or kept[j][3] >= seg[3]:
                kept.append(seg)
                break
            seg = [kept[j][0], seg[1], kept[j][2], seg[3]]
            del kept[j:]
    return [(int(a), int(b), d - c) for a, b, c, d in kept]


class Model:
    """The lexicon, the extreme-value constants and the curve."""

    def __init__(self, words: list[tuple[str, float, float]], base: float):
        h = hash_words([w for w, _, _ in words])
        order = np.argsort(h)
        self.lookup = Lookup(h[order])
        self.scores = np.array([s for _, s, _ in words])[order] if words else np.zeros(0)
        shares = np.array([p for _, _, p in words])
        scores = np.array([s for _, s, _ in words])
        mean, rest = float((shares * scores).sum()), max(1e-9, 1 - float(shares.sum()))
        self.drift = max(DRIFT, 2 * mean / rest)  # the mean must be negative
        self.known = any(s > 0 for _, s, _ in words)
        self.lam = solve_lambda(scores, shares, self.drift) if self.known else 1.0
        self.k = float((shares * np.exp(self.lam * scores))[scores > 0].sum()) if self.known else 1.0
        self.curve = (math.log(max(base, 1e-6) / max(1 - base, 1e-6)), 0.0)

    def passages(self, w: Words, rows: int) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
        """The statistic, and the passages (first word, last word, score, E), by row."""
        stat, found = np.zeros(rows), [[] for _ in range(rows)]
        if not self.known:
            return stat, found
        at, key = self.lookup.find(w.hash)
        if not len(at):
            return stat, found
        of = w.text[at]
        first = np.cumsum(w.count) - w.count
        bounds = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            d = int(of[a])
            segments = maximal_segments((at[a:b] - first[d]).tolist(), self.scores[key[a:b]].tolist(), self.drift)
            if not segments:
                continue
            log_e = [(s, math.log(self.k * int(w.count[d])) - self.lam * s[2]) for s in segments]
            good = [(s, e) for s, e in log_e if e <= math.log(E_MAX)]
            found[d] = [(s[0], s[1], s[2], math.exp(max(e, -700))) for s, e in good]
            stat[d] = -sum(e for _, e in good) if good else max(0.0, -min(e for _, e in log_e))
        return stat, found

    def probability(self, stat: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * stat, -500, 500)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression on one variable, by Newton's method, never falling in x."""
    t = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0])
    m = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m @ t, -30, 30)))
        grad = m.T @ (p - y) + ridge * t
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + ridge * np.eye(2), grad)
        t -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(t[0]), max(0.0, float(t[1]))


def _apply(docs: DataFrame, model: Model, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [id_col, *carry]
    src = docs.select(*cols, F.col(text_col).alias("__text"))
    schema = T.StructType([*docs.select(*cols).schema, T.StructField("stat", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE))])
    arrow = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            stats, out = [], []
            for _, part in chunks(texts):
                w = tokenize(part)
                stat, found = shared.value.passages(w, len(part))
                stats.append(stat)
                first = np.cumsum(w.count) - w.count
                for d, ps in enumerate(found):
                    out.append(
                        [
                            {"first_word": i, "last_word": j, "score": s, "e_value": e, "text": w.data[w.start[first[d] + i] : w.end[first[d] + j]].tobytes().decode("utf-8", "replace")}
                            for i, j, s, e in ps
                        ]
                    )
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.concatenate(stats) if stats else np.zeros(0)), pa.array(out, arrow)], names=[*cols, "stat", "passages"]
            )

    return src.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model of (doc_id, text) and (doc_id, toxic)."""
    rows = cut(training_rows(docs, labels, most).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))))
    words, _, _ = lexicon(rows)
    n = rows.agg(F.count("*"), F.sum("toxic")).first()
    base = (n[1] or 0) / max(1, n[0])
    model = Model(words, base)
    got = []
    for half in (0, 1):
        # Words of one half, statistics of the other: no text had a part in what it is judged by.
        other = Model(lexicon(rows.where(F.col("half") != half))[0], base)
        if other.known:
            got += _apply(rows.where(F.col("half") == half), other, "toxic", "text").groupBy("toxic", F.round("stat", 3).alias("stat")).count().collect()
    if model.known and got:
        y, x, k = (np.array([r[i] for r in got], float) for i in range(3))
        order = np.lexsort((y, x))
        reps = k[order].astype(int)
        model.curve = fit_curve(np.repeat(x[order], reps), np.repeat(y[order], reps))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, stat, passages, score (0 to 1) and predicted (1 if score is 0.5 or more)."""
    a, b = model.curve
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.lit(a) + F.lit(b) * F.col("stat")))))
    return _apply(docs, model, id_col, text_col, carry).withColumn("score", p).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from labels of ids whose crc32 mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    model = fit(docs, labels.where(~held).select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
