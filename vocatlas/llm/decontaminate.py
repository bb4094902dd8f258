"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` (10) consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. A document's word is hit if it lies
in an occurrence of a window.

Both sides keep, of each ``WINDOW - GRAM + 1`` consecutive hashes of
``GRAM``-word grams, the least (Schleimer, Wilkerson and Aiken, 2003). Any
shared window holds such a set of grams, so its least is kept on both sides:
every shared window has a common fingerprint. Where fingerprints meet, the hit
is extended to the windows around it, which are compared word by word. Items
shorter than a window have no full set of grams; their only window's hash is
looked up at every place of a document.

Where the benchmark has at most ``MAX_WORDS`` words (checked) its fingerprints
and words are broadcast. Beyond that, it is dealt to blocks of about that
size, a stated set of queries run against all documents block by block; the
hit spans of all blocks are joined by document at the end.

Defined results: null, empty and wordless texts have no words, no hits and no
items. Items whose text is null or without words have no window. Items without
an id hit like others; they count as one item and aren't in the digest. Repeated documents
are judged each (an id with several rows gives several rows); repeated items
of one id count once, equal items of several ids count each. Without a
benchmark nothing is hit. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.llm.base import small_batches, table
from vocatlas.llm.bytewords import Lookup, Words, chunks, grams, tokenize
from vocatlas.session import scratch_path

WINDOW = 10
GRAM = 5
#: Of a broadcast block of the benchmark; each is up to half a kilobyte of a worker's memory.
MAX_WORDS = 200_000


def winnow(h: np.ndarray, text: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Kept grams: their places (first word) and hashes. ``text``: each word's row."""
    g = grams(h, gram)
    span = window - gram + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = text[:n] == text[window - 1 :]
    least = g[:n].copy()
    for i in range(1, span):
        np.minimum(least, g[i : n + i], out=least)
    kept = np.zeros(len(g), bool)
    for i in range(span):
        kept[i : n + i] |= whole & (g[i : n + i] == least)
    at = np.flatnonzero(kept)
    return at, g[at]


class Benchmark:
    """The items of one block, ready to look up."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW, gram: int = GRAM):
        """``items``: (item id as text, or None, and text); equal pairs count once."""
        self.window, self.gram = window, gram
        items = sorted(set(items), key=lambda x: (x[0] is not None, x))
        ids = [i for i, _ in items]
        w = tokenize(pa.array([t for _, t in items], pa.string()))
        first = np.cumsum(w.count) - w.count
        at, prints = winnow(w.hash, w.text, window, gram)
        self.prints = Lookup(np.unique(prints))
        #: By length of window: its distinct hashes, and by hash the (words, item ids) with it.
        self.lookup: dict[int, Lookup] = {}
        self.windows: dict[int, dict[int, dict[tuple[bytes, ...], set[str]]]] = {}
        by: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for row, (n, f) in enumerate(zip(w.count.tolist(), first.tolist())):
            size = min(n, window)
            by[size] += [(p, ids[row]) for p in range(f, f + n - size + 1)] if size else []
        for size, places in by.items():
            g = grams(w.hash, size)
            table: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
            for p, item in places:
                table[int(g[p])][tuple(w.word(p + j) for j in range(size))].add(item)
            self.windows[size] = {k: dict(v) for k, v in table.items()}
            self.lookup[size] = Lookup(np.array(sorted(table), np.uint64))

    def spans(self, w: Words) -> list[tuple[int, int, int, frozenset[str]]]:
        """(row, first word within the row, length, items) of the windows that occur."""
        out: list[tuple[int, int, int, frozenset[str]]] = []
        first = np.cumsum(w.count) - w.count
        for size, lookup in self.lookup.items():
            n = len(w.hash) - size + 1
            if n <= 0:
                continue
            if size == self.window:
                at, prints = winnow(w.hash, w.text, self.window, self.gram)
                hit, _ = self.prints.find(prints)
                if not len(hit):
                    continue
                # A gram at p lies in the windows that begin from p - (window - gram) to p.
                begin = at[hit][:, None] - np.arange(size - self.gram + 1)
                begin = np.unique(begin[(begin >= 0) & (begin < n)])
                steps = np.arange(size)
                h = np.concatenate([grams_at(w.hash, part, steps) for part in np.array_split(begin, len(begin) // 100_000 + 1)])
            else:
                begin, h = np.arange(n), grams(w.hash, size)
            got, key = lookup.find(h)
            begin = begin[got]
            ok = w.text[begin] == w.text[begin + size - 1]
            table = self.windows[size]
            for p, k in zip(begin[ok].tolist(), lookup.keys[key[ok]].tolist()):
                items = table[k].get(tuple(w.word(p + j) for j in range(size)))
                if items:
                    row = int(w.text[p])
                    out.append((row, p - int(first[row]), size, frozenset(items)))
        return out


def grams_at(h: np.ndarray, begin: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Hashes of the grams that begin at given places."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    flat = h[(begin[:, None] + steps).ravel()]
    return grams(flat, len(steps))[:: len(steps)]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of (first, length)."""
    total, upto = 0, -1
    for a, n in sorted(spans):
        total += max(0, a + n - max(a, upto))
        upto = max(upto, a + n)
    return total


def _block(spark: SparkSession, rows: list, window: int, gram: int):
    return spark.sparkContext.broadcast(Benchmark([(None if r.item_id is None else str(r.item_id), r.text) for r in rows], window, gram))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_words: int = MAX_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns, n_words, n_hit, n_items, items_sha256
    and contaminated. ``benchmark``: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where("text is not null").select("item_id", "text")
    size = int(items.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // 2  # words at most
    blocks = -(-size // max_words) or 1
    if blocks == 1:
        shared = _block(spark, items.collect(), window, gram)
        return _mark_block(docs, shared, id_col, text_col, carry)
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    keyed = _settled(keyed.select("__row", id_col, *carry, F.col(text_col).alias("__text")))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for k in range(blocks):
        part = _spans_block(keyed, _block(spark, dealt.where(F.col("block") == k).collect(), window, gram))
        found = part if found is None else found.union(part)
    counts = keyed.select("__row", id_col, *carry, "__text")
    words = _mark_block(counts, _block(spark, [], window, gram), "__row", "__text", (id_col, *carry)).select("__row", id_col, *carry, "n_words")
    # One row a document and block: spans of a document are joined, never of all documents.
    merged = found.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    starts = F.array_sort("spans")
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["first"] + x["size"] - F.greatest(x["first"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], x["first"] + x["size"]).alias("upto"),
        ),
        lambda acc: acc["n"],
    )
    merged = merged.select("__row", total.alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    return words.join(merged, "__row", "left").select(
        id_col, *carry, "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.coalesce("items", none)), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _settled(df: DataFrame) -> DataFrame:
    """Row numbers must not change between the blocks."""
    path = scratch_path(df.sparkSession, "decontaminate")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _spans_block(keyed: DataFrame, shared) -> DataFrame:
    """``__row``, spans and items of the documents that a block's windows occur in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in chunks(b.column(1)):
                by: dict[int, list] = defaultdict(list)
                for row, first, size, items in shared.value.spans(tokenize(part)):
                    by[at + row].append((first, size, items))
                if by:
                    rows = sorted(by)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(rows)),
                            pa.array([[{"first": f, "size": n} for f, n, _ in by[r]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("size", pa.int64())]))),
                            pa.array([list(set().union(*(i for _, _, i in by[r]))) for r in rows], pa.list_(pa.string())),
                        ],
                        names=["__row", "spans", "items"],
                    )

    return keyed.select("__row", "__text").mapInArrow(run, "__row long, spans array<struct<first:long,size:long>>, items array<string>")


def _mark_block(docs: DataFrame, shared, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    cols = [id_col, *carry]
    src = docs.select(*cols, F.col(text_col).alias("__text"))
    names = [*cols, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    schema = docs.select(*cols).schema
    for c, t in zip(names[len(cols) :], ("long", "long", "long", "string", "boolean")):
        schema = schema.add(c, t)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in batches:
            n = b.num_rows
            words, hit, n_items, digest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [empty] * n
            for at, part in chunks(b.column(len(cols))):
                w = tokenize(part)
                words[at : at + len(part)] = w.count
                by: dict[int, list] = defaultdict(list)
                for row, first, size, items in bench.spans(w):
                    by[row].append((first, size, items))
                for row, found in by.items():
                    all_ids = set().union(*(i for _, _, i in found))
                    ids = sorted(all_ids - {None})
                    hit[at + row] = covered([(f, k) for f, k, _ in found])
                    n_items[at + row] = len(all_ids)
                    digest[at + row] = hashlib.sha256(",".join(ids).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words), pa.array(hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array(hit > 0)], names=names)

    return src.mapInArrow(run, schema)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole document."""
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL = {
    "op7_decontaminate": f"""
WITH b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, p.k, item_id FROM places p JOIN wins USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(coalesce(string_agg(x, ',' ORDER BY x), '')) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
}
