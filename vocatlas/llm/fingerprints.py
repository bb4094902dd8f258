"""I-Match document fingerprints, in DataFrame functions only.

Terms are words as in ``NOT_WORD``'s gaps, A-Z lower-cased. The lexicon holds
the terms whose inverse document frequency ``ln(N / df)`` lies in a band. A
document's lexicon terms are made distinct and sorted, and each of several
randomised subsets of the lexicon gives one hash of the terms in it
(Chowdhury et al., 2002; Kolcz, Chowdhury and Alspector, 2004).

The subsets come in ``LEVELS`` sizes: a level holds ``SUBSETS`` disjoint random
parts of a random part of the lexicon, ``SHRINK`` times smaller at each level.
So whatever a document's length, at some level a subset holds few of its terms,
and a change of part of the text leaves many of those hashes alone. A
fingerprint is the hashes of all subsets, 4 hexadecimal digits each (zeros: no
term). The likeness of two is, at the level where it is highest among those
with at least ``MIN_SUBSETS`` used subsets (else at the first), the share of
equal hashes among subsets that either uses; equal fingerprints have 1.

The lexicon is the exact set of its terms' 64-bit hashes. A term's df counts
documents. As a lexicon term is in at least ``N exp(-IDF_MAX)`` documents, at
most ``exp(IDF_MAX)`` times the mean number of terms of a document can be in it.
It is counted: up to ``MAX_LEXICON`` terms go to all tasks as a constant of
``SLOTS`` short lists, more are joined by shuffle.

Defined results: null is the empty text; texts without lexicon terms have the
fingerprint of zeros, and are alike (1) to each other and unlike (0) any other.
Repeated rows have equal fingerprints. Empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocatlas.llm.base import ascii_lower, partitions, table
from vocatlas.session import cut

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IDF_MIN, IDF_MAX = 2.5, 6.5
MIN_DF = 2
SLOT_BITS = 15
MAX_LEXICON = 250_000
LEVELS, SHRINK_BITS = 4, 3
GROUPS, PARTS = 8, 4
SUBSETS = GROUPS * PARTS
MIN_SUBSETS = 8
#: Salts of equal rows, and what is beyond any tie or salt.
SALTS, LAST = 1 << 20, (1 << 63) - 1


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms, the empty string between separators left out."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - SLOT_BITS).cast("int")


def lexicon_terms(docs: DataFrame, text_col: str = "text", idf_min: float = IDF_MIN, idf_max: float = IDF_MAX) -> DataFrame:
    """``h``, the hashes of the terms in the band, as a table."""
    n = docs.count()
    low, high = max(MIN_DF, n * math.exp(-idf_max)), n * math.exp(-idf_min)
    return cut(docs.select(F.explode(term_hashes(F.col(text_col))).alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("h"))


def constant(terms: DataFrame) -> Column:
    """A counted lexicon as a constant that each task gets once: an array of lists of hashes."""
    out: list[list[int]] = [[] for _ in range(1 << SLOT_BITS)]
    for r in terms.groupBy(_slot(F.col("h")).alias("at")).agg(F.collect_list("h").alias("hs")).collect():
        out[r["at"]] = r["hs"]
    return F.from_json(F.lit(str(out)), "array<array<bigint>>")


def lexicon(docs: DataFrame, text_col: str = "text", idf_min: float = IDF_MIN, idf_max: float = IDF_MAX, most: int = MAX_LEXICON) -> Column | DataFrame:
    """The lexicon: a constant if it has at most ``most`` terms, else a frame of ``h``."""
    terms = lexicon_terms(docs, text_col, idf_min, idf_max)
    return constant(terms) if terms.count() <= most else terms


def with_terms(df: DataFrame, text: Column, lex: Column | DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the sorted hashes of the text's distinct lexicon terms."""
    if isinstance(lex, Column):
        return df.withColumn(out, F.array_sort(F.filter(term_hashes(text), lambda h: F.array_contains(F.get(lex, _slot(h)), h))))
    rows = cut(df.withColumn("__terms", term_hashes(text)).withColumn("__row", F.monotonically_increasing_id()))
    known = rows.select("__row", F.explode("__terms").alias("h")).join(lex, "h").groupBy("__row").agg(F.array_sort(F.collect_list("h")).alias("__known"))
    return rows.join(known, "__row", "left").withColumn(out, F.coalesce("__known", F.array().cast("array<bigint>"))).drop("__row", "__known", *(["__terms"] if out != "__terms" else []))


def _below(h: Column, bits: int, at: int, value: Column | int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND((1 << bits) - 1) == value


def _in_level(k: int):
    return lambda h: _below(h, SHRINK_BITS * k, 0, 0)


def with_codes(df: DataFrame, text: Column, lex: Column | DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``: the hashes (1 to 65535; 0: no term) of all levels' subsets."""
    terms = F.col("__terms")
    levels = F.array(terms, *(F.filter(terms, _in_level(k)) for k in range(1, LEVELS)))
    low = SHRINK_BITS * (LEVELS - 1)

    def code(part: Column) -> Column:
        return F.when(F.size(part) == 0, F.lit(0)).otherwise((F.pmod(F.xxhash64(part), F.lit(65535)) + 1).cast("int"))

    def subsets(level: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.filter(level, lambda h: _below(h, 3, low, g)))
        return F.flatten(F.transform(groups, lambda part: F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda s: code(F.filter(part, lambda h: _below(h, 2, low + 3, s))))))

    return with_terms(df, text, lex, "__terms").withColumn(out, F.flatten(F.transform(levels, subsets))).drop("__terms")


def as_text(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two arrays of codes."""
    marks = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1001).otherwise(1))  # 1: used; 1000: equal
    sums = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        lambda k: F.aggregate(F.slice(marks, k * SUBSETS + 1, F.lit(SUBSETS)), F.lit(0), lambda acc, x: acc + x),
    )
    share = lambda s: (s / F.lit(1000)).cast("int") / F.greatest(F.lit(1), F.pmod(s, F.lit(1000)))
    best = F.array_max(F.transform(sums, lambda s, k: F.when((k == 0) | (F.pmod(s, F.lit(1000)) >= MIN_SUBSETS), share(s)).otherwise(F.lit(0.0))))
    return F.when(a == b, F.lit(1.0)).otherwise(best)


def _bounds(df: DataFrame, ranges: int) -> list[tuple]:
    """Keys (has an id, id, tie, salt) that cut ``df`` into ranges of about
    equal size: by id, a frequent id's rows by tie, and a frequent tie's by salt."""
    qs = [i / ranges for i in range(1, ranges)] or [0.5]
    n, with_id, cuts = df.agg(F.count("*"), F.sum("has"), F.percentile_approx(F.when(F.col("has") == 1, F.col("id")), qs, 100 * ranges)).first()
    cuts = cuts or []
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    bounds = [(1, c, LAST, LAST) for c in cuts]
    keys = F.col("id").isin(hot) & (F.col("has") == 1) if hot else F.lit(False)
    if (n - (with_id or 0)) * ranges > n:
        keys |= F.col("has") == 0
    elif not hot:
        return sorted(set(bounds))
    some = df.where(keys)
    for r in some.groupBy("has", "id").agg(F.percentile_approx("tie", qs, 100 * ranges).alias("q")).collect():
        bounds += [(r["has"], r["id"], q, LAST) for q in r["q"]]
    for r in some.groupBy("has", "id", "tie").count().where(F.col("count") * ranges > n).collect():
        bounds += [(r["has"], r["id"], r["tie"], SALTS * i // ranges) for i in range(ranges)]
    return sorted(set(bounds))


def with_next(df: DataFrame, id_col: str, cols: list[str], tie: str, ranges: int) -> DataFrame:
    """``df`` with ``next_<col>`` of the row after it in descending ``id_col``
    (ties by descending ``tie``, null ids last; after the last: the first).

    Rows are dealt to ranges of (id, tie, salt), cut at approximate quantiles,
    and sorted within; a range also gets the first row of the range after it, so
    that no row's neighbour is in another task and no task holds all rows, even
    if most have one id or none and one text.
    """
    row = F.monotonically_increasing_id()
    zero = F.lit(0).cast(df.schema[id_col].dataType)
    names = ("has", "id", "tie", "salt")
    parts = (F.col(id_col).isNotNull().cast("int"), F.coalesce(F.col(id_col), zero), F.col(tie), F.pmod(F.xxhash64(row), F.lit(SALTS)))
    key = F.struct(*(c.alias(x) for x, c in zip(names, parts)), row.alias("row"))
    keyed = df.withColumn("__key", key)
    bounds = _bounds(keyed.select("__key.*"), ranges)
    # Binary search: how many bounds are below the key.
    top = 1 << max(0, len(bounds).bit_length() - 1)
    powers = F.array(*(F.lit(top >> i) for i in range(top.bit_length())))
    kinds = ("int", df.schema[id_col].dataType, "long", "long")
    table_of = F.array(*(F.struct(*(F.lit(v).cast(t).alias(x) for x, v, t in zip(names, b, kinds))) for b in bounds or [(0, 0, 0, 0)]))
    mine = F.struct(*(F.col(f"__key.{x}").alias(x) for x in names))
    place = F.aggregate(powers, F.lit(0), lambda acc, p: F.when((acc + p <= len(bounds)) & (F.get(table_of, acc + p - 1) < mine), acc + p).otherwise(acc))
    placed = keyed.withColumn("__range", place)
    firsts = {r["__range"]: r["row"] for r in placed.groupBy("__range").agg(F.max("__key").alias("f")).select("__range", "f.row").collect()}
    if not firsts:
        return df.select(*df.columns, *(F.col(c).alias(f"next_{c}") for c in cols))
    order = sorted(firsts)
    # The range before the one that a first row is in; before the highest, the lowest.
    before = F.create_map(*(F.lit(x) for a, b in zip(order, [*order[1:], order[0]]) for x in (a, b)))
    rows = F.create_map(*(F.lit(x) for k, v in firsts.items() for x in (k, v)))
    copy = lambda r, n: F.struct(r.alias("r"), F.lit(n).alias("copy"))
    own = copy(F.col("__range"), 0)
    is_first = F.col("__key.row") == F.try_element_at(rows, F.col("__range"))
    copies = F.when(is_first, F.array(own, copy(F.try_element_at(before, F.col("__range")), 1))).otherwise(F.array(own))
    dealt = placed.withColumn("__c", F.explode(copies)).select(*df.columns, "__key", F.col("__c.r").alias("__range"), F.col("__c.copy").alias("__copy"))
    w = Window.partitionBy("__range").orderBy("__copy", F.desc("__key"))
    return dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in cols)).where("__copy = 0").drop("__range", "__copy", "__key")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = lexicon(docs)
    coded = with_codes(docs, F.col("text"), lex, "codes").withColumn("tie", F.xxhash64("text"))
    near = with_next(coded, "doc_id", ["text", "codes"], "tie", 4 * partitions(spark))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))).select(
        "doc_id", n.cast("long").alias("n_chars"), "edited", "codes", "next_codes"
    )
    done = with_codes(edited, F.col("edited"), lex, "edited_codes")
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("codes")).alias("fingerprint"), as_text(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


QUERIES = {"op9_imatch": op9_imatch}
ORACLE_SQL: dict[str, str] = {}
