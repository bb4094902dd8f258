"""I-Match fingerprints."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import fingerprints as I


def test_next_in_descending_order(spark):
    for ids in ([5, 3, 9, 1, 7, 2, 100, -4], [1], [None, 4, 2], [3, 3, 3, 1]):
        df = spark.createDataFrame([(i, f"t{k}", k % 3) for k, i in enumerate(ids)], "doc_id long, text string, tie long")
        for ranges in (1, 3, 50):
            got = {r.text: r.next_text for r in I.with_next(df, "doc_id", ["text"], "tie", ranges).collect()}
            order = sorted(df.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.tie))
            want = {a.text: (a.doc_id, b.doc_id, b.tie) for a, b in zip(order, order[1:] + order[:1])}
            at = {r.text: (r.doc_id, r.tie) for r in order}
            assert len(got) == len(ids) and all(at[got[t]] == (b, tie) for t, (_, b, tie) in want.items())
    assert I.with_next(df.limit(0), "doc_id", ["text"], "tie", 3).isEmpty()


def test_many_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(0).cast("long").alias("tie"))
    got = {r.doc_id: r.next_doc_id for r in I.with_next(df, "doc_id", ["doc_id"], "tie", 40).collect()}
    order = sorted(got, reverse=True)
    assert [got[i] for i in order] == order[1:] + order[:1]


@pytest.mark.parametrize("hot", [7, None])
def test_hot_ids_are_dealt_to_many_tasks(spark, hot):
    """A third of the rows has one id and texts of its own, another third is one row repeated."""
    rows = [(hot, f"t{i}") for i in range(1000)] + [(500, "same")] * 1000 + [(i, f"u{i}") for i in range(1000, 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    out = I.with_next(df, "doc_id", ["doc_id", "text"], "tie", 30)
    got = [((r.doc_id, r.text), (r.next_doc_id, r.next_text)) for r in out.collect()]
    order = sorted(((r.doc_id, r.text, r.tie) for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), -r[2]))
    pairs = [(a[:2], b[:2]) for a, b in zip(order, order[1:] + order[:1])]
    assert sorted(got, key=str) == sorted(pairs, key=str)
    keyed = df.withColumn("row", F.monotonically_increasing_id()).select(F.col("doc_id").isNotNull().cast("int").alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie", F.pmod(F.xxhash64("row"), F.lit(I.SALTS)).alias("salt"))
    bounds = I._bounds(keyed, 30)
    sizes = {}
    for r in keyed.collect():
        k = sum(b < tuple(r) for b in bounds)
        sizes[k] = sizes.get(k, 0) + 1
    assert max(sizes.values()) <= 250


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(9000)]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([20, 100, 800]))) for _ in range(150)]


def test_lexicon_is_the_band(spark, texts):
    docs = spark.createDataFrame([(i, t + " The") for i, t in enumerate(texts)], "doc_id long, text string")
    lex = I.lexicon(docs)
    df = {}
    for t in texts:
        for w in set((t + " the").split()):
            df[w] = df.get(w, 0) + 1
    lists = docs.limit(1).select(lex.alias("b")).first().b
    words = sorted(df)
    hashes = [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).orderBy("w").collect()]
    wanted = {h for w, h in zip(words, hashes) if max(2, 150 * 2.718281828459045**-6.5) <= df[w] <= 150 * 2.718281828459045**-2.5}
    got = {h & (1 << 64) - 1 for hs in lists for h in hs}
    assert got == wanted and "the" in df and not any(h in got for w, h in zip(words, hashes) if w == "the")
    # A lexicon too large for a constant is joined, with the same terms.
    joined = I.lexicon(docs, most=10)
    plain, far = (sorted(tuple(r) for r in I.with_codes(docs, F.col("text"), x, "codes").select("doc_id", "codes").collect()) for x in (lex, joined))
    assert plain == far and any(any(c) for _, c in plain)


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("codes", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    return {r.doc_id: r for r in I.op9_imatch(spark, str(tmp_path)).collect()}


def test_query(spark, texts, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[3].upper().replace(" ", ", ")), (503, "é😀x"), (504, texts[3])]
    got = run(spark, tmp_path, rows)
    order = sorted(rows, reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[502].fingerprint == got[504].fingerprint != got[4].fingerprint
    assert set(got[500].fingerprint) == {"0"} and got[501].near_next == 1.0 and got[501].near_edited == 1.0
    better = sum(got[i].near_edited > got[i].near_next for i in range(150))
    assert better >= 140


def test_codes_against_plain_python(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20])], "doc_id long, text string")
    lex = I.lexicon(docs, idf_min=0.1)
    coded = I.with_codes(docs, F.col("text"), lex, "codes").withColumn("terms", I.term_hashes(F.col("text"))).withColumn("lists", lex).collect()
    for r in coded[:5]:
        full = lambda h: h & (1 << 64) - 1
        known = sorted(h for h in r.terms if h in r.lists[full(h) >> 64 - I.SLOT_BITS])
        used = []
        for k in range(I.LEVELS):
            level = [h for h in known if full(h) & ((1 << 3 * k) - 1) == 0]
            used += [bool([h for h in level if (full(h) >> 9 & 7, full(h) >> 12 & 3) == (g, s)]) for g in range(8) for s in range(4)]
        assert [c > 0 for c in r.codes] == used


def test_likeness(spark):
    n = I.LEVELS * I.SUBSETS
    a = [1] * 16 + [0] * (n - 16)
    b = [1] * 8 + [2] * 8 + [0] * (n - 16)
    cases = [(a, a, 1.0), (a, b, 0.5), ([0] * n, [0] * n, 1.0), (a, [0] * n, 0.0), ([1, 2, 3] + [0] * (n - 3), [1, 2, 4] + [0] * (n - 3), 2 / 3)]
    df = spark.createDataFrame([(x, y) for x, y, _ in cases], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(I.likeness(F.col("a"), F.col("b"))).collect()] == pytest.approx([c for *_, c in cases])
