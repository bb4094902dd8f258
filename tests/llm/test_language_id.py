"""Language identification."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from vocatlas.llm import language_id as L

WORDS = {"aa": ["bana", "nado", "dolu", "luri"], "bb": ["skrt", "tzwk", "prsk", "vltk"], "cc": ["eiou", "ouiea", "aeio", "uiao"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return L.Model([(lang, sentence(rng, lang, 60)) for lang in WORDS for _ in range(10)])


def plain_phrases(text, train):
    """Longest-match phrases of a text by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


def test_automaton_knows_exactly_the_substrings():
    seq = [1, 2, 1, 1, 2, 2, 1, 2]
    nxt = L.suffix_automaton(seq)
    subs = {tuple(seq[i:j]) for i in range(8) for j in range(i + 1, 9)}
    for n in range(1, 5):
        for code in range(2**n):
            word, s = [1 + (code >> i & 1) for i in range(n)], 0
            for c in word:
                s = nxt[s].get(c) if s is not None else None
            assert (s is not None) == (tuple(word) in subs)


def test_phrases_against_substring_search(model):
    rng = random.Random(2)
    texts = [sentence(rng, lang, n) for lang in WORDS for n in (1, 3, 20, 400)] + [sentence(rng, "aa", 300) + "q" * 700 + sentence(rng, "cc", 90), sentence(random.Random(1), "bb", 200), "x", "a", "bana  bana!!", ""]
    got, letters = L.Parser(model).phrases(texts)
    rng = random.Random(1)
    train = {lang: " ".join(sentence(rng, lang, 60) for _ in range(10)) for lang in WORDS}
    for i, t in enumerate(texts):
        t = "".join(c if c.isalpha() else " " for c in t)
        while "  " in t:
            t = t.replace("  ", " ")
        assert letters[i] == bool(t.strip())
        if t.strip():
            t = t.lstrip()
            assert got[i].tolist() == [plain_phrases(t, train[lang]) for lang in sorted(WORDS)]


def test_held_out(model):
    rng = random.Random(3)
    p = L.Parser(model)
    for lang in WORDS:
        langs, score = p.judge([sentence(rng, lang, 12) for _ in range(20)])
        assert langs == [lang] * 20 and (score > 0.9).all() and (score <= 1).all()


def test_long_texts_are_parsed_whole(model):
    rng = random.Random(4)
    mixed = sentence(rng, "aa", 400) + " " + sentence(rng, "bb", 4000)
    assert L.Parser(model).judge([mixed])[0] == ["bb"]


def test_defined_results(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang, 30), lang, "keep") for i, lang in enumerate(list(WORDS) * 20)]
    rows += [(900, None, "aa", None), (901, "", "aa", None), (902, "12 !?", "bb", None), (None, "bana nado", None, None), (903, "BANA", None, None), (903, "BANA", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.fit(docs)
    got = L.identify(docs, model, carry=("lang",)).where("doc_id >= 900 or doc_id is null").collect()
    by = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in got}
    assert by[(900, "aa")] == by[(901, "aa")] == by[(902, "bb")] == ("und", 0.0)
    assert by[(None, None)][0] == "aa" and len(got) == 6
    assert L.identify(docs, L.fit(docs.limit(0))).select("lang_pred").distinct().first()[0] == "und"
    assert L.identify(docs.limit(0), model).isEmpty()


def test_blocks_of_any_size_give_one_parse(model, monkeypatch):
    """Also where a phrase is longer than a block."""
    rng = random.Random(8)
    train = " ".join(sentence(random.Random(1), "aa", 60) for _ in range(3))
    texts = [train[5:900], sentence(rng, "bb", 200) + train[300:700] + "é" * 30, "a"]
    want = None
    for block in (1 << 20, 512, 40, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        got = L.Parser(model).phrases(texts)[0].tolist()
        assert want in (None, got)
        want = got


def test_scripts_of_many_letters():
    """Four languages with alphabets of 1,500 letters each and none in common."""
    rng = random.Random(9)
    alphabets = [[chr(0x4E00 + 1500 * k + i) for i in range(1500)] for k in range(4)]
    text = lambda k, n: "".join(rng.choice(alphabets[k]) for _ in range(n))
    p = L.Parser(L.Model([(f"l{k}", text(k, 250)) for k in range(4) for _ in range(60)]))
    for k in range(4):
        langs, score = p.judge([text(k, 200) for _ in range(10)])
        assert langs == [f"l{k}"] * 10 and (score > 0.999999).all()


def test_sample_is_bounded_and_learns_from_labels_only(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("bana nado "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))).alias("lang"))
    got = L.sample(docs, pieces_per_lang=16)
    assert {lang for lang, _ in got} == {"l1", "l2"} and len(got) == 32
    assert len(L.sample(docs, pieces_per_lang=16, pieces=10)) == 10
    # Any number of languages is learned.
    many = L.sample(spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))
    assert len(many) == 300


def test_copies_and_early_texts_do_not_crowd_out_the_others(spark):
    """Half of a language's rows copy one text that sorts first; the others still count, from anywhere in them."""
    rng = random.Random(6)
    texts = ["0 " + "zq " * 200] * 500 + [sentence(rng, "aa", 100) for _ in range(500)]
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = [t for _, t in L.sample(docs)]
    assert len(set(got)) == len(got) > 400 and sum("zq" in t for t in got) <= 3
    assert sum(not any(x.startswith(t) for x in texts) for t in got) > 250
    assert all(len(t) <= L.PIECE and any(t in x for x in texts) for t in got)


def test_query(spark, tmp_path):
    """Held-out rows by zlib's crc32, learning from no others, and the columns."""
    rng = random.Random(10)
    rows = [(i, sentence(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(list(WORDS) * 100)]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    # A language that only held-out rows have is never learned.
    rows = [(i, t, "zz" if held(i) and i % 5 == 0 else lang) for i, t, lang in rows] + [(900, None, "aa"), (None, "bana nado", None), (901, "7", "bb")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = L.op1_language_id(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = out.collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    by = {r.doc_id: r for r in got}
    assert {r.lang_pred for r in got} == {*WORDS, "und"} and by[900].lang_pred == by[901].lang_pred == "und"
    model = L.Model([x for x in L.sample(spark.createDataFrame([r for r in rows if r[0] is None or not held(r[0])], "doc_id long, text string, lang string"))])
    lang, score = L.Parser(model).judge([t or "" for _, t, _ in rows])
    assert [(r[0], lang[i], score[i]) for i, r in enumerate(rows)] == [(i, by[i].lang_pred, by[i].score) for i, _, _ in rows]
