"""Benchmark decontamination."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from vocatlas.llm import decontaminate as D
from vocatlas.llm.bytewords import BYTES_AT_ONCE, chunks, tokenize

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(len(iw), window)
        for i in range(len(iw) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == iw[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(None if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)


def test_words_of_batches():
    texts = ["One, two-THREE 4é x\tÄb", None, "", "ü", "--", "end", "a" * 10, "É1 é1"]
    for col in (pa.array(texts), pa.array(["skip", *texts, "skip"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        w = tokenize(col)
        got = [[] for _ in texts]
        for i, t in enumerate(w.text.tolist()):
            got[t].append(w.word(i).decode())
        assert got == [words(t) for t in texts] and w.count.tolist() == [len(g) for g in got]
    seen = {}
    for i in range(len(w.hash)):
        assert seen.setdefault(int(w.hash[i]), w.word(i)) == w.word(i)
    assert len(seen) == len({w.word(i) for i in range(len(w.hash))})


def test_chunks_cover_all_rows():
    col = pa.array(["x" * (BYTES_AT_ONCE // 3)] * 7 + ["y" * (BYTES_AT_ONCE * 2), None, ""] + ["z"] * 5)
    parts = list(chunks(col))
    assert [a for a, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))] and sum(len(p) for _, p in parts) == len(col)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "e1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(12)]
    items = [(i, t) for i, t in items if len(words(t)) != 1 or i % 5 == 0] + [(100, items[3][1]), (3, items[3][1]), (101, None), (None, "a b c")]
    texts = [None, "", "-- .", "b"]
    for _ in range(60):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))
        src = words(rng.choice(items)[1])
        if src and rng.random() < 0.7:
            at = rng.randrange(len(src))
            t += " ; " + ", ".join(src[at : at + rng.randrange(1, 25)]).upper() + "! " + t
        texts.append(t)
    return items, texts + texts[-2:]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("max_words", [1_000_000, 60])
def test_against_every_place(spark, seed, max_words):
    """60 words a block send the benchmark through several blocks."""
    items, texts = case(seed)
    docs = spark.createDataFrame([(i // 2, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if t is not None]
    got = sorted(tuple(r) for r in D.mark(docs, bench, max_words=max_words).collect())
    assert got == sorted((i // 2, *plain(t, known, 10)) for i, t in enumerate(texts))


def test_long_shared_spans(spark):
    rng = random.Random(9)
    item = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    text = ["x"] * 50 + item[100:300] + ["y"] * 30 + item[5:15] + item[20:29]
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string")
    r = D.mark(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).first()
    assert (r.n_hit, r.n_items, r.contaminated) == (210, 1, True)


@pytest.mark.parametrize("max_words", [1_000_000, 1])
def test_empty_tables(spark, max_words):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in D.mark(docs, none, max_words=max_words).collect()) == [(0, 0, False), (2, 0, False)]
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert D.mark(docs.limit(0), some, max_words=max_words).isEmpty()
