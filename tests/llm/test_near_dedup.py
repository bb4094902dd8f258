"""SimHash, Golay keys, components, and groups of near copies."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vocatlas.llm import golay
from vocatlas.llm import near_dedup as N
from vocatlas.llm.components import components


def plain_simhash(text, k):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        words += [w] if w else []
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É é\u00a0x y z\x0bw a b c a b c", "x " * 70000])
def test_fingerprint(text):
    if text and len(text) > 1000:
        assert N.simhash(N.shingle_hashes(N.split_words(text), 3)) == N.simhash(N.shingle_hashes(N.split_words("x x x"), 3))
    else:
        assert N.simhash(N.shingle_hashes(N.split_words(text), 3)) == plain_simhash(text, 3)


def test_golay_code():
    words = golay.CODEWORDS
    assert len(set(words.tolist())) == 4096
    d = np.bitwise_count(words[:64, None] ^ words[None, :])
    assert set(np.unique(d).tolist()) == {0, 8, 12, 16, 24}


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**64, 40, dtype=np.uint64)
    keys = lambda a: [set(r.tolist()) - {-1} for r in golay.keys(a)]
    base = keys(f)
    for i in range(64):
        for j in range(i, 64):
            other = f ^ np.uint64(1 << i) ^ (np.uint64(1 << j) if j != i else np.uint64(0))
            assert all(a & b for a, b in zip(base, keys(other)))


def groups(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_chains_and_random_links(spark, n):
    rng = random.Random(n)
    ids = rng.sample(range(-1000, 1000), 4 * n + 4)
    links = list(zip(ids[: 2 * n], ids[1 : 2 * n + 1])) + [(rng.choice(ids), rng.choice(ids)) for _ in range(n)]
    links += [links[0], (5000, 5000), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups([x for x in links if x[0] is not None], {x for p in links if p[0] is not None for x in p})
    assert got == {k: v for k, v in want.items() if any(k in p for p in links if p[0] != p[1])}


def test_components_of_hubs(spark, monkeypatch):
    """Hubs' links are dealt to several tasks."""
    from vocatlas.llm import components as C

    monkeypatch.setattr(C, "LINKS_PER_TASK", 100)
    links = [(0, i) for i in range(1, 900)] + [(1000, i) for i in range(1001, 1500)] + [(1499, 5000), (5000, 899)] + [(i, i + 1) for i in range(6000, 6050)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups(links, {x for p in links for x in p})


@pytest.mark.parametrize("at_once, steps, per_task", [(500_000, 0, 20_000), (1_000, 1, 20_000), (0, 1, 100)])
def test_components_by_steps_and_at_once(spark, monkeypatch, at_once, steps, per_task):
    """Links that fit in a task take no star step, more links do, in one task or several; all give the same."""
    from vocatlas.llm import components as C

    taken, step = [], C._large_star
    monkeypatch.setattr(C, "AT_ONCE", at_once)
    monkeypatch.setattr(C, "LINKS_PER_TASK", per_task)
    monkeypatch.setattr(C, "_large_star", lambda *a: taken.append(1) or step(*a))
    rng = random.Random(at_once)
    chain = [x << 30 for x in rng.sample(range(-(1 << 30), 1 << 30), 700)]
    links = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 400)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(500)]
    links = [x for x in links if x[0] != x[1]] + [(9, 9), (None, 3)]
    got = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(groups(links[:-2], {x for p in links[:-2] for x in p}).items())
    assert bool(taken) == bool(steps)


def test_salted_join_is_the_join(spark):
    from vocatlas.llm.base import salted_join

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, 1)] * 200, "k long, v long")
    table = spark.createDataFrame([(1, "a"), (3, "b"), (3, "c"), (None, "d"), (9999, "e")], "k long, w string")
    want = sorted((r.k, r.v, r.w) for r in rows.join(table, "k").collect())
    assert sorted((r.k, r.v, r.w) for r in salted_join(rows, table, "k").collect()) == want


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


@pytest.mark.parametrize("bucket", [2, 64])
def test_hamming_links_against_all_pairs(spark, bucket):
    """A bucket of 2 sends nearly all through the way for large buckets."""
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for p in prints[:12]:
        cur = p
        for _ in range(rng.randrange(1, 12)):
            cur ^= 1 << rng.randrange(64)
            if rng.random() < 0.7:
                cur ^= 1 << rng.randrange(64)
            prints.append(cur)
    signed = [N._signed(p) for p in prints]
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if a != b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = N.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket).collect()
    assert groups([(r.a, r.b) for r in got], set(signed)) == groups(pairs, set(signed))
    assert {(r.a, r.b) for r in got} <= {x for a, b in pairs for x in ((a, b), (b, a))}


def test_simhash_groups_of_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (7, " ", 1), (5, "one two three four", 1), (4, "One two three FOUR", 1), (4, "One two three FOUR", 1), (None, "one two three four", 1), (9, "other", 1), (None, "lonely", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in N.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (7, 1), (5, 4), (4, 4), (4, 4), (None, 4), (9, 9), (None, None)], key=str)
    assert N.simhash_groups(docs.limit(0)).isEmpty()


def variants(rng, words, vocabulary, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return out


def jaccard(a, b):
    sets = [{" ".join(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("block", [8, 256])
def test_near_groups_against_all_pairs(spark, monkeypatch, block):
    """Small blocks send the large group through many pairs of blocks."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(3000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(20))
    texts = []
    for size, length in ((40, 150), (10, 400), (6, 60), (4, 12), (3, 9), (2, 6)):
        texts += variants(rng, [rng.choice(vocabulary) for _ in range(length)], vocabulary, size, max(1, length // 60))
    texts += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(30)] + ["", None, " "] + texts[:5] + ["one two", "ONE  two"]
    docs = spark.createDataFrame([(i * 7 % 1009, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ids = [r.doc_id for r in docs.collect()]
    links = [(ids[i], ids[j]) for i in range(len(texts)) for j in range(i) if (texts[i] or "").strip() and (texts[j] or "").strip() and jaccard(texts[i], texts[j]) >= 0.8]
    want = groups(links, set(ids))
    want = {k: v for k, v in want.items() if sum(1 for x in want.values() if x == v) > 1}
    assert {r.doc_id: r.group_id for r in N.near_groups(docs).collect()} == want


def test_dropping_copies(spark):
    text = " ".join("w%d" % i for i in range(50))
    rows = [(2, text, "a"), (1, text + " more", "b"), (3, None, "c"), (4, "", "d"), (None, text, "e"), (5, "alone", "f"), (5, "alone", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group_id string")
    kept = N.drop_near_copies(docs).select(docs.columns)
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[3], rows[4], rows[5]], key=str)
    assert N.drop_near_copies(docs.limit(0)).isEmpty()


def test_failed_candidates_hide_no_true_link():
    """Likelier pairs that fail leave the less likely ones to be verified, within a block and across."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(1 << 30, 450, replace=False)).astype(np.int32)

    def edited(share):
        kept = rng.random(len(base)) >= share
        return np.unique(np.r_[base[kept], rng.choice(1 << 30, int((~kept).sum())).astype(np.int32)])

    # Mutual similarities lie on both sides of 0.8.
    members = [(i, edited(0.057)) for i in range(60)]
    exact = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    for side in (np.zeros(60, bool), np.arange(60) >= 30):
        two = side.any()
        want = [(i, j) for i in range(60) for j in range(i) if (not two or side[i] != side[j]) and exact(members[i][1], members[j][1]) >= 0.8]
        assert 0 < len(want) < 30 * 30
        got = N.similar_links(members, side, 0.8)
        assert groups(got, range(60)) == groups(want, range(60))
        assert {(max(x), min(x)) for x in got} <= set(want)


def all_pairs_groups(docs):
    """Groups of two or more by the similarity of all pairs."""
    rows = [(r.doc_id, r.text.split()) for r in docs.collect()]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, w in rows]
    same = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = groups([(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if same(sets[i], sets[j])], {i for i, _ in rows})
    return {k: v for k, v in want.items() if sum(1 for x in want.values() if x == v) > 1}


def test_groups_of_edits_of_a_lost_original(spark, monkeypatch):
    """Families whose mutual similarity lies on both sides of 0.8, in several blocks."""
    monkeypatch.setattr(N, "BLOCK", 32)
    rng = random.Random(23)
    texts = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(454)]
        for c in range(60):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randrange(5, 8)):
                w[at] = f"e{f}x{c}y{at}"
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in N.near_groups(docs).collect()} == all_pairs_groups(docs)


def test_a_text_is_compared_in_all_its_large_classes(spark, monkeypatch):
    """Pairs of texts that have all their passages from lines that many texts share."""
    monkeypatch.setattr(N, "BLOCK", 16)
    lines = [[f"l{k}w{i}" for i in range(100)] for k in range(20)]
    texts = []
    # The last five pairs differ in the least three, by hash, of their large classes.
    for seed in [*range(150), 395, 817, 936, 1042, 1163]:
        rng = random.Random(seed)
        chosen = rng.sample(range(20), 4)
        for copy in range(2):
            rng.shuffle(chosen)
            text = [w for k in chosen for w in lines[k]]
            for at in rng.sample(range(len(text)), 4):
                text[at] = f"e{seed}x{copy}y{at}"
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = all_pairs_groups(docs)
    assert set(range(300, 310)) <= set(want)
    assert {r.doc_id: r.group_id for r in N.near_groups(docs).collect()} == want


def test_only_texts_with_a_possible_partner_are_compared_whole(spark, monkeypatch):
    """Texts that share a line alone aren't dealt as whole sets to the blocks of its classes; families that share it are still found."""
    monkeypatch.setattr(N, "BLOCK", 16)
    # No shingle is known to be common, so that the line's are among the first ones.
    monkeypatch.setattr(N, "common_shingles", lambda *a, **k: (np.zeros(0, np.uint64), np.zeros(0, np.uint8)))
    rng, dealt, compare = random.Random(31), [], N._class_links
    monkeypatch.setattr(N, "_class_links", lambda rows, threshold: dealt.extend(r.node for r in rows.select("node").distinct().collect()) or compare(rows, threshold))
    line = [f"l{i}" for i in range(24)]
    texts = [line + [f"t{t}w{i}" for i in range(rng.randrange(180, 190))] for t in range(120)]
    for f in range(2):
        base = line + [f"f{f}w{i}" for i in range(414)]
        for c in range(30):
            w = list(base)
            for at in rng.sample(range(len(w)), rng.randrange(5, 8)):
                w[at] = f"e{f}x{c}y{at}"
            texts.append(w)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    want = all_pairs_groups(docs)
    assert want and {r.doc_id: r.group_id for r in N.near_groups(docs).collect()} == want
    assert len(set(dealt)) <= 60


def test_few_documents_are_written_to_few_files(spark, monkeypatch):
    """However many partitions the session asks for: each file costs a task and, in a local store, a process."""
    rng, written = random.Random(41), []
    vocabulary = ["w%d" % i for i in range(500)]
    texts = [t for size in (20, 3, 2) for t in variants(rng, [rng.choice(vocabulary) for _ in range(60)], vocabulary, size, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    asked = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    want = all_pairs_groups(docs)
    cut = N.cut
    monkeypatch.setattr(N, "cut", lambda *a: written.append(cut(*a)) or written[-1])
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.group_id for r in N.near_groups(docs).collect()}
        kept = {r.doc_id for r in N.drop_near_copies(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert want and got == want and kept == {i for i in range(len(texts)) if want.get(i, i) == i}
    assert len(written) > 20 and {df.rdd.getNumPartitions() for df in written} == {1}


def test_tasks_grow_with_documents_and_shingles(spark):
    size = lambda docs, n: N._tasks(spark.range(docs).select(F.lit(n).cast("int").alias("n")))
    assert [size(0, 0), size(1, 9), size(5_001, 9), size(20_000, 0), size(3, 1 << 30)] == [1, 1, 2, 4, 3 << 10]


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95, 1.0])
def test_no_similar_set_is_without_a_partner(share):
    """``with_partner`` against all pairs, for sets of many sizes and their prefixes in one order."""
    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 2, 5, 9, 40, 200):
        base = rng.choice(1 << 20, size, replace=False)
        sets += [np.unique(np.r_[base[rng.random(size) < share], rng.choice(1 << 20, rng.integers(1, 2 + size // 8))]) for _ in range(12)]
    n = np.array([len(s) for s in sets], float)
    prefixes = [s[: N.prefix_size(len(s), 0.8)] for s in sets]
    roots = [i // 2 for i in range(len(sets))]
    for side in (np.zeros(len(sets), bool), np.arange(len(sets)) % 3 == 0):
        similar = {
            i
            for i, a in enumerate(sets)
            for j, b in enumerate(sets)
            if roots[i] != roots[j] and (not side.any() or side[i] != side[j]) and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        }
        assert similar <= set(np.flatnonzero(N.with_partner(prefixes, n, side, roots, 0.8)).tolist())
        assert similar or share == 0.5


def test_short_similar_texts_meet_for_certain(spark):
    """Pairs of 45 shingles at 0.8; the first ones have no passage in common."""
    texts = []
    for seed in [2, 248, 307, 492, 531, 724, 1, 3, 4, 5]:
        rng = random.Random(seed)
        words = [f"s{seed}w{i}" for i in range(49)]
        other = list(words)
        other[rng.randrange(5, 44)] = "edit"
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in N.near_groups(docs).collect()} == {i: i - i % 2 for i in range(len(texts))}


def test_simhash_query(spark, tmp_path):
    """Fingerprints by plain XXH64, components by all pairs, as the query returns them."""
    rng = random.Random(12)
    words = ["w%d" % i for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 200])))) for i in range(0, 120, 2)]
    rows += [(i + 1, t + (" w1" if i % 4 else " W2 x")) for i, t in rows] + [(500, None), (501, ""), (None, rows[0][1]), (4, rows[0][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = N.op2_simhash_golay(spark, str(tmp_path))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_simhash(t, 3) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = groups(links, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    want = [(i, f"{p:016x}", least.get(root[k])) for k, ((i, _), p) in enumerate(zip(rows, prints))]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert len(set(least.values())) < len(rows)
