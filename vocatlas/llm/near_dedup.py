"""Near duplicates by SimHash, found with Golay-code fuzzy hashing.

``fingerprints`` gives a 64-bit SimHash of word shingles. ``hamming_links``
links fingerprints that differ in at most two bits: equal fingerprints count
once, the keys of ``golay`` make buckets, pairs of a bucket of at most
``BUCKET`` members are verified, and members of a larger bucket meet by the
points within one bit of each instead (two strings are within two bits if and
only if they share such a point; at most 65 strings share one), which is exact
and linear in a bucket's size. ``simhash_groups`` adds connected components.

``near_groups`` groups documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. Fingerprints of such pairs may differ in far
more than two bits, so an exact prefix filter finds the pairs that Golay keys
don't, and all are verified on whole shingle sets. See ``near_groups``.

Defined results: null, empty and blank texts have fingerprint zero, are linked
like any other by ``simhash_groups``, and form no group in ``near_groups``
(there is nothing to compare: each stays). Repeated rows and equal texts share
a fingerprint. Null ids are carried and never chosen as a component's id
unless all its ids are null. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatlas.llm import golay
from vocatlas.llm.base import partitions, salted_join, small_batches, table
from vocatlas.llm.bytewords import mix
from vocatlas.llm.components import components
from vocatlas.session import cut, scratch_path

SEED = 42
RADIUS = 2
BUCKET = 64
#: Shingles hashed at once; bounds a worker's memory on long texts.
SHINGLES_AT_ONCE = 1 << 16

#: Texts that the order of shingles is learned from, and shingles that it knows to be common.
SAMPLE, MAX_COMMON = 5_000, 250_000
#: Nodes of a class whose pairs are candidates at once.
SMALL = 16
#: Nodes of a larger class compared at once, and their shingles on average.
BLOCK, BLOCK_SHINGLES = 512, 1024
#: Documents, and their shingles, that a task of ``near_groups`` takes at least, where the session asks for more partitions.
DOCS_PER_TASK, SHINGLES_PER_TASK = 5_000, 1 << 20
#: Shingles whose counts are added up at once.
COLUMNS = 2048
#: Ids or keys that may be broadcast, 8 or 16 bytes each.
MAX_BROADCAST = 250_000


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text whose A-Z are lower-cased.

    ``bytes`` treats exactly these characters as white space and A-Z as letters.
    """
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles (the whole sequence if shorter), in blocks."""
    digest = xxhash.xxh64_digest
    if not words:
        return
    if len(words) <= k:
        yield np.frombuffer(digest(b" ".join(words), SEED), ">u8")
        return
    n = len(words) - k + 1
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at : min(n, at + SHINGLES_AT_ONCE) + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = [0, *(ends[: len(part) - k] + 1).tolist()]
        yield np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]), ">u8")


def simhash(blocks: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes: bits that over half of them set; zero without any."""
    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp``, the SimHash as a signed long."""
    small_batches(docs.sparkSession)
    src = docs.select(id_col, F.col(text_col).alias("__text"))
    schema = docs.select(id_col).schema.add("fp", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(simhash(shingle_hashes(split_words(t.as_py()), shingle))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return src.mapInArrow(run, schema)


def _golay_rows(prints: DataFrame) -> DataFrame:
    """``fp`` and each of its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            k = golay.keys(fp.view(np.uint64))
            good = k >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, good.sum(axis=1))), pa.array(k[good])], names=["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp long, key long")


def _midpoint_rows(prints: DataFrame) -> DataFrame:
    """``fp`` and each of the 65 points within one bit of it."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            points = fp.view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, 65)), pa.array(points.ravel().view(np.int64))], names=["fp", "point"])

    return prints.select("fp").mapInArrow(run, "fp long, point long")


def hamming_links(prints: DataFrame, bucket: int = BUCKET, tasks: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` whose closure is that of all pairs of distinct
    fingerprints within two bits. Each link is such a pair, or its ends meet
    in a point within one bit of both. ``tasks`` as for ``cut``.
    """
    distinct = prints.select("fp").distinct()
    size = _golay_rows(distinct).groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    size = cut(size, tasks)
    near = F.bit_count(F.expr("a ^ b")) <= RADIUS
    pairs = size.where("n = 2").where(near).select("a", "b")
    crowded = size.where("n > 2").select("key", "n")
    if crowded.count() <= MAX_BROADCAST:
        crowded = F.broadcast(crowded)
    shared = cut(_golay_rows(distinct).join(crowded, "key"), tasks)
    small = shared.where(F.col("n") <= bucket).select("key", "fp")
    pairs = pairs.union(
        small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key").where("a < b").where(near).select("a", "b")
    )
    points = _midpoint_rows(shared.where(F.col("n") > bucket).select("fp").distinct())
    least = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b")
    meet = points.join(least, "point").select(F.col("fp").alias("a"), "b").where("a != b")
    return pairs.union(meet).distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``: the least id whose fingerprint is reached."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    first = prints.groupBy("fp").agg(F.min(id_col).alias("first"))
    roots = components(hamming_links(prints))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(least, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(id_col, "fp", "component_id")


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets have in common."""
    m = len(sets)
    values, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    column = (np.cumsum(shared) - 1)[at]
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = shared[at]
    order = np.argsort(column[keep], kind="stable")
    row, column = row[keep][order], column[keep][order]
    same = np.zeros((m, m), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((m, COLUMNS), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        same += has @ has.T
    return same


def with_partner(prefixes: list[np.ndarray], n: np.ndarray, side: np.ndarray, roots: list, threshold: float) -> np.ndarray:
    """Whether a text of another root may be similar, as far as the texts' sizes ``n`` and the shared
    members of their prefixes tell: the bound of ``_plausible``. ``side`` as for ``similar_links``."""
    root = np.unique(np.array(roots), return_inverse=True)[1]
    most, least = np.maximum(n[:, None], n[None, :]), np.minimum(n[:, None], n[None, :])
    able = (root[:, None] != root[None, :]) & (least >= threshold * most - 1e-6)
    if side.any() and not side.all():
        able &= side[:, None] != side[None, :]
    need = threshold / (1 + threshold) * (most + least) - 1e-6
    return (able & (in_common(prefixes) + np.ceil(threshold * most - 1e-6) - 1 >= need)).any(axis=1)


def similar_links(members: list[tuple[int, np.ndarray]], side: np.ndarray, threshold: float, roots: list | None = None) -> list[tuple[int, int]]:
    """Links between (node, sorted shingle hashes) with the closure of all pairs
    of a Jaccard similarity of ``threshold`` or more.

    Every pair's shingles in common are counted. ``side`` tells two blocks
    apart: pairs within one of two blocks are another group's. Of ``roots``,
    what the nodes are joined to already, only links between different ones are given.
    """
    m = len(members)
    sizes = np.array([len(s) for _, s in members])
    same = in_common([s for _, s in members])
    near = same >= threshold * (sizes[:, None] + sizes[None, :] - same)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    label = np.unique(np.arange(m) if roots is None else np.array(roots), return_inverse=True)[1]
    out = []
    while True:
        # Each piece takes one link to another piece, until there is none.
        across = near & (label[:, None] != label[None, :])
        able = np.flatnonzero(across.any(axis=1))
        if not len(able):
            return out
        root = list(range(int(label.max()) + 1))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        _, first = np.unique(label[able], return_index=True)
        for i in able[first].tolist():
            j = int(across[i].argmax())
            x, y = find(int(label[i])), find(int(label[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((members[i][0], members[j][0]))
        label = np.array([find(i) for i in range(len(root))])[label]


def _global_order(h: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places that sort distinct shingle hashes: rare ones first, by a mixed hash; one order for all texts."""
    keys, level = common
    rank = np.zeros(len(h), np.uint8)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        rank = np.where(keys[at] == h, level[at], 0)
    return np.lexsort((mix(h), rank))


def prefix_size(n: int, threshold: float) -> int:
    """How many first shingles of a set of ``n`` surely hold one of any similar set's (prefix filter)."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def common_shingles(docs: DataFrame, text_col: str, shingle: int, texts: int = SAMPLE, most: int = MAX_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and levels (log2 of the count) of shingles that several of a
    sample of about ``texts`` texts have, at most ``most``.

    They only say which shingles come last in the order that the prefixes are
    taken by: any order gives the same links, this one at less cost."""
    parts = 1 << 30
    share = math.ceil(parts * min(1.0, texts / max(1, docs.count())))
    some = docs.where(F.pmod(F.xxhash64(F.lit("common"), text_col), F.lit(parts)) < share).select(F.col(text_col).alias("__text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                for h in shingle_hashes(split_words(t.as_py()), shingle):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(h.astype(np.uint64)).view(np.int64))], names=["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").count().where("count > 2")
    rows = counts.orderBy(F.desc("count"), "h").limit(most).toArrow()
    h = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log2(rows["count"].to_numpy().astype(float)).astype(np.uint8)[order]


def prefix_features(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float, common) -> DataFrame:
    """``id_col``, ``node`` (a hash of the words; null without any), ``fp``
    (SimHash), ``n`` (distinct shingles) and ``keys``, the first of them in the
    global order, as many as similar texts surely share one of."""
    src = docs.select(id_col, F.col(text_col).alias("__text"))
    names = [id_col, "node", "fp", "n", "keys"]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, t) for c, t in zip(names[1:], (T.LongType(), T.LongType(), T.IntegerType(), T.ArrayType(T.LongType()))))])
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def one(text: str | None):
        words = split_words(text)
        if not words:
            return None, None, 0, []
        blocks = list(shingle_hashes(words, shingle))
        h = np.unique(np.concatenate([x.astype(np.uint64) for x in blocks]))
        keys = h[_global_order(h, shared.value)[: prefix_size(len(h), threshold)]]
        return _signed(xxhash.xxh3_64_intdigest(b" ".join(words))), _signed(simhash(iter(blocks))), len(h), keys.view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t.as_py()) for t in b.column(1)]
            cols = list(zip(*got)) if got else [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=names)

    return src.mapInArrow(run, schema)


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], np.ndarray]]:
    """The rows of each (class, bi, bj), as lists, and which side they are on."""

    def each() -> Iterator[list]:
        for b in batches:
            at = b.schema.names.index("s")
            # Copies, as the batch would stay in memory otherwise.
            sets = [b.column(at)[i].values.to_numpy().copy() for i in range(b.num_rows)]
            yield from map(list, zip(*(sets if k == at else b.column(k).to_pylist() for k in range(b.num_columns))))

    for (_, bi, _), rows in itertools.groupby(each(), key=lambda r: r[:3]):
        group = list(rows)
        yield group, np.array([r[3] != bi for r in group])


def _by_class(rows: DataFrame) -> DataFrame:
    """``rows`` with those of a (class, block pair) together."""
    return rows.repartition(partitions(rows.sparkSession), "class", "bi", "bj").sortWithinPartitions("class", "bi", "bj")


def _class_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links within each (class, block pair) of ``rows``: class, bi, bj, own (a
    node's block), node, root (what it is joined to already), s (its shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side in _group_rows(batches):
            found = similar_links([(r[4], r[6]) for r in group], side, threshold, [r[5] for r in group]) if len(group) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], names=["a", "b"])

    return _by_class(rows).select("class", "bi", "bj", "own", "node", "root", "s").mapInArrow(run, "a long, b long")


def _hopeful(rest: DataFrame, lists: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """The rows of ``rest`` that a node of another piece of their class may be similar to, by ``lists``, the shared
    shingles of their prefixes. Blocks of these are a small part of the blocks of whole sets that the others would need."""
    rows = _blocks(rest, lists.select("node", "n", F.col("keys").alias("s")), tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, side in _group_rows(batches):
            able = with_partner([r[6] for r in group], np.array([r[7] for r in group], float), side, [r[5] for r in group], threshold)
            kept = [r for r, x in zip(group, able.tolist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.int64()) for i in (0, 4, 5)], names=["class", "node", "root"])

    dealt = _by_class(rows).select("class", "bi", "bj", "own", "node", "root", "s", "n")
    return cut(dealt.mapInArrow(run, "class long, node long, root long").distinct(), tasks)


def _shingle_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, once: bool, tasks: int) -> DataFrame:
    """``node`` and ``s``, its text's shingles, for ``wanted``: ``id_col`` and node, one id a node.
    ``once``: no id has several rows."""
    wanted = cut(wanted, tasks)
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(wanted, F.col("__id") == F.col(id_col)).select("node", "__text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [split_words(t.as_py()) for t in b.column(1)]
            # Rows of one id may have other texts, of other nodes.
            keep = [i for i, w in enumerate(words) if w and _signed(xxhash.xxh3_64_intdigest(b" ".join(w))) == b.column(0)[i].as_py()]
            # 32 bits of a hash: within one pair of texts they tell shingles apart.
            out = [np.unique(np.concatenate([(x.astype(np.uint64) >> np.uint64(32)).astype(np.int64) for x in shingle_hashes(words[i], shingle)])) for i in keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([(x - (1 << 31)).astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["node", "s"])

    found = texts.mapInArrow(sets, "node long, s array<int>")
    return _written(found if once else found.groupBy("node").agg(F.first("s").alias("s")), "near-sets")


def _verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links whose texts' shingle sets have a Jaccard similarity of ``threshold`` or more."""
    first = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = salted_join(salted_join(links, second, "b"), first, "a")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(same >= F.lit(threshold) * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def _plausible(pairs: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose prefixes, of which ``lists`` has all that texts share, have enough shingles in common: beyond them, no
    more can be than the longer rest of a set behind its prefix."""
    end = lambda c: lists.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"), F.col("n").alias(f"n_{c}"))
    both = salted_join(salted_join(pairs, end("b"), "b"), end("a"), "a")
    rest = F.ceil(F.lit(threshold) * F.greatest("n_a", "n_b") - F.lit(1e-6)) - 1
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-6)
    return both.where(F.size(F.array_intersect("keys_a", "keys_b")) + rest >= need).select("a", "b")


def _possible(n: str, at: str, other_n: str, other_at: str, threshold: float):
    """Whether sets of ``n`` and ``other_n`` whose first common member is at these places of the order may be similar."""
    need = F.lit(threshold / (1 + threshold)) * (F.col(n) + F.col(other_n)) - F.lit(1e-6)
    return F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at)) >= need


def _tasks(features: DataFrame) -> int:
    """How many tasks the documents need, by their number and by their shingles. Every table between the steps of
    ``near_groups`` grows with these; the rows dealt to pairs of blocks, that may grow faster, keep the session's partitions."""
    docs, shingles = features.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    return max(1, -(-docs // DOCS_PER_TASK), -(-shingles // SHINGLES_PER_TASK))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``id_col`` and ``group_id``, the least id of the documents that are
    reached by links of similarity ``threshold`` or more. Only groups of two or
    more documents have rows.

    Texts of equal words are one node. Candidates come from two sources. Texts
    whose SimHashes are within two bits meet by their Golay keys. As most
    similar texts' fingerprints are farther apart, texts also meet in the
    classes of their first shingles in one global order, rare ones first
    (prefix filter): similar texts surely share such a class, so that no link is
    lost, whatever the texts' lengths. Candidates that the places of the shared
    shingle rule out are dropped; all others are verified on whole shingle sets.

    In a class of up to ``SMALL`` all are compared. In a larger one each node is
    first compared with one node, which is linear and joins most of a family.
    Where such a class is in several pieces still, classes of mostly the same nodes are taken as one, and the nodes
    outside its largest piece are compared with all its nodes, in pairs of
    blocks of ``BLOCK``: first by their shared first shingles, which rule most
    nodes out, and what is left by whole sets.
    """
    spark = docs.sparkSession
    whole = docs.where(F.col(id_col).isNotNull())
    features = _written(prefix_features(whole, id_col, text_col, shingle, threshold, common_shingles(whole, text_col, shingle)), "near-features").where("node is not null")
    ids = features.select("node", id_col)
    tasks = _tasks(features)
    nodes = _written(
        features.groupBy("node").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "near-nodes",
        tasks,
    )
    # SimHash: nodes of one fingerprint meet at the least of them, and these meet by Golay keys.
    least_of = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("m")), tasks)
    equal = salted_join(nodes.select("fp", "node"), least_of.where("m > 1").select("fp", "least"), "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    end = lambda c: least_of.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}"))
    golay_links = hamming_links(least_of, tasks=tasks).join(end("a"), "a").join(end("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # Classes of first shingles: those of one node, by far the most, go while the rows are together.
    index = F.col("at") <= F.col("n") - F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("n") - F.lit(1e-6))
    rows = nodes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    by_key = Window.partitionBy("key")
    rows = rows.withColumn("size", F.count("*").over(by_key)).withColumn("any", F.max(index).over(by_key))
    shared = _written(rows.where("size > 1").select("key", "node", "n", "at", "any", index.alias("index")), "near-rows", tasks)
    # A class needs a node that may be the smaller one of a pair.
    rows = shared.where("any").drop("any")
    stats = rows.groupBy("key").agg(
        F.count("*").alias("size"), F.min(F.struct(~F.col("index"), F.xxhash64("node", "key"), "node", "n", "at")).alias("rep"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.col("at").cast("long")).alias("places"),
    )
    # Of classes with the same nodes the first in the order is enough.
    stats = cut(stats.groupBy("size", "x", "y", "lo", "hi").agg(F.min_by(F.struct("key", "rep"), F.struct("places", "key")).alias("k")).select("k.key", "size", "k.rep"), tasks)
    live = _written(salted_join(rows, stats, "key", counts=stats.select("key", F.col("size").alias("__n"))).select(
        "key", "node", "n", "at", "size", F.col("rep.node").alias("rep"), F.col("rep.n").alias("rep_n"), F.col("rep.at").alias("rep_at")
    ), "near-classes", tasks)
    star = live.where((F.col("size") > SMALL) & (F.col("node") != F.col("rep"))).where(_possible("n", "at", "rep_n", "rep_at", threshold)).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    few = live.where(F.col("size") <= SMALL)
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    all_of_few = few.join(other, "key").where(F.col("node") < F.col("b")).where(_possible("n", "at", "b_n", "b_at", threshold)).select(F.col("node").alias("a"), "b")
    candidates = cut(equal.union(golay_links).union(star).union(all_of_few).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tasks)
    lists = cut(shared.groupBy("node").agg(F.collect_list("key").alias("keys"), F.first("n").alias("n")), tasks)
    candidates = cut(_plausible(candidates, lists, threshold), tasks)
    once = features.groupBy(id_col).count().where("count > 1").isEmpty()
    sets_of = lambda some: _shingle_sets(nodes.select("node", id_col).join(some.distinct(), "node"), docs, id_col, text_col, shingle, once, tasks)
    good = cut(_verified(candidates, sets_of(candidates.select(F.explode(F.array("a", "b")).alias("node"))), threshold), tasks)
    roots = cut(components(good, tasks=tasks), tasks)
    rest = _unsettled(live, roots, tasks)
    rest = rest if rest.isEmpty() else _hopeful(rest, lists, threshold, tasks)
    if not rest.isEmpty():
        more = cut(_class_links(_blocks(rest, sets_of(rest.select("node")), tasks), threshold).distinct(), tasks)
        roots = cut(components(good.union(more), tasks=tasks), tasks)
    named = nodes.select("node", F.col(id_col).alias("first"), "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("group_id"), F.sum("copies").alias("members")).where("members > 1").select("root", "group_id")
    known = cut(salted_join(named.select("node", "root"), least, "root").select("node", "group_id"), tasks)
    return salted_join(ids, known, "node").select(id_col, "group_id").coalesce(tasks)


def _written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """The rows, from a table in the shared folder; ``tasks`` as for ``cut``."""
    path = scratch_path(df.sparkSession, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _unsettled(live: DataFrame, roots: DataFrame, tasks: int) -> DataFrame:
    """``class``, ``node`` and ``root`` of the classes that links have not made
    one piece, those of mostly the same nodes as one class."""
    # All pairs of the small classes were compared.
    placed = cut(live.where(F.col("size") > SMALL).join(roots, "node", "left").select("key", "node", "at", "size", F.coalesce("root", "node").alias("root")), tasks)
    pieces = placed.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p != q").select("key")
    open_rows = cut(salted_join(placed, pieces, "key"), tasks)
    # Neighbours in their nodes' order are the classes that may have the same nodes.
    following = open_rows.withColumn("next", F.lead(F.struct("key", "size")).over(Window.partitionBy("node").orderBy("at"))).where("next is not null")
    alike = following.groupBy("key", "size", "next").agg(F.count("*").alias("both")).where("2 * both >= size and 2 * both >= next.size").select(F.col("key").alias("a"), F.col("next.key").alias("b"))
    joined = components(alike, tasks=tasks).select(F.col("node").alias("key"), F.col("root").alias("class"))
    named = salted_join(open_rows, pieces.join(joined, "key", "left").select("key", F.coalesce("class", "key").alias("class")), "key")
    return cut(named.select("class", "node", "root").distinct(), tasks)


def _blocks(rest: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """``rest`` with ``s`` and all else of ``sets``, a row for each pair of blocks (``bi``, ``bj``) of a
    class that a node is compared in: all but its largest piece with all nodes."""
    by_piece = cut(rest.groupBy("class", "root").agg(F.count("*").alias("m")), tasks)
    largest = by_piece.groupBy("class").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m"))
    sized = salted_join(rest, sets.select("node", F.size("s").alias("w")), "node")
    weight = sized.groupBy("class").agg(F.avg("w").alias("w"))
    info = largest.join(weight, "class").withColumn("per", F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK * BLOCK_SHINGLES)) / F.col("w"))))
    info = cut(info.select("class", F.col("top.root").alias("top"), F.ceil((F.col("m") - F.col("top.m")) / F.col("per")).cast("int").alias("outer"), F.ceil(F.col("top.m") / F.col("per")).cast("int").alias("inner")), tasks)
    placed = salted_join(rest, info, "class")
    is_top = F.col("root") == F.col("top")
    own = F.when(is_top, F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))).cast("int")
    others = F.when(is_top, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    pairs = placed.select("class", "node", "root", own.alias("own"), others.alias("others")).join(sets, "node")
    columns = ["class", "root", *sets.columns, "own"]
    return pairs.select(*columns, F.explode("others").alias("other")).select(*columns, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``, the one
    with the least id (of several rows with it, one that is whole)."""
    groups = cut(near_groups(docs, id_col, text_col, shingle, threshold))
    gone = groups.where(F.col(id_col) != F.col("group_id")).select(id_col).distinct()
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    kept = docs.join(gone, id_col, "left_anti")
    twice = cut(docs.groupBy(id_col).count().where(F.col(id_col).isNotNull() & (F.col("count") > 1)).select(id_col), max(1, -(-docs.count() // DOCS_PER_TASK)))
    if twice.isEmpty():
        return kept
    return kept.join(twice, id_col, "left_anti").unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col, text_col]))


def hex16(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole document."""
    docs = table(spark, sf_dir, "documents")
    return simhash_groups(docs).select("doc_id", hex16().alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_golay": op2_simhash_golay}
ORACLE_SQL: dict[str, str] = {}
