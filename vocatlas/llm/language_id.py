"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text answers longest-match
queries. A text is parsed, left to right, into the longest phrases that occur
in a language's labelled text; the number of phrases, each costing the log of
that text's length, estimates the cross entropy between the text and the
language (Ziv and Merhav, 1993). The language with the least cost wins.

The automata are made on the driver from a bounded sample: the labelled texts
are cut into pieces of ``PIECE`` characters, and of each language's distinct
pieces ``PIECES_PER_LANG`` are chosen by hash, ``PIECES`` in all if the languages
are many. Letters are lower-cased, all else is one space, and a symbol is a byte
of UTF-8, so that no script lacks letters and an automaton's rows have 256
entries at most. States with one transition, most of them, hold just that.
Every language that labels a text is learned. Texts are parsed whole: blocks of
``BLOCK`` bytes are parsed at once, each as if a phrase began there, and then
again from where the block before it ends until both parses agree, so that the
phrases are those of one parse from the text's start.

Defined results: a null, empty or letterless text is ``und`` with score 0;
where no labelled text exists every text is ``und`` with score 0; equal costs
go to the first language in alphabetical order. Repeated rows are judged each.
Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatlas.llm.base import id_crc, small_batches, table

PIECE = 256
PIECES_PER_LANG = 512
PIECES = 4_096
BLOCK = 2048
#: Characters, times languages, that a worker parses at once; bounds its memory.
CHARS_AT_ONCE = 4_000_000
def sample(docs: DataFrame, pieces_per_lang: int = PIECES_PER_LANG, chars: int = PIECE, pieces: int = PIECES) -> list[tuple[str, str]]:
    """A bounded sample of (lang, piece of a text) from rows with both.

    Every ``chars`` characters of every text are a piece. Per language the pieces
    are dealt to ``pieces_per_lang`` cells by hash and each cell gives the one
    with the least hash, so that copies count once, only numbers are shuffled
    and no task holds more than a row a cell. Pieces are in order of hash.
    """
    good = docs.where("lang is not null and text is not null").select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))).alias("piece"))
    good = good.withColumn("h", F.xxhash64(F.lit("sample"), "piece")).withColumn("cell", F.pmod("h", F.lit(pieces_per_lang)))
    least: dict[str, list[int]] = {}
    for r in good.groupBy("lang", "cell").agg(F.min("h").alias("h")).collect():
        least.setdefault(r.lang, []).append(r.h)
    if not least:
        return []
    share = max(1, pieces // len(least))
    chosen = [(lang, h) for lang, hs in sorted(least.items()) for h in sorted(hs)[:share]]
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, h long")
    rows = good.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("piece").alias("piece")).collect()
    return [(r.lang, r.piece) for r in sorted(rows, key=lambda r: (r.lang, r.h))]


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str | None) -> bytes:
    """Lower-case letters in UTF-8, one space for anything between or after them and none before."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    good = _is_letter()[points]
    kept = good.copy()
    kept[1:] |= good[:-1]
    return np.where(good, points, 32)[kept].astype(np.uint32).tobytes().decode("utf-32-le").encode()


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``seq``; state 0 is the root."""
    link, length, nxt, last = [-1], [0], [{}], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def transitions(seq: list[int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of ``seq`` as arrays: states; state, symbol and next state by transition."""
    nxt = suffix_automaton(seq)
    size = np.fromiter(map(len, nxt), np.int64, len(nxt))
    n = int(size.sum())
    symbol = np.fromiter((c for out in nxt for c in out), np.int16, n)
    to = np.fromiter((x for out in nxt for x in out.values()), np.int32, n)
    return len(nxt), np.repeat(np.arange(len(nxt)), size), symbol, to


class Model:
    """The stacked automata of all languages.

    States of one transition go by ``symbol[s]`` to ``only[s]``; the others are
    numbered first and have a row of ``table``. Values are ``2 * next + begins``:
    whether a phrase begins with the symbol. Where a state lacks it, the phrase
    has ended, and the next begins as the language's row after the states' rows
    says; a symbol that the language lacks is a phrase of its own.
    """

    def __init__(self, texts: list[tuple[str, str]]):
        by_lang: dict[str, list[str]] = {}
        for lang, text in texts:
            by_lang.setdefault(lang, []).append(text)
        train = {lang: letters(" ".join(by_lang[lang])) for lang in sorted(by_lang)}
        self.langs = list(train)
        used = sorted(set().union(*train.values())) if train else []
        self.width = len(used) + 1  # the last symbol is any byte that no sample has
        self.code = np.full(256, len(used), np.int16)
        self.code[used] = np.arange(len(used))
        self.bits = [float(np.log2(max(2, len(text)))) for text in train.values()]
        # By language: states, and the state, symbol and next state of each transition.
        automata = [transitions(self.code[np.frombuffer(text, np.uint8)].tolist()) for text in train.values()]
        # Roots count as states of several transitions.
        wide = []
        for n, frm, _, _ in automata:
            several = np.bincount(frm, minlength=n) > 1
            several[0] = True
            wide.append(several)
        self.rows = sum(int(w.sum()) for w in wide)
        total = sum(map(len, wide))
        self.roots = np.zeros(len(train), np.int32)
        self.symbol, self.only = np.full(total, -1, np.int16), np.zeros(total, np.int32)
        self.table = np.empty((self.rows + len(train), self.width), np.int32)
        row, one = 0, self.rows
        for k, (w, (_, frm, symbol, to)) in enumerate(zip(wide, automata)):
            rows = int(w.sum())
            number = np.empty(len(w), np.int64)
            number[w] = row + np.arange(rows)
            number[~w] = one + np.arange(len(w) - rows)
            self.roots[k] = number[0]
            begins = np.full(self.width, 2 * number[0] + 1, np.int32)
            begins[symbol[frm == 0]] = 2 * number[to[frm == 0]] + 1
            self.table[self.rows + k] = begins
            self.table[row : row + rows] = begins
            inner = w[frm] & (frm != 0)
            self.table[number[frm[inner]], symbol[inner]] = 2 * number[to[inner]]
            alone = ~w[frm]
            self.symbol[number[frm[alone]]], self.only[number[frm[alone]]] = symbol[alone], 2 * number[to[alone]]
            row, one = row + rows, one + len(w) - rows
        self.table = self.table.ravel()


class Parser:
    """Counts phrases in batches of texts; one per worker."""

    def __init__(self, model: Model):
        self.m = model

    def _step(self, state: np.ndarray, c: np.ndarray, miss: np.ndarray) -> np.ndarray:
        m = self.m
        row = np.where(state < m.rows, state, miss)
        row *= m.width
        row += c
        to = m.table.take(row, mode="clip")
        np.copyto(to, m.only.take(state, mode="clip"), where=m.symbol.take(state, mode="clip") == c)
        return to

    def _beyond(self, codes: np.ndarray, pos: np.ndarray, end: np.ndarray, state: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """Where the next phrase begins, from ``pos`` and ``state`` on; the text's end if none does."""
        pos, of = pos.copy(), np.flatnonzero(pos < end)
        state, miss = state[of], miss[of]
        while len(of):
            to = self._step(state, codes[pos[of]], miss)
            on = (to & 1) == 0
            of, state, miss = of[on], to[on] >> 1, miss[on]
            pos[of] += 1
            inside = pos[of] < end[of]
            of, state, miss = of[inside], state[inside], miss[inside]
        return pos

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language; whether each text has a letter."""
        m, n, k = self.m, len(texts), len(self.m.langs)
        data = [letters(t) for t in texts]
        size = np.fromiter(map(len, data), np.int64, n)
        total = np.zeros((n, k), np.int64)
        if not size.sum() or not k:
            return total, size > 0
        codes = m.code[np.frombuffer(b"".join(data), np.uint8)]
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(n), blocks)
        nb = len(text)
        nth = np.arange(nb) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin, end = (np.cumsum(size) - size)[text] + nth * BLOCK, np.cumsum(size)[text]
        length = np.minimum(BLOCK, end - begin)
        # Each block as if a phrase began there: ``begins`` says where phrases begin, by place in the block, language and block.
        order = np.argsort(-length, kind="stable")
        alive = np.searchsorted(-length[order], -np.arange(1, int(length.max()) + 1), side="right")
        begins = np.zeros((len(alive), k, nb), np.uint8)
        state = np.repeat(m.roots[:, None], nb, axis=1)
        miss = np.repeat((m.rows + np.arange(k, dtype=np.int32))[:, None], nb, axis=1)
        at = begin[order]
        for i, a in enumerate(alive.tolist()):
            to = self._step(state[:, :a], codes[at[:a] + i].astype(np.int32), miss[:, :a])
            begins[i, :, :a] = to & 1
            state[:, :a] = to >> 1
        items = nb * k
        back = np.empty(nb, np.int64)
        back[order] = np.arange(nb)
        begins = begins[:, :, back].reshape(len(alive), items)
        block = np.tile(np.arange(nb), k)
        miss = miss.ravel()
        state = state[:, back]
        begin, end, length = begin[block], end[block], length[block]
        # Where the parse of a block leaves off, and so that of the next has to begin.
        left = self._beyond(codes, begin + length, end, state.ravel(), miss)
        later = np.flatnonzero(nth[block] > 0)
        entry = begin.copy()
        while True:
            wrong = later[entry[later] != left[later - 1]]
            if not len(wrong):
                break
            entry[wrong] = left[wrong - 1]
            self._again(codes, begins, begin, end, length, left, miss, wrong, entry[wrong])
        counts = begins.sum(axis=0, dtype=np.int64)
        np.add.at(total, (text[block], np.repeat(np.arange(k), nb)), counts)
        return total, size > 0

    def _again(self, codes, begins, begin, end, length, left, miss, of, entry) -> None:
        """Parse blocks ``of`` anew from ``entry`` to where a phrase begins that their last parse began too."""
        m = self.m
        place = np.minimum(entry - begin[of], length[of])
        for i in range(int(place.max())):
            begins[i, of[place > i]] = 0
        state = m.roots[miss[of] - m.rows]
        while len(of):
            over = place >= length[of]
            if over.any():
                # Not met within the block, or a phrase that began before it goes on beyond it.
                o, p = of[over], np.maximum(begin[of[over]] + place[over], entry[over])
                left[o] = self._beyond(codes, p, end[o], state[over], miss[o])
                of, place, state, entry = of[~over], place[~over], state[~over], entry[~over]
                if not len(of):
                    return
            to = self._step(state, codes[begin[of] + place].astype(np.int32), miss[of])
            now = (to & 1).astype(np.uint8)
            met = (now & begins[place, of]) == 1
            begins[place, of] = now
            on = ~met
            of, place, state, entry = of[on], place[on] + 1, to[on] >> 1, entry[on]

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.m.langs:
            return ["und"] * n, np.zeros(n)
        count, has_letters = self.phrases(texts)
        cost = count * np.array(self.m.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(n), best]
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(np.clip(least[:, None] - cost, -1000, 0)).sum(axis=1)
        return [self.m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), has_letters.tolist())], np.where(has_letters, score, 0.0)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns, lang_pred and score (0 to 1: the
    winner's share when each language's cost in bits is read as a likelihood).
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    cols = [id_col, *carry]
    src = docs.select(*cols, F.col(text_col).alias("__text"))
    schema = docs.select(*cols).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        most = CHARS_AT_ONCE // max(1, len(shared.value.langs))
        for b in batches:
            texts = ["" if t is None else t for t in b.column(b.num_columns - 1).to_pylist()]
            lang: list[str] = []
            score: list[np.ndarray] = []
            i = 0
            while i < len(texts):
                j, chars = i, 0
                while j < len(texts) and (j == i or chars + len(texts[j]) <= most):
                    chars += len(texts[j])
                    j += 1
                got = parser.judge(texts[i:j])
                lang += got[0]
                score.append(got[1])
                i = j
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())],
                names=[*cols, "lang_pred", "score"],
            )

    return src.mapInArrow(run, schema)


def fit(docs: DataFrame) -> Model:
    return Model(sample(docs))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's language, learned from rows whose id's crc32 mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1, F.lit(False))
    model = fit(docs.where(~held))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
