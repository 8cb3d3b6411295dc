"""Benchmark decontamination: rare word n-grams seed passages, Smith-Waterman alignment scores them.

Two passes over the documents, neither of which shuffles a text. The first counts in how many documents
each seed (word 3-gram of a test item) stands. Each item keeps the rarer part of its seeds, relative to
its own others, so a passage that leaked into a third of all documents still has seeds. The second finds
kept seeds, places windows around them by diagonal and aligns item and window word by word. Items of fewer than
``MIN_WORDS`` words have too few seeds for that: they are looked up word for word.

The seeds and postings of the test items are dealt out in blocks of at most ``BLOCK_BYTES`` characters, each broadcast: that
is the side whose size is checked, and a larger test set costs a pass over the texts for each further block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

GRAM = 3
MIN_WORDS = 5
RARE_SHARE = 0.75
MIN_SEEDS = 24
MIN_SCORE = 0.5
BLOCK_BYTES = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64).view(np.int64)
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-id sequences: (score, first and end word in the window)."""
    m, n = len(item), len(window)
    slope = GAP * np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)
    best = (0, 0, 0)
    for i in range(m):
        s = np.where(window == item[i], MATCH, MISMATCH)
        t, at = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diag, up = h[:-1] + s, h - GAP
        take = diag > 0
        t[1:][take], at[1:][take] = diag[take], start[:-1][take]
        take = up > t
        t[take], at[take] = up[take], start[take]
        run = t + slope
        top = np.maximum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        h, start = top - slope, at[source]
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(start[j]), j)
    return best


class Items:
    """One block of test items: vocabulary, seeds, and the postings of each seed."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        texts: dict[tuple[str, ...], list[int | None]] = {}
        short: dict[tuple[str, ...], list[int | None]] = {}
        for name, text in rows:
            w = tuple(words_of(text))
            if w:
                (texts if len(w) >= MIN_WORDS else short).setdefault(w, []).append(name)
        self.names = [*texts.values(), *short.values()]
        self.vocab: dict[str, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in t], np.int64) for t in texts]
        self.short: dict[int, list[tuple[int, np.ndarray]]] = {}  # by its first word: (number, words)
        for k, t in enumerate(short, len(texts)):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in t], np.int64)
            self.short.setdefault(int(ids[0]), []).append((k, ids))
        self.heads = np.array(sorted(self.short), np.int64)
        codes = [self.codes(w) for w in self.words]
        self.seeds = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        seed = np.searchsorted(self.seeds, np.concatenate(codes)) if codes else np.empty(0, np.int64)
        self._post(seed, item, place)

    def _post(self, seed: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(seed, kind="stable")
        self.seed, self.item, self.place = seed[order], item[order], place[order]
        self.first = np.searchsorted(self.seed, np.arange(len(self.seeds) + 1))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the 3-grams; should two ever share one, the seed is tried in vain at worst, as alignment decides."""
        return (ids[:-2] * _MIX[0] ^ ids[1:-1] * _MIX[1]) * _MIX[2] + ids[2:]

    def keep_rare(self, df: np.ndarray) -> None:
        """Drop from each item its more frequent seeds; ties stay."""
        good = np.zeros(len(self.seed), bool)
        order = np.lexsort((df[self.seed], self.item))
        cuts = np.searchsorted(self.item[order], np.arange(len(self.words) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = order[a:b]
            n = min(len(part), max(MIN_SEEDS, int(np.ceil(RARE_SHARE * len(part)))))
            good[part[df[self.seed[part]] <= df[self.seed[part[n - 1]]]]] = True
        self._post(self.seed[good], self.item[good], self.place[good])

    def hits(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of a text, and places and seed numbers of the seeds in it."""
        w = words_of(text)
        ids = np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w))
        if len(ids) < GRAM or not len(self.seeds):
            return ids, np.empty(0, np.int64), np.empty(0, np.int64)
        known = ids > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        code = (ids[at] * _MIX[0] ^ ids[at + 1] * _MIX[1]) * _MIX[2] + ids[at + 2]
        k = np.searchsorted(self.seeds, code)
        k[k == len(self.seeds)] = 0
        ok = self.seeds[k] == code
        return ids, at[ok], k[ok]

    def leaks(self, text: str | None, min_score: float) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, end word, seeds) of each item that a text holds."""
        ids, at, seed = self.hits(text)
        verbatim = self._verbatim(ids)
        if not len(at):
            return verbatim
        n = self.first[seed + 1] - self.first[seed]
        if not n.sum():
            return verbatim
        post = np.repeat(self.first[seed] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, place, where, which = self.item[post], self.place[post], np.repeat(at, n), np.repeat(seed, n)
        diag = where - place
        order = np.lexsort((diag, item))
        item, diag, which = item[order], diag[order], which[order]
        out: dict[int, tuple[int, float, int, int, int]] = {}
        sizes = np.array([len(w) for w in self.words])
        slack = np.maximum(4, sizes // 4)
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (diag[1:] - diag[:-1] > slack[item[1:]])))
        edges = np.append(np.flatnonzero(new), len(item))
        for a, b in zip(edges[:-1], edges[1:]):
            k = int(item[a])
            m, found = int(sizes[k]), len(set(which[a:b].tolist()))
            lo = max(0, int(diag[a]) - int(slack[k]))
            window = ids[lo : int(diag[b - 1]) + m + int(slack[k])]
            # no alignment scores more than its matches, and a word matches no more often than it stands in both
            if found < 3 and self._shared(k, window) < min_score * m:
                continue
            score, s, e = align(self.words[k], window)
            got = (k, score / (MATCH * m), lo + s, lo + e, found)
            if got[1] >= min_score and (k not in out or got[1] > out[k][1]):
                out[k] = got
        return [*out.values(), *verbatim]

    def _shared(self, item: int, window: np.ndarray) -> int:
        """How many words an item and a window have in common, each as often as it stands in both."""
        words, n = np.unique(self.words[item], return_counts=True)
        at = np.searchsorted(words, window)
        at[at == len(words)] = 0
        there = np.bincount(at[words[at] == window], minlength=len(words))
        return int(np.minimum(n, there).sum())

    def _verbatim(self, ids: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """The short items that stand in a text word for word, each at its first place."""
        if not len(self.heads) or not len(ids):
            return []
        out: dict[int, tuple[int, float, int, int, int]] = {}
        for at in np.flatnonzero(np.isin(ids, self.heads)).tolist():
            for k, words in self.short[int(ids[at])]:
                if k not in out and at + len(words) <= len(ids) and (ids[at : at + len(words)] == words).all():
                    out[k] = (k, 1.0, at, at + len(words), 0)
        return list(out.values())


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most ``BLOCK_BYTES`` characters (or one item that is longer)."""
    part, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        if part and size + len(r.t) > BLOCK_BYTES:
            yield part
            part, size = [], 0
        part.append((r.i, r.t))
        size += len(r.t)
    if part:
        yield part


def _prepared(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str) -> list:
    """A broadcast ``Items`` with its rare seeds for each block of the test set."""
    bounded_batches(docs.sparkSession)
    out = []
    for rows in _blocks(items, item_id, item_text):
        block = Items(rows)
        if not block.names:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def count(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            b = shared.value
            df = np.zeros(len(b.seeds), np.int64)
            for pdf in frames:
                for t in pdf["t"].tolist():
                    df[np.unique(b.hits(t)[2])] += 1
            seen = np.flatnonzero(df)
            yield pd.DataFrame({"seed": seen, "n": df[seen]})

        got = docs.select(F.col(text_col).alias("t")).mapInPandas(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        df = np.zeros(len(block.seeds), np.int64)
        df[got["seed"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        block.keep_rare(df)
        out.append(docs.sparkSession.sparkContext.broadcast(block))
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_score: float = MIN_SCORE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word, n_seeds)`` for each document row and item it holds.

    ``score`` is the best local alignment's share of the item's own, 0 to 1; words are runs of word
    characters, lower-cased. Null and empty texts hold nothing, and so do items without a word. Items of fewer than ``MIN_WORDS`` words
    are found word for word alone (score 1, no seeds, the first place). Equal items are each reported, repeated rows stay repeated,
    null ids keep their rows. Of equally good alignments the first in the text is given. Only the named columns are read.
    """
    prepared = _prepared(docs, items, text_col, item_id, item_text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, text in zip(pdf["doc_id"].tolist(), pdf["t"].tolist()):
                for shared in prepared:
                    b = shared.value
                    for k, score, s, e, n in b.leaks(text, min_score):
                        rows += [(None if pd.isna(name) else int(name), i, score, s, e, n) for i in b.names[k]]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64", "score": "float64", "start_word": "int64", "end_word": "int64", "n_seeds": "int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return picked.mapInPandas(run, "doc_id long, item_id long, score double, start_word long, end_word long, n_seeds long")


def drop_leaks(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all their columns) that hold no item; no shuffle and no join."""
    prepared = _prepared(docs, items, text_col, item_id, item_text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            clean = [not any(shared.value.leaks(t, min_score) for shared in prepared) for t in pdf[text_col].tolist()]
            yield pdf[clean]

    return docs.mapInPandas(run, docs.schema)
