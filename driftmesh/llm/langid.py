"""Language identification: a linear-chain CRF labels each word, forward-backward gives the shares.

Word features are affixes, character n-grams and the word itself (the lexicon), hashed into one table.
Transitions are learned from chains that switch between texts of several languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .crf import emissions, forward_backward, hashed, train

BUCKETS = 1 << 16
SAMPLE_DOCS = 150  # expected labelled documents a language
CACHE_WORDS = 100_000
BLOCK_CHARS = 700_000  # of texts that are scored together
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and other word characters, lower-cased, that hold a letter."""
    return [w for w in _WORDS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def word_features(word: str) -> list[int]:
    w = f"<{word}>"
    names = ["=" + word]
    names += ["p" + w[:n] for n in (2, 3, 4)] + ["s" + w[-n:] for n in (2, 3, 4)]
    names += ["c" + c for c in set(word)]
    names += [w[i : i + 2] for i in range(len(w) - 1)]
    names += [w[i : i + 3] for i in range(len(w) - 2)]
    return hashed(names, BUCKETS)


class LangModel:
    """Learned languages, emission weights and transitions; scores whole texts."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights.astype(np.float32), trans

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], seed: int = 11) -> LangModel:
        """From (language, text) pairs; chains of 120 words switch language every 5 to 40 words."""
        langs = sorted({lang for lang, _ in rows})
        if len(langs) < 2:
            return cls(langs, np.zeros((BUCKETS, max(1, len(langs)))), np.zeros((max(1, len(langs)),) * 2))
        rng = np.random.default_rng(seed)
        pools: dict[int, list[str]] = {k: [] for k in range(len(langs))}
        for lang, text in rows:
            pools[langs.index(lang)] += words_of(text)
        pools = {k: p for k, p in pools.items() if p}
        seen: dict[str, list[int]] = {}
        chains, tags = [], []
        total = sum(map(len, pools.values()))
        at = dict.fromkeys(pools, 0)
        for _ in range(total // 120 + 1):
            f, g = [], []
            while len(f) < 120:
                k = int(rng.choice(list(pools)))
                n = int(rng.integers(5, 41)) if rng.random() < 0.5 else 120
                part = pools[k][at[k] : at[k] + n]
                at[k] = (at[k] + n) % len(pools[k])
                for w in part[: 120 - len(f)]:
                    if w not in seen:
                        seen[w] = word_features(w)
                    f.append(seen[w])
                    g.append(k)
            chains.append(f)
            tags.append(g)
        w, a = train(chains, tags, len(langs), BUCKETS, epochs=3, batch=32)
        return cls(langs, w, a)

    def _start(self) -> None:
        class Index(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                return at

        self.index, self.table, self.lettered = Index(), np.zeros((0, len(self.langs))), np.zeros(0, bool)

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each language at each word of the texts, one after another, and their numbers of words (those with a letter)."""
        if not hasattr(self, "index") or len(self.index) > CACHE_WORDS:
            self._start()
        words, lens = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                p = _WORDS.findall(t.lower())
                lens[k] = len(p)
                words += p
        if not words or not self.langs:
            return np.zeros((0, max(1, len(self.langs)))), np.zeros(len(texts), np.int64)
        idx = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > len(self.table):
            new = list(islice(reversed(self.index), len(self.index) - len(self.table)))[::-1]
            parts = [emissions(self.weights, [word_features(w) for w in new[i : i + 20_000]]) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate((self.table, *parts))
            self.lettered = np.append(self.lettered, [w.isalpha() or any(map(str.isalpha, w)) for w in new])
        there = self.lettered[idx]
        if not there.all():
            lens = np.bincount(np.repeat(np.arange(len(texts)), lens)[there], minlength=len(texts))
            idx = idx[there]
        return forward_backward(self.table[idx], self.trans, lens), lens

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Expected share of each language among a text's words; NaN rows for texts without a letter."""
        post, lens = self.posteriors(texts)
        out = np.full((len(texts), len(self.langs)), np.nan)
        have = np.flatnonzero(lens)
        if len(have):
            first = (np.cumsum(lens) - lens)[have]
            out[have] = np.add.reduceat(post, first, axis=0) / lens[have, None]
        return out


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: its id's crc32, as text, has remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Fit on a bounded sample: the whole texts of some ``SAMPLE_DOCS`` rows a language, chosen by a hash of the id.

    Rows with null id, text or language and held-out rows are never used. Only one count a language and
    the sample reach the driver; at most ``4 * SAMPLE_DOCS`` rows a language are taken. All languages that have a label are learned.
    """
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out("doc_id")
    )
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LangModel([], np.zeros((BUCKETS, 1)), np.zeros((1, 1)))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    least = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, SAMPLE_DOCS / n))])
    picked = known.where(h < F.element_at(least, F.col("lang"))).select("doc_id", "lang", "t")
    rows = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(4 * SAMPLE_DOCS * len(counts)).collect()
    return LangModel.fit([(r.lang, r.t) for r in rows])


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row and the columns in ``keep``; one pass, no shuffle.

    ``lang_pred`` is the language with the largest expected share of the words and ``score`` that share;
    null texts and texts without a letter give ``und`` with score 0. Ties go to the first language by name; repeated rows are
    scored each. A column in ``keep`` can't be called ``lang_pred``, ``score`` or ``__text``: that is a ValueError.
    """
    if clash := {"lang_pred", "score", "__text"}.intersection(keep):
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in frames:
            texts = pdf["__text"].tolist()
            got, at, size = [], 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size > BLOCK_CHARS or k + 1 == len(texts):
                    got.append(m.shares(texts[at : k + 1]))
                    at, size = k + 1, 0
            s = np.concatenate(got) if got else np.zeros((0, max(1, len(m.langs))))
            known = ~np.isnan(s).any(axis=1) & bool(m.langs)
            best = np.where(known, np.nan_to_num(s).argmax(axis=1), -1)
            out = pdf.drop(columns="__text")
            out["lang_pred"] = [m.langs[b] if b >= 0 else "und" for b in best]
            out["score"] = np.where(known, np.minimum(1.0, np.nan_to_num(s).max(axis=1)), 0.0)
            yield out

    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *[F.col(c) for c in keep if c != id_col]
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text")
    return picked.mapInPandas(run, f"{schema}, lang_pred string, score double")


def label_words(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, words, langs, probs)`` per row: each word with a letter, its likeliest language by forward-backward, and how likely that is.

    Words are lower-cased; null texts, texts without a letter and models without a language give empty lists. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in frames:
            words, langs, probs = [], [], []
            for t in pdf["t"]:
                post, lens = m.posteriors([t])
                words.append(words_of(t) if len(post) else [])
                langs.append([m.langs[k] for k in post.argmax(axis=1)] if len(post) else [])
                probs.append(post.max(axis=1) if len(post) else np.zeros(0))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "words": words, "langs": langs, "probs": probs})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return picked.mapInPandas(run, "doc_id long, words array<string>, langs array<string>, probs array<double>")


def identify(docs: DataFrame, **cols: str) -> DataFrame:
    """Fit on the labelled part of ``docs`` and predict every row: ``(doc_id, held_out, lang_pred, score)``."""
    got = predict(docs, fit_model(docs, **cols), **{k: v for k, v in cols.items() if k != "lang_col"})
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
