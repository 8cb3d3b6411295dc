"""SentencePiece BPE with seeded merge-dropout: agenda-driven merges, each skipped by a keyed hash.

Text is escaped as the model asks (a dummy prefix, spaces as U+2581) and cut before each word; the
pieces of the models in use never span such a cut, which is checked when a model is loaded. A word's merges run from an
agenda ordered by piece score, then by place. The n-th merge that a word's agenda offers is skipped by a keyed hash of
(seed, document, word's number in the text, skips before), which leaves it out of that word's
segmentation. Each occurrence of a word in each document draws anew. Segmentations without a skip are
kept; words that skip a merge within their agenda are merged anew, those of a block of texts side by side. With dropout 0
the pieces are the library's own, but for U+2581 in a text itself: that is spelled in bytes, so that it
isn't decoded as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, put_at

SPACE = "▁"
OWN_SPACE = "\ud800"  # stands for U+2581 of a text itself; no text holds half a surrogate pair
CACHE_WORDS = 150_000
BLOCK_CHARS = 1_000_000
LONG_WORD = 48
WIDTHS = (4, 6, 8, 10, 13, 20, LONG_WORD)
ROWS = 8192  # words merged side by side
_NONE = -1e30
_MASK = (1 << 64) - 1
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Dropout:
    """``rate`` of merges skipped, and the hash's ``seed``."""

    rate: float = 0.1
    seed: int = 1


class _Index(dict):
    """Word -> its number; an unknown one gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``first``, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's last steps."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class MergeModel:
    """Pieces and scores of a SentencePiece BPE model, with an own agenda-driven encoder."""

    def __init__(self, path: str, dropout: Dropout):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout = dropout
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.ids, self.scores, self.byte_ids = {}, {}, {}
        for i, p in enumerate(self.pieces):
            if self.library.is_byte(i):
                self.byte_ids[int(_BYTE.fullmatch(p)[1], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.ids[p], self.scores[p] = i, self.library.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces; decoding would lose characters")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("the model has pieces that span words")
        # an agenda's merges before the next skip are at least k if the hash is below (1 - rate)**k of its range
        below = []
        while dropout.rate > 0 and len(below) < 1 << 16 and (t := int((1 - dropout.rate) ** (len(below) + 1) * 2**64)):
            below.append(min(t, _MASK))
        self.below = np.array(below[::-1], np.uint64)
        self._tabulate()
        self._forget()

    def _tabulate(self) -> None:
        """Symbols (pieces, then characters that are none), and for each mergeable pair of them the whole and its score."""
        self.raw = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in self.pieces]
        self.raw_sizes = np.array(list(map(len, self.raw)))
        symbols = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p}):
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.alone = {i: c for c, i in symbols.items() if i >= len(self.pieces)}
        self.chars = np.array(sorted(map(ord, (s for s in symbols if len(s) == 1))), np.uint32)
        self.char_symbols = np.array([symbols[chr(c)] for c in self.chars.tolist()], np.int64)
        found = [
            (symbols[p[:k]] << 20 | symbols[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols
        ]
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.pairs, self.wholes = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.pair_scores = np.array([self.scores[self.pieces[i]] for i in self.wholes.tolist()])

    def _forget(self) -> None:
        """Empty the cache: words' numbers, and by number their symbols, ids without a skip and agendas' lengths."""
        self.index = _Index()
        self.known = self.n_symbols = self.n_ids = 0
        self.begin, self.lens, self.first, self.sizes, self.agenda, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(6))
        self.symbols, self.flat = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def _evict(self) -> None:
        """Forget words that were met once; if that frees little, all."""
        keep = np.flatnonzero(self.uses[: self.known] > 1)
        words = list(self.index)
        symbols, flat = self.symbols, self.flat
        begin, lens, first, sizes, agenda = (x[keep] for x in (self.begin, self.lens, self.first, self.sizes, self.agenda))
        self._forget()
        if 2 * len(keep) > CACHE_WORDS:
            return
        self.index = _Index(zip(map(words.__getitem__, keep.tolist()), range(len(keep))))
        held = np.where(agenda < 0, 0, lens)
        self._keep(symbols[_runs(begin, held)], held, lens, flat[_runs(first, sizes)], sizes, agenda)

    def _keep(self, symbols: np.ndarray, held: np.ndarray, lens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, agenda: np.ndarray) -> None:
        n = self.known
        self.begin = put_at(self.begin, n, self.n_symbols + np.cumsum(held) - held)
        self.first = put_at(self.first, n, self.n_ids + np.cumsum(sizes) - sizes)
        self.lens, self.sizes, self.agenda = put_at(self.lens, n, lens), put_at(self.sizes, n, sizes), put_at(self.agenda, n, agenda)
        self.uses = put_at(self.uses, n, np.zeros(len(lens), np.int64))
        self.symbols, self.flat = put_at(self.symbols, self.n_symbols, symbols), put_at(self.flat, self.n_ids, ids)
        self.known, self.n_symbols, self.n_ids = n + len(lens), self.n_symbols + len(symbols), self.n_ids + len(ids)

    def _learn(self) -> None:
        """Segment the words that the index has got since the last call; long ones are left for each occurrence."""
        new = list(islice(reversed(self.index), len(self.index) - self.known))[::-1]
        lens = np.fromiter(map(len, new), np.int64, len(new))
        short = lens <= LONG_WORD
        points = np.frombuffer("".join(w for w in new if len(w) <= LONG_WORD).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == points, self.char_symbols[at], -2 - points.astype(np.int64)).astype(np.int32)
        held = np.where(short, lens, 0)
        ids, sizes, agenda = self._segmented(symbols, (np.cumsum(held) - held)[short], held[short], None)
        every = np.zeros((2, len(new)), np.int64)
        every[:, short] = sizes, agenda
        every[1, ~short] = -1
        self._keep(symbols, held, lens, ids, every[0], every[1])

    def _keys(self, key: int, n: int) -> np.ndarray:
        """Draws of the ``n`` words of document ``key``."""
        start = np.uint64(xxhash.xxh64_intdigest(str(key), self.dropout.seed))
        return _mixed(start + np.arange(n, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def _gaps(self, draws: np.ndarray, nth: np.ndarray | int) -> np.ndarray:
        """Merges taken between the ``nth`` skip of each word's draw and the one before."""
        if self.dropout.rate <= 0:
            return np.full(len(draws), 1 << 40)
        x = _mixed(draws + (np.atleast_1d(np.asarray(nth, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return len(self.below) - np.searchsorted(self.below, x, "right")

    def _steps(self, draw: int) -> Iterator[int]:
        """Numbers of the merges skipped in one word."""
        at, one = -1, np.array([draw], np.uint64)
        for nth in count():
            at += 1 + int(self._gaps(one, nth)[0])
            yield at

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Wholes and scores of symbol pairs; score ``_NONE`` where they don't merge."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        ok = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return self.wholes[at], np.where(ok, self.pair_scores[at], _NONE)

    def _merged(self, sym: np.ndarray, draws: np.ndarray | None) -> np.ndarray:
        """Merge the symbols of each row of ``sym`` (filled with -1; one column more than the longest word), and give the agendas' lengths.

        One agenda a row, all rows step together. A merged symbol stays in its first character's place and leaves -1
        in the others; links lead to the next one and the one before.
        """
        n, width = sym.shape[0], sym.shape[1] - 1
        after, before = (np.tile(np.arange(width + 1, dtype=np.int64) + d, (n, 1)) for d in (1, -1))
        whole, score = self._pair(sym[:, :-1], sym[:, 1:])
        taken, live, step = np.zeros(n, np.int64), np.arange(n), 0
        skip = self._gaps(draws, 0) if draws is not None else np.full(n, -1)
        nth = np.zeros(n, np.uint64)
        at = live  # rows of ``score``: those that were live when it was last packed
        while True:
            i = score[at].argmax(axis=1) if len(at) < len(score) else score.argmax(axis=1)
            go = score[at, i] > _NONE
            if not go.all():
                taken[live[~go]] = step
                live, at, i = live[go], at[go], i[go]
                if not len(live):
                    return taken
                if 2 * len(at) < len(score):
                    score, at = score[at], np.arange(len(at))
            r, s = live, at
            out = skip[live] == step
            step += 1
            if out.any():
                rows = live[out]
                score[at[out], i[out]] = _NONE
                nth[rows] += np.uint64(1)
                skip[rows] = step + self._gaps(draws[rows], nth[rows])
                r, s, i = live[~out], at[~out], i[~out]
            j = after[r, i]
            k, h = after[r, j], before[r, i]
            sym[r, i], sym[r, j] = whole[r, i], -1
            after[r, i], before[r, k] = k, i
            score[s, j] = _NONE
            whole[r, i], score[s, i] = self._pair(sym[r, i], sym[r, k])
            r, s, h, i = (x[h >= 0] for x in (r, s, h, i))
            whole[r, h], score[s, h] = self._pair(sym[r, h], sym[r, i])

    def _segmented(self, symbols: np.ndarray, begin: np.ndarray, lens: np.ndarray, draws: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after another, their number, agenda's length) of words given as runs of ``symbols``."""
        order = np.argsort(lens, kind="stable")
        parts, sizes, agenda = [], np.zeros(len(lens), np.int64), np.zeros(len(lens), np.int64)
        edges = np.searchsorted(lens[order], WIDTHS, "right")
        for lo, hi, width in zip((0, *edges[:-1]), edges, WIDTHS):
            for at in range(lo, hi, ROWS):
                rows = order[at : min(hi, at + ROWS)]
                sym = np.full((len(rows), width + 1), -1, np.int32)
                sym[:, :width][np.arange(width) < lens[rows][:, None]] = symbols[_runs(begin[rows], lens[rows])]
                agenda[rows] = self._merged(sym, None if draws is None else draws[rows])
                there = sym != -1
                got, n = sym[there], there.sum(axis=1)
                if len(odd := np.flatnonzero((got < 0) | (got >= len(self.pieces)))):  # characters that have no piece are spelled in bytes
                    spelled = [self._spelled(x) for x in got[odd].tolist()]
                    many = np.ones(len(got), np.int64)
                    many[odd] = list(map(len, spelled))
                    np.add.at(n, np.repeat(np.arange(len(rows)), n)[odd], many[odd] - 1)
                    got = np.repeat(got, many)
                    got[_runs((np.cumsum(many) - many)[odd], many[odd])] = [b for x in spelled for b in x]
                sizes[rows] = n
                parts.append(got)
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        first = np.empty(len(lens), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[_runs(first, sizes)], sizes, agenda

    def _spelled(self, symbol: int) -> list[int]:
        """Byte ids of a symbol without a piece: a character of some piece, or any other by its own number."""
        char = self.alone[symbol] if symbol >= 0 else chr(-2 - symbol)
        return self._byte_ids(char)

    def _byte_ids(self, chars: str) -> list[int]:
        return [self.byte_ids[b] for b in chars.replace(OWN_SPACE, SPACE).encode()]

    def _drawn(self, words: list[str], draws: np.ndarray, dropped: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, their number) of words, each by its own draw."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > self.known:
            self._learn()
        self.uses[: self.known] += np.bincount(at, minlength=self.known)
        first, sizes, agenda = self.first[at], self.sizes[at], self.agenda[at]
        more, n = [self.flat], self.n_ids
        more[0] = self.flat[:n]
        for k in np.flatnonzero(agenda < 0).tolist():
            ids = np.array(self.word(words[k], int(draws[k]), dropped), np.int32)
            first[k], sizes[k] = n, len(ids)
            more.append(ids)
            n += len(ids)
        if dropped and self.dropout.rate > 0:
            odd = np.flatnonzero(self._gaps(draws, 0) < agenda)
            ids, size, _ = self._segmented(self.symbols, self.begin[at[odd]], self.lens[at[odd]], draws[odd])
            first[odd], sizes[odd] = n + np.cumsum(size) - size, size
            more.append(ids)
        return np.concatenate(more)[_runs(first, sizes)], sizes

    def words(self, words: list[str], draw: int, dropped: bool = True) -> list[list[int]]:
        """Ids of many escaped words by one draw."""
        ids, sizes = self._drawn(words, np.full(len(words), draw, np.uint64), dropped)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def word(self, word: str, draw: int, dropped: bool = True) -> list[int]:
        """Ids of one escaped word."""
        steps = self._steps(draw) if dropped and self.dropout.rate > 0 else None
        parts = self._merged_short(word, steps) if len(word) <= LONG_WORD else self._merged_long(word, steps)
        out = []
        for p in parts:
            i = self.ids.get(p)
            if i is None:
                out += self._byte_ids(p)
            else:
                out.append(i)
        return out

    def _merged_short(self, word: str, steps: Iterator[int] | None) -> list[str]:
        """The agenda as a list of pair scores: the best is the first of the largest."""
        parts, scores = list(word), self.scores
        step, skip = -1, next(steps) if steps else -1
        score = [scores.get(a + b, _NONE) for a, b in zip(word, word[1:])]
        while score:
            best = max(score)
            if best == _NONE:
                break
            i = score.index(best)
            whole = parts[i] + parts[i + 1]
            step += 1
            if step == skip:
                skip = next(steps)
                score[i] = _NONE
                continue
            parts[i] = whole
            del parts[i + 1], score[i]
            if i:
                score[i - 1] = scores.get(parts[i - 1] + whole, _NONE)
            if i < len(score):
                score[i] = scores.get(whole + parts[i + 1], _NONE)
        return parts

    def _merged_long(self, word: str, steps: Iterator[int] | None) -> list[str]:
        """The agenda as a heap over a linked list, for words of any length."""
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, str, str]] = []
        scores = self.scores
        step, skip = -1, next(steps) if steps else -1

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (s := scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (-s, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            if parts[i] != left or after[i] >= n or parts[after[i]] != right:
                continue
            step += 1
            if step == skip:
                skip = next(steps)
                continue
            j = after[i]
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def escape(self, text: str) -> str:
        return SPACE + text.replace(SPACE, OWN_SPACE).replace(" ", SPACE) if text else ""

    def encode(self, text: str, key: int, dropped: bool = True) -> np.ndarray:
        """Ids of a whole text; ``key`` (a document's own number) gives its words' draws."""
        return self.encode_all([text], [key], dropped)[0]

    def encode_all(self, texts: list[str], keys: list[int], dropped: bool = True) -> list[np.ndarray]:
        """``encode`` of each text; the words that aren't known yet are segmented together."""
        if len(self.index) > CACHE_WORDS:
            self._evict()
        split = [_WORDS.findall(self.escape(t)) for t in texts]
        if not any(split):
            return [np.empty(0, np.int32)] * len(texts)
        draws = np.concatenate([self._keys(key, len(words)) for key, words in zip(keys, split)])
        ids, sizes = self._drawn([w for words in split for w in words], draws, dropped)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(list(map(len, split)))]
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text that gave ``ids``, whatever merges were skipped."""
        return self._bytes(ids).decode()[1:]

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))

    def lossless(self, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
        """Whether each text is what its ids decode to; those of a block are compared together first."""
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        sizes = [int(self.raw_sizes[i].sum()) for i in ids]
        if sizes == list(map(len, wanted)) and self._bytes(np.concatenate(ids)) == b"".join(wanted):
            return [True] * len(texts)
        return [self._bytes(i) == w for i, w in zip(ids, wanted)]


_models: dict[tuple[str, Dropout], MergeModel] = {}


def model(path: str, dropout: Dropout) -> MergeModel:
    """One model per worker process."""
    if (path, dropout) not in _models:
        _models[path, dropout] = MergeModel(path, dropout)
    return _models[path, dropout]


def _in_blocks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of whole rows of some ``BLOCK_CHARS`` characters of ``t``."""
    ends = np.cumsum(pdf["t"].str.len().to_numpy(np.int64)) // BLOCK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(pdf)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield pdf.iloc[a:b]


def encode(docs: DataFrame, model_path: str, dropout: Dropout = Dropout(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_crc32, lossless)`` per row, in one pass without a shuffle.

    ``lossless`` says that the ids decode to the very text. Null and empty texts give no id; rows with a null id keep
    it and take the draws of key 0; repeated rows get equal ids. Other columns aren't read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path, dropout)
        for pdf in frames:
            for part in _in_blocks(pdf):
                texts = part["t"].tolist()
                ids = m.encode_all(texts, [0 if pd.isna(i) else int(i) for i in part["doc_id"].tolist()])
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "ids": ids,
                        "n_tokens": list(map(len, ids)),
                        "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids],
                        "lossless": m.lossless(ids, texts),
                    }
                )

    bounded_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return picked.mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, text)`` of rows with ``(doc_id, ids)``; null ids give a null text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path, Dropout())
        for pdf in frames:
            texts = [None if i is None else m.decode(np.asarray(i, np.int32)) for i in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
