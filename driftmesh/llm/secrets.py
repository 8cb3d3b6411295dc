"""Secret scans: base patterns, and a linear-chain CRF that tags tokens as begin, inside or outside.

Only tokens that could be part of a secret (at least ``MIN_TOKEN`` characters of the token alphabet with a digit or
mixed case; right after a key-like word, any of at least ``MIN_LED``) may be tagged begin or inside; every other token is outside by the chain's own
constraint. A chain whose state is known at a token splits there, so decoding the runs of such
tokens, each with outside on both ends, gives the Viterbi path of the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .crf import emissions, hashed, train, viterbi

KINDS = ("assign", "access", "hex", "crf")
BUCKETS = 1 << 14
MIN_TOKEN = 12
MIN_LED = 6
SAMPLE_DOCS = 400  # texts that lend their words and lines to the training chains
BEGIN, INSIDE, OUTSIDE = 0, 1, 2

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_TOKEN},}}")
_KEYLIKE = r"(?:key|token|secret|passw|passphrase|pwd|auth|bearer|cred)"
_LEAD = re.compile(rf"""{_KEYLIKE}[A-Za-z0-9_]*["']?\s{{0,3}}(?:[:=]|is\b)?\s{{0,3}}["']?(?<![A-Za-z0-9+/_.=-])""", re.IGNORECASE)
_LED = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_LED},}}")
_LED_INSIDE = re.compile(rf"[A-Za-z0-9_.-]*{_KEYLIKE}[A-Za-z0-9_]*=.{{{MIN_LED},}}", re.IGNORECASE)
_NEAR = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _covered(start: int, end: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether sorted base spans cover all of a span."""
    for s, _, e in base:
        if s <= start < e:
            start = e
    return start >= end


def may_be_secret(token: str) -> bool:
    """Whether a token of ``MIN_TOKEN`` characters may be tagged begin or inside wherever it stands."""
    if any(map(str.isdigit, token)):
        return token.isdigit() or any(map(str.isalpha, token))
    if token != token.lower() and token[1:] != token[1:].lower() and token != token.upper():
        return True
    return "=" in token and _LED_INSIDE.fullmatch(token) is not None


def shape(token: str) -> str:
    got = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "0", token)))
    return got[:12]


def _entropy(token: str) -> float:
    n = np.unique(list(token), return_counts=True)[1] / len(token)
    return float(-(n * np.log2(n)).sum())


def token_features(token: str, left: list[str], right: list[str], file: str) -> list[int]:
    """Features of one candidate: its shape, its neighbours' words and its text's own kind."""
    n = len(token)
    names = [
        "bias",
        f"len{min(n // 4, 16)}",
        "sh" + shape(token),
        f"ent{int(2 * _entropy(token))}",
        f"dig{int(8 * sum(map(str.isdigit, token)) / n)}",
        f"up{int(8 * sum(map(str.isupper, token)) / n)}",
        f"alt{min(9, int(10 * len(re.findall('[A-Za-z][0-9]|[0-9][A-Za-z]', token)) / n))}",
        "hex" if re.fullmatch("[0-9a-fA-F]+", token) else "nohex",
        "pre" + re.sub("[0-9]", "0", token[:4]),
        "dots" if "." in token else "nodots",
        "under" if "_" in token or "-" in token else "nounder",
        "slash" if "/" in token else "noslash",
        file,
    ]
    names += [f"l{k}:{w.lower()[:12]}" for k, w in enumerate(left)] + [f"r{k}:{w.lower()[:12]}" for k, w in enumerate(right)]
    names += ["key" + w.lower() for w in left if re.search(_KEYLIKE, w.lower())]
    return hashed(names, BUCKETS)


def file_feature(text: str) -> str:
    """A text's own kind, by how much of it assigns, links or is set in code."""
    n = max(1, len(text))
    return f"file{min(3, int(400 * (text.count('=') + text.count('{') + text.count(';')) / n))}{'u' if '://' in text else ''}"


def candidates(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring candidate tokens (only quotes, commas or white space between them), as spans."""
    runs: list[list[tuple[int, int]]] = []
    found = {m.span() for m in _TOKEN.finditer(text) if may_be_secret(m[0])}
    found |= {m.span() for lead in _LEAD.finditer(text) if (m := _LED.match(text, lead.end()))}
    for start, end in sorted(found):
        gap = text[runs[-1][-1][1] : start] if runs else None
        if gap is not None and len(gap) <= 3 and not re.search(r"\w", gap):
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
    return runs


def run_features(text: str, run: list[tuple[int, int]], file: str) -> list[list[int]]:
    out = []
    for start, end in run:
        left = _NEAR.findall(text[max(0, start - 48) : start])[-4:][::-1]
        right = _NEAR.findall(text[end : end + 32])[:2]
        out.append(token_features(text[start:end], left, right, file))
    return out


class SecretModel:
    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights.astype(np.float32), trans

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans that Viterbi decoding tags: a begin token with the inside tokens after it."""
        out: list[tuple[int, int]] = []
        runs = candidates(text)
        if not runs:
            return out
        file = file_feature(text)
        for run in runs:
            emit = emissions(self.weights, run_features(text, run, file)).astype(float)
            first = self.trans[OUTSIDE].copy()
            first[INSIDE] = -1e9
            tags = viterbi(emit, self.trans, first, self.trans[:, OUTSIDE])
            for (start, end), tag in zip(run, tags):
                if tag == INSIDE and out:
                    out[-1] = (out[-1][0], end)
                elif tag != OUTSIDE:
                    out.append((start, end))
        return out

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans, and those CRF spans that hold a character outside the base spans: (start, kind number, end)."""
        base = base_spans(text)
        more = [(s, 3, e) for s, e in self.spans(text) if not _covered(s, e, base)]
        return sorted(base + more)


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _made_secret(rng: np.random.Generator) -> str:
    def of(alphabet: str, n: int) -> str:
        return "".join(rng.choice(list(alphabet), n))

    kind = int(rng.integers(11))
    return [
        lambda: "ghp_" + of(_ALNUM, 36),
        lambda: "sk-" + of(_ALNUM, 40),
        lambda: "xoxb-" + of("0123456789", 11) + "-" + of(_ALNUM, 24),
        lambda: "eyJ" + of(_ALNUM, 20) + "." + of(_ALNUM + "_-", 40) + "." + of(_ALNUM + "_-", 30),
        lambda: "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16),
        lambda: of("0123456789abcdef", int(rng.choice([32, 40, 64]))),
        lambda: of(_ALNUM + "+/", 40),
        lambda: of(_ALNUM + "_-", int(rng.integers(16, 33))),
        lambda: of(_ALNUM[:52], int(rng.integers(16, 41))),
        lambda: of("0123456789", int(rng.integers(12, 25))),
        lambda: of(_ALNUM, int(rng.integers(8, 12))),
    ][kind]()


def _made_plain(rng: np.random.Generator, words: list[str]) -> str:
    """Harmless tokens that look somewhat like secrets."""

    def word() -> str:
        return words[int(rng.integers(len(words)))] if words else "word"

    n = [int(x) for x in rng.integers(1, 3000, 4)]
    kind = int(rng.integers(12))
    return [
        f"{word()}.{n[0]}@mail{n[1]}.example",
        f"www.{word()}{n[0]}.com/{word()}/{n[1]}",
        f"{2000 + n[0] % 30}-{1 + n[1] % 12:02d}-{1 + n[2] % 28:02d}T{n[3] % 24:02d}.00",
        f"{word()}_{word()}_{n[0]}",
        f"{word()}-{word()}-{n[0]}.html",
        f"v{n[0]}.{n[1]}.{n[2]}-{word()}",
        f"{word()}{word()}{n[0]}",
        f"/usr/{word()}/{word()}/{n[0]}/{word()}.py",
        f"{word().title()}-{word().title()}",
        f"{word()}{word().title()}{word().title()}",
        f"{n[0]:04d}{n[1]:04d}{n[2]:04d}",
        word(),
    ][kind]


def fit(texts: list[str], seed: int = 5, n_made: int = 3000) -> SecretModel:
    """Train on the candidates of sampled texts and on made lines among those texts' words.

    A candidate of a sampled text is begin if a base span covers it, else outside; made secrets follow
    key-like words (begin, or begin and inside where broken in two), made plain tokens stand among common words.
    """
    rng = np.random.default_rng(seed)
    words = [w for t in texts for w in t.split() if w.isalpha()] or ["the", "of", "and"]
    feats: list[list[list[int]]] = []
    tags: list[list[int]] = []
    for t in texts:
        base = base_spans(t)
        file = file_feature(t)
        for run in candidates(t):
            feats.append(run_features(t, run, file))
            tags.append([BEGIN if any(bs <= s and e <= be for bs, _, be in base) else OUTSIDE for s, e in run])
    keys = ["key", "token", "secret", "Authorization: Bearer", "credential", "client_key", "auth", "private key", "access key", "pwd", "apikey", "passphrase"]
    for k in range(n_made):
        before = " ".join(words[int(i)] for i in rng.integers(0, len(words), 8))
        after = " ".join(words[int(i)] for i in rng.integers(0, len(words), 4))
        quote = ["", '"', "'"][k % 3]
        if k % 2:
            one = _made_secret(rng)
            lead = f"{keys[int(rng.integers(len(keys)))]}{[' = ', ': ', '=', ' '][int(rng.integers(4))]}"
            tokens = [one]
            if len(one) >= 40 and rng.random() < 0.15:
                tokens = [one[:20], one[20:]]
            labels = [BEGIN] + [INSIDE] * (len(tokens) - 1)
        else:
            tokens, labels = [_made_plain(rng, words)], [OUTSIDE]
            lead = ["", "see ", "file ", "at "][int(rng.integers(4))]
            if tokens[0].isalpha():  # prose goes on after a key-like word too
                lead = f"{keys[int(rng.integers(len(keys)))]} "
        text = f"{before} {lead}{quote}{' '.join(tokens)}{quote} {after}"
        at = len(before) + 1 + len(lead) + len(quote)
        runs = [r for r in candidates(text) if len(r) == len(tokens) and r[0][0] <= at < r[0][1]]
        if runs:
            feats.append(run_features(text, runs[0], file_feature(text)))
            tags.append(labels)
    return SecretModel(*train(feats, tags, 3, BUCKETS, epochs=4, batch=32, rate=0.3))


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretModel:
    """Fit on at most ``SAMPLE_DOCS`` whole texts, the first by a hash of their ids."""
    picked = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t")).where("t <> ''")
    # the bound first, from hashes alone: else each task would send as many texts as are wanted in all
    least = picked.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()
    rows = picked.where(F.col("h") <= least[-1].h).orderBy("h", "t").limit(SAMPLE_DOCS).collect() if least else []
    return fit([r.t for r in rows])


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: SecretModel, id_col: str = "doc_id", text_col: str = "text", redact: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row ``doc_id``, the spans found, and with ``redact`` the text with each span replaced.

    Spans are in code points, end exclusive, over the whole text; a null text counts as empty (and stays null
    when redacted). One pass without a shuffle; other columns come along only if named in ``keep``, and can't be called as a
    column of the result is: that is a ValueError. Null ids keep their rows, repeated rows are scanned each.
    """
    own = {"__text", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"}
    if clash := own.intersection(keep):
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in frames:
            texts = pdf["__text"].tolist()
            found = [m.scan(t or "") for t in texts]
            out = pdf.drop(columns="__text")
            for k in range(3):
                out["n_" + KINDS[k]] = [sum(x[1] == k for x in f) for f in found]
            out["base_sha256"] = [_sha(_joined([x for x in f if x[1] < 3])) for f in found]
            out["spans"] = list(map(_joined, found))
            if redact is not None:
                out["redacted"] = [_redacted(t, f, redact) for t, f in zip(texts, found)]
            yield out

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"), *[F.col(c) for c in keep if c != id_col])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text")
    schema += ", n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * (redact is not None)
    return picked.mapInPandas(run, schema)


def _redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += (text[at:s], mark)
        at = e
    out.append(text[at:])
    return "".join(out)
