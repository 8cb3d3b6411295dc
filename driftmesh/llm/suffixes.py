"""Suffix order of a table of texts by the difference cover modulo 3, and the repeats that neighbouring suffixes show.

Suffixes at places 1 and 2 modulo 3 are the sample. Their triples of symbols are sorted and named; if names repeat, the string of
names is ordered first, by the same steps. Places 0 modulo 3 are then merged in: with the sample's ranks at hand a pair or a
triple of numbers orders them among themselves and against either half of the sample, so the merge is three plain sorts. Two
neighbours in suffix order that share ``length`` bytes mark a repeat.

Every place of every text is a row, several times sorted: ``repeats.remove_repeats`` gives the same result from a
hundredth of the rows, and is what the registered query runs. README has the figures of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts
from .repeats import _digest

BASE = 200_000  # a string of names of at most so many places is ordered in one task


def numbered(df: DataFrame, *cols: str, name: str = "n", size: str | None = None) -> DataFrame:
    """``df`` (few columns) with ``name``: how many rows come before in the order of ``cols``, or the sum of their ``size``.

    Parts of a range partitioning are numbered on their own; one row a part says what comes before it.
    """
    add = F.lit(1) if size is None else F.col(size)
    parts = cut(df.repartitionByRange(shuffle_parts(df.sparkSession), *cols).withColumn("__part", F.spark_partition_id()), "suffixes")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("__part").agg(F.sum(add).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("__at", F.coalesce(F.sum(add).over(within), F.lit(0))).join(F.broadcast(base), "__part")
    return cut(out.withColumn(name, (F.col("__base") + F.col("__at")).cast("long")).drop("__part", "__at", "__base"), "suffixes")


def _shifted(df: DataFrame, value: str, by: int, name: str) -> DataFrame:
    return df.select((F.col("p") - by).alias("p"), F.col(value).alias(name))


def _in_one_task(symbols: DataFrame) -> DataFrame:
    """Ranks of a small string's suffixes by doubling."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("p")["s"].to_numpy()
        rank, n, step = np.unique(s, return_inverse=True)[1].astype(np.int64), len(s), 1
        while step < n and rank.max() < n - 1:
            nxt = np.full(n, -1, np.int64)
            nxt[:-step] = rank[step:]
            order = np.lexsort((nxt, rank))
            new = np.append(0, (rank[order][1:] != rank[order][:-1]) | (nxt[order][1:] != nxt[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            step *= 2
        return pd.DataFrame({"p": np.arange(n), "r": rank})

    return symbols.groupBy(F.lit(0).alias("one")).applyInPandas(run, "p long, r long")


def suffix_ranks(symbols: DataFrame, n: int) -> DataFrame:
    """``(p, r)``: the rank 0 .. n - 1 of each suffix of the string ``symbols (p, s)``, places 0 .. n - 1, symbols above 0."""
    if n <= BASE:
        return cut(_in_one_task(symbols), "suffixes")
    # a place beyond the end keeps the two halves of the sample apart
    ends = symbols.sparkSession.range(n, n + 1).select(F.col("id").alias("p"), F.lit(0).cast("long").alias("s")).where(F.lit(n % 3 == 1))
    s = symbols.select("p", "s").unionByName(ends)
    three = s.join(_shifted(s, "s", 1, "s1"), "p", "left").join(_shifted(s, "s", 2, "s2"), "p", "left").na.fill(0, ["s1", "s2"])
    three = cut(three, "suffixes")
    sample = three.where("p % 3 <> 0")
    names = numbered(sample.select("s", "s1", "s2").distinct(), "s", "s1", "s2", name="r")
    named = cut(sample.join(names, ["s", "s1", "s2"]).select("p", (F.col("r") + 1).alias("s")), "suffixes")
    n_sample, n_names, first_half = named.count(), names.count(), (n + (n % 3 == 1) + 1) // 3
    place = F.when(F.col("p") % 3 == 1, F.floor(F.col("p") / 3)).otherwise(first_half + F.floor(F.col("p") / 3)).cast("long")
    if n_names == n_sample:
        ranks = named.select("p", "s")
    else:
        inner = suffix_ranks(named.select(place.alias("p"), "s"), n_sample)
        back = F.when(F.col("p") < first_half, F.col("p") * 3 + 1).otherwise((F.col("p") - first_half) * 3 + 2)
        ranks = cut(inner.select(back.alias("p"), (F.col("r") + 1).alias("s")), "suffixes")
    full = three.join(_shifted(ranks, "s", 1, "r1"), "p", "left").join(_shifted(ranks, "s", 2, "r2"), "p", "left").na.fill(0, ["r1", "r2"])
    full = cut(full.where(F.col("p") < n).select("p", "s", "s1", "r1", "r2", (F.col("p") % 3).cast("int").alias("c")), "suffixes")
    own = numbered(ranks.where(F.col("p") < n).select("p", F.col("s").alias("r")), "r", name="own")  # among the sample
    halves = own.withColumn("c", (F.col("p") % 3).cast("int"))
    rows = [numbered(halves.where(F.col("c") == c).select("p", "own"), "own", name="half") for c in (1, 2)]
    zero = numbered(full.where("c = 0").select("p", "s", "r1"), "s", "r1", name="own").select("p", "own")
    with_first = numbered(full.where("c <> 2").select("p", "s", "r1", "c"), "s", "r1", name="both")
    with_second = numbered(full.where("c <> 1").select("p", "s", "s1", "r2", "c"), "s", "s1", "r2", name="both")
    a = rows[0].join(with_first, "p").select("p", (F.col("own") + F.col("both") - F.col("half")).alias("r"))
    b = rows[1].join(with_second, "p").select("p", (F.col("own") + F.col("both") - F.col("half")).alias("r"))
    z = zero.join(with_first.select("p", F.col("both").alias("x")), "p").join(with_second.select("p", F.col("both").alias("y")), "p")
    z = z.select("p", (F.col("x") + F.col("y") - F.col("own")).alias("r"))
    return cut(a.unionByName(b).unionByName(z), "suffixes")


def repeated_starts(docs: DataFrame, length: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start)``: bytes at which a string of ``length`` bytes begins that also begins elsewhere in the table.

    Null texts are empty, null ids keep their rows, repeated rows are copies of each other; other columns aren't read.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("k1"), F.expr("uuid()").alias("u")), "suffixes")
    placed = numbered(rows.select("u", (F.octet_length("t") + 1).cast("long").alias("size")), "u", name="at", size="size")
    n = placed.agg(F.sum("size").alias("n")).first().n or 0
    texts = cut(rows.join(placed.select("u", "at"), "u").select("doc_id", "t", "at"), "suffixes")

    def symbols(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for text, at in zip(pdf["t"].tolist(), pdf["at"].tolist()):
                raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64) + 2
                for lo in range(0, len(raw) + 1, 100_000):
                    part = np.append(raw, 1)[lo : lo + 100_000]
                    yield pd.DataFrame({"p": at + lo + np.arange(len(part)), "s": part})

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The digest of each whole string, which says whether two neighbours share it."""
        for pdf in frames:
            for name, text, at in zip(pdf["doc_id"].tolist(), pdf["t"].tolist(), pdf["at"].tolist()):
                raw = text.encode()
                for lo in range(0, len(raw) - length + 1, 50_000):
                    starts = range(lo, min(len(raw) - length + 1, lo + 50_000))
                    got = [_digest(raw[k : k + length]) for k in starts]
                    yield pd.DataFrame({"doc_id": name, "start": list(starts), "p": [at + k for k in starts], "d1": [d[0] for d in got], "d2": [d[1] for d in got]})

    ranks = suffix_ranks(cut(texts.mapInPandas(symbols, "p long, s long"), "suffixes"), n)
    found = cut(texts.mapInPandas(strings, "doc_id long, start long, p long, d1 long, d2 long").join(ranks, "p").select("doc_id", "start", "r", "d1", "d2"), "suffixes")
    # a row is compared with the one before; ranks are dealt in runs, each with the last row of the run before
    run = 100_000
    both = found.withColumn("part", F.explode(F.array_distinct(F.array(F.floor(F.col("r") / run), F.floor((F.col("r") + 1) / run)))))
    line = Window.partitionBy("part").orderBy("r")
    same = (F.lag("r").over(line) == F.col("r") - 1) & (F.lag("d1").over(line) == F.col("d1")) & (F.lag("d2").over(line) == F.col("d2"))
    met = both.withColumn("same", F.coalesce(same, F.lit(False))).where("same")
    hits = met.select(F.explode(F.array("r", F.col("r") - 1)).alias("r")).distinct()
    return found.join(hits, "r", "left_semi").select("doc_id", "start")
