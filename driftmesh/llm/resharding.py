"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

The flow network has one node per old and per new shard; keeping bytes in place costs nothing, moving a
byte costs one. Its solution says how many bytes of each old shard go to each new one. Documents of an old
shard stand in one hashed order, and the flow cuts that line into intervals. One flow decides over all bytes; of
two cheapest ones it takes that which moves fewer bytes of large documents. As documents are whole, the large ones of a
shard miss their bytes a little. The smallest documents are therefore dealt after them: their part of the flow is
solved again for what the large ones really left of each capacity, so sizes end up nearly equal. Where they left less than nothing, the
large ones are dealt again, with so much of that shard kept for the small. Only per-shard sums reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, new_path, shuffle_parts

BLOCK_ROWS = 2_000_000 // 64
ROW_BYTES = 8
ROUNDS = 8  # at most, of dealing the large documents


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow ``[i][j]`` that ships all supplies within the capacities at least cost.

    Successive shortest paths with potentials over the bipartite network.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold the old ones' bytes")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    pot = [0] * (n + m)
    while any(left):
        dist, before = [None] * (n + m), [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            dist[i] = 0
        heapq.heapify(heap)
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                new = d + c + pot[u] - pot[v]
                if v not in done and (dist[v] is None or new < dist[v]):
                    dist[v], before[v] = new, u
                    heapq.heappush(heap, (new, v))
        far = max(d for d in dist if d is not None)
        ends = [j for j in range(m) if room[j] and dist[n + j] is not None]
        for u in range(n + m):
            pot[u] += dist[u] if dist[u] is not None else far
        end = min(ends, key=lambda j: pot[n + j] - 0)
        path, v = [], n + end
        while before[v] is not None:
            path.append((before[v], v))
            v = before[v]
        amount = min([left[v], room[end]] + [flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end] -= amount
    return flow


def _equal(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def _moves(supply: dict[int, int], room: list[int], n_old: int) -> list[list[int]]:
    have = [supply.get(i, 0) for i in range(n_old)]
    short = max(0, sum(have) - sum(room))
    room = [r + s for r, s in zip(room, _equal(short, len(room)))]
    return min_cost_flow(have, room, [[int(i != j) for j in range(len(room))] for i in range(n_old)])


def _cheapest(supply: list[dict[int, int]], capacity: list[int], spare: list[int], n_old: int) -> list[list[int]]:
    """Flow of all bytes, with rows for each old shard's large documents, then for its filler; only filler goes into the ``spare`` part of a capacity."""
    n_new = len(capacity)
    have = [kind.get(i, 0) for kind in supply for i in range(n_old)]
    moved = sum(have) + 1  # a byte that moves costs more than all that the choice between kinds can save
    never = (moved + 1) ** 2
    cost = [[(i != j % n_new) * (moved + (kind == 0)) + (kind == 0 and j >= n_new) * never for j in range(2 * n_new)] for kind in (0, 1) for i in range(n_old)]
    flow = min_cost_flow(have, [c - s for c, s in zip(capacity, spare)] + spare, cost)
    return [[x + y for x, y in zip(row[:n_new], row[n_new:])] for row in flow]


def _intervals(flow: list[list[int]], filler: int, at: Column) -> list[tuple[Column, int]]:
    """(condition, new shard): a document goes where the middle of its bytes falls; kept bytes come first."""
    out = []
    for i, row in enumerate(flow):
        end = 0
        order = sorted((j for j in range(len(row)) if row[j]), key=lambda j: (j != i, j))
        for j in order:
            end += row[j]
            here = (F.col("old") == i) & (F.col("filler") == filler)
            out.append((here if j == order[-1] else here & (at < end), j))
    return out


def reshard(
    docs: DataFrame, old: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", only_affected: bool = False
) -> tuple[str, list[list[int]]]:
    """Write ``docs`` as ``n_new`` shards of nearly equal bytes; returns the folder and the flow ``[old][new]``.

    ``old`` gives each row's old shard, 0 to ``n_old - 1`` (null: 0). A row's size is its text's UTF-8 bytes plus
    eight; null texts have none. Files hold ``doc_id, text, size, slot`` under ``shard=N``; slots
    are gapless in each shard. ``only_affected`` leaves out shards that neither give nor get a byte: their old files stand. Null ids and
    repeated rows are dealt like any other, equal texts too; the id and text columns alone are read. A document larger
    than a shard's share fills its shard alone or nearly so. No rows give no files.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size.alias("size"), F.coalesce(old.cast("int"), F.lit(0)).alias("old")
    ).withColumn("h", F.xxhash64("doc_id", "text"))

    # sizes by power of two say below which size documents are filler
    classes = {
        r.p: r
        for r in rows.groupBy(F.floor(F.log2("size")).alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.max("size").alias("m")).collect()
    }
    n_rows, total = sum(r.n for r in classes.values()), sum(r.s for r in classes.values())
    want, held, below = min(total // 2, n_new * max((r.m for r in classes.values()), default=0)), 0, 0
    for p in sorted(classes):
        if held >= want:
            break
        held += classes[p].s
        below = 2 ** (p + 1)
    n_blocks = 64 * max(1, -(-n_rows // 2_000_000))
    rows = rows.withColumn("filler", (F.col("size") < below).cast("int")).withColumn("block", F.pmod("h", F.lit(n_blocks)).cast("int"))

    key = ["old", "filler", "block"]
    light = cut(rows.select("doc_id", "size", "h", *key), "reshard")
    line = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_first(), "h", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy(*key).agg(F.sum("size").alias("s"))
    base = Window.partitionBy("old", "filler").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, F.coalesce(F.sum("s").over(base), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(line), F.lit(0))
    placed = cut(
        light.withColumn("within", within).join(offsets, key).select(*key, "size", "within", (F.col("base") + F.col("within") + F.col("size") / 2).cast("long").alias("mid")), "reshard"
    )

    supply: list[dict[int, int]] = [{}, {}]
    for r in sums.groupBy("old", "filler").agg(F.sum("s").alias("s")).collect():
        supply[r.filler][r.old] = r.s
    capacity = _equal(total, n_new)
    more = [0] * n_new
    for _ in range(ROUNDS):
        spare = more
        first = _cheapest(supply, capacity, spare, n_old)[:n_old]
        chain = _intervals(first, 0, F.col("mid"))
        got = {r.shard: r.s for r in placed.where("filler = 0").groupBy(_cases(chain).alias("shard")).agg(F.sum("size").alias("s")).collect()}
        # whole large documents can exceed a shard that has no filler to give up: it keeps so much for filler alone
        over = [max(0, got.get(j, 0) - c) for j, c in enumerate(capacity)]
        more = [min(c, 2 * s + o if o else s) for c, s, o in zip(capacity, spare, over)]
        if not any(over) or more == spare or sum(more) > sum(supply[1].values()):
            break
    second = _moves(supply[1], [max(0, c - got.get(j, 0)) for j, c in enumerate(capacity)], n_old)
    shard = _cases(chain + _intervals(second, 1, F.col("mid"))).cast("int")
    flow = [[a + b for a, b in zip(x, y)] for x, y in zip(first, second)]

    # a block lies in one shard or few: for each, where its documents begin in the block and in the shard
    parts = placed.withColumn("shard", shard).groupBy("shard", *key).agg(F.count("*").alias("n"), F.min("within").alias("from"))
    seat = Window.partitionBy("shard").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    seats = parts.withColumn("seat", F.coalesce(F.sum("n").over(seat), F.lit(0))).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("from", "shard", "seat"))).alias("seats")
    )
    seats = cut(seats, "reshard")
    if n_blocks * n_old * 2 <= 200_000:
        seats = F.broadcast(seats)

    here = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_first(), "h", "size")
    out = (
        rows.repartitionByRange(shuffle_parts(spark), *key)
        .withColumn("within", within)
        .withColumn("nth", F.row_number().over(here))
        .join(seats, key)
        .withColumn("seat", F.element_at(F.filter("seats", lambda s: s["from"] <= F.col("within")), -1))
        .withColumn("shard", F.col("seat.shard"))
    )
    mine = Window.partitionBy(*key, "shard")
    out = out.withColumn("slot", (F.col("seat.seat") + F.col("nth") - F.min("nth").over(mine)).cast("long"))
    if only_affected:
        touched = [j for j in range(max(n_old, n_new)) if any(flow[i][j] for i in range(n_old) if i != j and j < n_new) or (j < n_old and any(x for k, x in enumerate(flow[j]) if k != j))]
        out = out.where(F.col("shard").isin(touched))
    path = new_path(spark, "shards")
    out.select("doc_id", "text", "size", "slot", "shard").write.partitionBy("shard").parquet(path)
    return path, flow


def _cases(chain: list[tuple[Column, int]]) -> Column:
    got = F.lit(0)
    for cond, j in reversed(chain):
        got = F.when(cond, F.lit(j)).otherwise(got)
    return got
