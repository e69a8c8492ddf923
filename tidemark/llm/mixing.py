"""Mixing sources to target weights by Pfair scheduling.

Every source is a periodic task whose share of the output is its target weight w, an exact fraction.  Its block number j
(from 0) may not be placed before floor(j / w) and must be placed before ceil((j + 1) / w); in each slot the released
block of earliest deadline is taken.  Since the weights add up to one this always succeeds, and after any number of
slots every source is less than one block from its share.

The whole schedule is simulated, one step for each block, and joined to the rows as a table of slots.  When a source is
used up the others go on with their weights renormalised, in a new phase.  No row is dropped or repeated.  Of very many
sources the small ones form pools: a pool is one source of the schedule, and mixed within by the same rule.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sources that one schedule takes, and a pool's; beyond them the smallest are pooled.
MAX_SOURCES, POOL = 2000, 100
#: Blocks in a row of the plan, and rows of a table up to which it is broadcast.
PLAN_BLOCKS, BROADCAST_ROWS = 1024, 4096
#: Rows that are ranked together.
RANK_ROWS = 2_000


def quotas(weights: Sequence[float], slots: int) -> list[int]:
    """Whole slots for each weight, at least one, by largest remainders; they add up to ``slots``."""
    total = sum(weights)
    exact = [w / total * slots for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    k = 0
    while sum(out) != slots:
        if sum(out) < slots:
            out[order[k % len(out)]] += 1
        else:
            i = max(range(len(out)), key=lambda i: (out[i] - exact[i], out[i]) if out[i] > 1 else (float("-inf"), 0))
            out[i] -= 1
        k += 1
    return out


def period(quota: Sequence[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    slots = sum(quota)
    waiting = [(0, -(-slots // q), s, 0) for s, q in enumerate(quota)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        deadline, s, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        out.append(s)
        if j + 1 < quota[s]:
            heapq.heappush(waiting, ((j + 1) * slots // quota[s], -(-(j + 2) * slots // quota[s]), s, j + 1))
    return out


def schedule(blocks: Sequence[int], weights: Sequence[float]) -> list[list[tuple[int, int, int, int, Sequence[int]]]]:
    """For each source its phases: first block, number of blocks, slot offset, slots of the phase, its slots in the phase."""
    exact = [Fraction(str(w)) if n > 0 else Fraction(0) for n, w in zip(blocks, weights, strict=True)]
    whole = lcm(*[w.denominator for w in exact])
    share = [w.numerator * (whole // w.denominator) for w in exact]
    left, done, offset = list(blocks), [0] * len(blocks), 0
    out: list[list[tuple[int, int, int, int, Sequence[int]]]] = [[] for _ in blocks]
    while active := [s for s, n in enumerate(left) if n > 0]:
        slots = {s: array("q") for s in active}
        if len(active) == 1:
            slots[active[0]] = array("q", range(left[active[0]]))
            end = left[active[0]]
        else:
            end = _phase(slots, {s: left[s] for s in active}, share)
        for s in active:
            if used := len(slots[s]):
                out[s].append((done[s], used, offset, end, slots[s]))
                done[s] += used
                left[s] -= used
        offset += end
    return out


def _phase(slots: dict[int, array], left: dict[int, int], share: Sequence[int]) -> int:
    """Earliest deadline first until a source is used up; fills ``slots`` and returns their number."""
    total = sum(share[s] for s in slots)
    waiting = [(0, -(-total // share[s]), s, 0) for s in slots]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j))
        deadline, s, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        slots[s].append(t)
        t += 1
        if j + 1 == left[s]:
            return t
        heapq.heappush(waiting, ((j + 1) * total // share[s], -(-(j + 2) * total // share[s]), s, j + 1))


def places(blocks: Sequence[int], weights: Sequence[float], most: int = MAX_SOURCES) -> list[np.ndarray]:
    """The slot of each block of each source; beyond ``most`` sources the smaller half of the entries are pools."""
    some = [s for s, n in enumerate(blocks) if n > 0]
    out = [np.zeros(0, np.int64) for _ in blocks]
    if len(some) <= most:
        for s, phases in enumerate(schedule(blocks, weights)):
            out[s] = np.concatenate([out[s], *[np.frombuffer(p, np.int64) + o for _, _, o, _, p in phases]])
        return out
    some.sort(key=lambda s: (-weights[s], s))
    alone, rest = some[: most // 2], some[most // 2 :]
    entries = [[s] for s in alone] + [x.tolist() for x in np.array_split(np.array(rest), most - len(alone))]
    of = places([sum(blocks[s] for s in e) for e in entries], [sum(Fraction(str(weights[s])) for s in e) for e in entries], most)
    for entry, slots in zip(entries, of, strict=True):
        for s, inner in zip(entry, places([blocks[s] for s in entry], [weights[s] for s in entry], POOL), strict=True):
            out[s] = slots[inner]
    return out


def mix(docs: DataFrame, *, weights: Mapping[str | None, float] | None = None, exponent: float = 0.5, block_rows: int = 64, columns: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """Give every row its place in the mixture: rows ``*columns, block, slot, position``.

    ``weights`` are target weights by source (sources without one, or with a weight of 0 or less, follow when all others
    are used up, in proportion to their blocks); by default a source of n rows weighs ``n ** exponent``.  A block is
    ``block_rows`` rows of one source in the order of a hash of doc_id, ``block`` its number in the source, ``slot`` its
    place in the schedule, and ``position`` the row's place, 0 to n - 1.  A null source is a source of its own; null and
    repeated doc_ids are rows like others; an empty table gives no rows.  Needs ``doc_id`` and ``source``.  Beyond
    ``MAX_SOURCES`` sources the lighter ones keep their share within less than a block of their pool's blocks.
    """
    spark = docs.sparkSession
    counts = sorted(((r["source"], r["n"]) for r in docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    blocks = [-(-n // block_rows) for _, n in counts]
    weight = [n**exponent if weights is None else max(0.0, weights.get(s, 0.0)) for s, n in counts]
    first = places([b if w > 0 else 0 for b, w in zip(blocks, weight, strict=True)], weight)
    then = places([0 if w > 0 else b for b, w in zip(blocks, weight, strict=True)], [float(b) for b in blocks])
    used = sum(map(len, first))
    slots = [a if len(a) else b + used for a, b in zip(first, then, strict=True)]
    # A source's last block may be short; rows behind it move up.
    short = sorted((int(a[-1]), block_rows - n % block_rows) for (_, n), a in zip(counts, slots, strict=True) if n % block_rows)
    moved = np.cumsum([0, *[n for _, n in short]])
    short_at = np.array([at for at, _ in short], np.int64)
    names, chunks, at_, start_ = [], [], [], []
    for (s, _), a in zip(counts, slots, strict=True):
        for k in range(0, len(a), PLAN_BLOCKS):
            part = a[k : k + PLAN_BLOCKS]
            names.append(s), chunks.append(k // PLAN_BLOCKS), at_.append(part), start_.append(part * block_rows - moved[np.searchsorted(short_at, part)])
    ends = pa.array(np.cumsum([0, *map(len, at_)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (at_, start_)]
    plan = _table(spark, pa.table({"__source": pa.array(names, pa.string()), "__chunk": pa.array(chunks, pa.int64()), "__slots": lists[0], "__starts": lists[1]}))
    table = _table(spark, pa.table({"__source": pa.array([s for s, _ in counts], pa.string()), "__parts": pa.array([-(-n // RANK_ROWS) for _, n in counts], pa.int64())}))
    rows = docs.select(*[F.col(c) for c in columns], F.col("source").cast("string").alias("__s"), F.xxhash64("doc_id").alias("__h"), F.col("doc_id").alias("__d"))
    rows = rows.join(table, F.col("__s").eqNullSafe(F.col("__source")))
    rows = rows.withColumn("__part", F.pmod("__h", "__parts"))
    # Rank within parts of a source, then add the sizes of the parts before: no task holds a whole source.
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__part").orderBy("__h", "__d")))
    sizes = docs.select(F.col("source").cast("string").alias("__s"), F.xxhash64("doc_id").alias("__h"))
    sizes = sizes.join(table, F.col("__s").eqNullSafe(F.col("__source")))
    sizes = sizes.groupBy("__s", F.pmod("__h", "__parts").alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__s").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("__s").alias("__s2"), F.col("__part").alias("__p2"), before.alias("__before"))
    ranked = ranked.join(offsets, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__part") == F.col("__p2")))
    placed = ranked.drop("__source", "__parts").withColumn("__r", F.col("__before") + F.col("__rank") - 1).withColumn("block", F.floor(F.col("__r") / block_rows))
    placed = placed.join(plan, F.col("__s").eqNullSafe(F.col("__source")) & (F.floor(F.col("block") / PLAN_BLOCKS) == F.col("__chunk")))
    in_chunk = f"cast(block % {PLAN_BLOCKS} as int)"
    return placed.select(*columns, F.col("block").cast("bigint").alias("block"), F.expr(f"__slots[{in_chunk}]").alias("slot"), (F.expr(f"__starts[{in_chunk}]") + F.col("__r") % block_rows).alias("position"))


def _table(spark: SparkSession, rows: pa.Table) -> DataFrame:
    """A small table is broadcast; a large one is joined by shuffle if Spark so decides."""
    df = spark.createDataFrame(rows)
    return F.broadcast(df) if rows.num_rows <= BROADCAST_ROWS else df
