"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of b bits is cut into segments of 16 bits; each segment has its own table from value to rows.  Two codes within
distance m (r + 1) - 1, m segments, agree within r bits in one segment at least.  A query therefore visits the
table entries at radius 0, 1, 2 ... of each of its segments, verifies every new row's full Hamming distance, and stops
as soon as its k-th best distance is at most m (r + 1) - 1: everything that near has then been seen, ties included.

The rows are dealt to shards by a hash; every shard holds its tables once and answers all queries, which stream through
it in blocks.  The best k of all shards are the best k.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_batches, small_batches

SEGMENT = 16
SHARD_ROWS = 16_384


def sign_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64) -> DataFrame:
    """Rows ``id, code``: bit i tells whether component i is 0 or more, packed; ``bits`` is rounded up to segments.

    Rows with a null id or vector have no code.  Missing and null components, and NaN, count as negative.
    """
    width = -(-bits // SEGMENT) * SEGMENT

    def run(batch: pa.RecordBatch) -> dict:
        flags = np.zeros((batch.num_rows, width), np.uint8)
        for i, v in enumerate(batch.column(1).to_pylist()):
            x = np.array([np.nan if c is None else c for c in v[:width]], np.float64)
            flags[i, : len(x)] = x >= 0
        return {"id": batch.column(0), "code": pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())}

    some = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    return map_batches(some, run, "id bigint, code binary")


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), radius)], np.int64)


class Tables:
    """Multi-index hash tables of one shard."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, np.ascontiguousarray(codes)
        parts = self.codes.view(">u2").astype(np.int64)
        self.rows = [np.argsort(p, kind="stable") for p in parts.T]
        self.first = [np.searchsorted(p[r], np.arange((1 << SEGMENT) + 1)) for p, r in zip(parts.T, self.rows, strict=True)]
        self.masks: list[np.ndarray] = []

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest by (distance, id)."""
        m = len(self.rows)
        segments = code.view(">u2").astype(np.int64)
        fresh = np.ones(len(self.ids), bool)
        near, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(SEGMENT + 1):
            if r == len(self.masks):
                self.masks.append(_masks(r))
            found = []
            for s in range(m):
                value = segments[s] ^ self.masks[r]
                a, n = self.first[s][value], self.first[s][value + 1] - self.first[s][value]
                a, n = a[n > 0], n[n > 0]
                if len(a):
                    found.append(self.rows[s][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
            if found:
                rows = np.concatenate(found)
                rows = np.unique(rows[fresh[rows]])
                fresh[rows] = False
                far = np.bitwise_count(self.codes[rows] ^ code).sum(1).astype(np.int64)
                near, dist = np.concatenate([near, rows]), np.concatenate([dist, far])
                best = np.lexsort((self.ids[near], dist))[:k]
                near, dist = near[best], dist[best]
            if len(near) == min(k, len(self.ids)) and (len(near) == len(self.ids) or dist[-1] <= m * (r + 1) - 1):
                break
        return self.ids[near], dist


def top_k(vectors: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64, every: int = 50, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest codes of every query row: rows ``query_id, rank, neighbor_id, distance``.

    Queries are the rows whose id is divisible by ``every``; they are searched in all rows, themselves included.  Ranks
    go by (distance, id), so ties are settled.  Fewer than k rows give fewer ranks.  Rows with a null id or vector are
    neither queries nor answers; a repeated row is an answer as often as it occurs, and one query.
    """
    spark = vectors.sparkSession
    codes = sign_codes(vectors, id_col=id_col, vector_col=vector_col, bits=bits)
    shards = max(1, -(-vectors.where(F.col(id_col).isNotNull()).count() // shard_rows))
    rows = codes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "code")
    asked = codes.where(F.col("id") % every == 0).dropDuplicates(["id"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tables, ids, held = None, None, [], []
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, kind, i, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, tables, ids, held = s, None, [], []
                if kind == 0:
                    ids.append(i)
                    held.append(code)
                    continue
                if tables is None:
                    data = np.frombuffer(b"".join(held), np.uint8).reshape(len(ids), -1) if ids else None
                    tables = Tables(np.array(ids, np.int64), data) if ids else 0
                if tables:
                    near, dist = tables.search(np.frombuffer(code, np.uint8), k)
                    out.append((np.full(len(near), i), near, dist))
            if out:
                q, n, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, n, d)], names=["query_id", "neighbor_id", "distance"])

    small_batches(spark)
    dealt = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    best = dealt.mapInArrow(run, "query_id bigint, neighbor_id bigint, distance bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return best.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
