"""Shared helpers: table reads, Arrow-batch operators, work folders, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches carry at most this many documents, so a batch of long texts stays in memory.
BATCH_ROWS = 400
#: So many edges at most, 16 bytes each, are connected by the driver.
EDGES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, and let local workers import this package.

    On a cluster the package is installed or sent with ``--py-files``; the path added here is then unused.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    root = str(Path(__file__).resolve().parents[2])
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, names: list[str] | None = None, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; it returns the output columns by name, or None for no rows.

    ``done`` is called at the end of each partition: Python workers outlive their tasks, what they remember should not.
    """
    names = names or [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x) for n in names], names=names)
        if done is not None:
            done()
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def squeeze(df: DataFrame, column: str, *, back: bool = False) -> DataFrame:
    """``df`` with a text column as Zstandard frames, or as text again: for texts that cross several shuffles."""
    names = df.columns
    at = names.index(column)
    kinds = dict(df.dtypes) | {column: "string" if back else "binary"}
    pack = (lambda x: zstandard.ZstdDecompressor().decompress(x).decode()) if back else (lambda x: zstandard.ZstdCompressor(level=3).compress(x.encode()))

    def run(batch: pa.RecordBatch) -> dict:
        cells = [None if x is None else pack(x) for x in batch.column(at).to_pylist()]
        return {n: pa.array(cells, pa.string() if back else pa.binary()) if i == at else batch.column(i) for i, n in enumerate(names)}

    return map_batches(df, run, ", ".join(f"`{n}` {kinds[n]}" for n in names), names)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor and the driver share.

    Only where that setting is missing on one machine (tests) is a folder of our own used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/tidemark-work"
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


#: Drops a query's shuffle files once it has ended; what is written to a work folder needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(df: DataFrame) -> None:
    """Remove the work folder of a ``saved`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while (apart := root[u] != root[v]).any():
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while not np.array_equal(higher := root[root], root):
            root = higher
    return nodes, nodes[root]


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps: every step re-hangs each node's neighbours below the
    smallest one, so the number of rounds is logarithmic in the diameter, and each round is one grouped
    minimum plus one join on the node.  Minima combine before the shuffle, so a node with very many edges
    stays one row per task; no neighbour list is ever gathered.  Nodes without edges do not appear.
    At most EDGES edges between numbers are connected by the driver instead: a round's plan costs it more memory.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = saved(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if {kind for _, kind in e.dtypes} == {"bigint"} and 0 < e.count() <= EDGES:
        few = e.toArrow()
        forget(e)
        node, root = _roots(few["u"].to_numpy(), few["v"].to_numpy())
        return saved(spark.createDataFrame(pa.table({"node": node, "root": root}), "node bigint, root bigint"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = saved(step.distinct())
        # Done when every node hangs below one root and no root hangs below another.
        ends = new.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(new.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").limit(1).count()
        forget(e)
        e = new
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def text_key(doc_id: Column, text: Column) -> Column:
    """64-bit key of a row within its doc_id: repeated doc_ids with other texts stay apart."""
    return F.xxhash64(doc_id, text)
