"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import forget, shuffled, stored


#: Edges that are thinned out at once, and edges of a forest that a task holds before it passes them on.
EDGES, HELD = 1_000_000, 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node that it reaches; at most one for a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(i):
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        i, j = root[i], root[j]
        apart = i != j
        i, j = i[apart], j[apart]
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what edges connects, thinned out in each partition before anything is shuffled.

    Edges of one bucket lie together, and a bucket's pairs are many more than its records: at most about one edge for each of a
    partition's nodes is left. A task holds at most HELD + EDGES edges.
    """

    def run(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        a, b, n = [held[0]], [held[1]], 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], names=["u", "v"])
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= EDGES:
                held = forest(np.concatenate(a), np.concatenate(b))
                if len(held[0]) > HELD:
                    yield out(held)
                    held = (np.empty(0, np.int64), np.empty(0, np.int64))
                a, b, n = [held[0]], [held[1]], 0
        yield out(forest(np.concatenate(a), np.concatenate(b)))

    return edges.mapInArrow(run, "u long, v long")


def marked(e: DataFrame) -> tuple[DataFrame, tuple]:
    """e stored, and its size and checksum, which the same job observes as it writes."""
    seen = Observation()
    out = stored(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "cc")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, component for all nodes of edges (a, b: long); component is the smallest node that is reachable.

    Each round hangs every node's larger neighbours under its smallest one, then its smaller neighbours. Minima combine
    before the shuffle and hot nodes are one side of an equi-join that Spark can split. Edges are thinned out before the first round. Rounds are stored in the shared
    folder; stars come out in a few rounds, chains in a logarithmic number. Nothing is gathered on the driver but a count and a checksum.
    """
    e = edges.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e, was = marked(thinned(e).distinct())
    for _ in range(max_rounds if was[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = F.inline(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        new, now = marked(large.join(shuffled(low), "u").select(hung).where("u <> v").distinct())
        forget(e)
        e = new
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
