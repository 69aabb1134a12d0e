"""Connected components of an edge list by alternating large and small stars.

A list of at most ``small`` edges, once counted, is finished by one task in memory; a longer one is not. There every step is a pre-aggregated minimum and a join, so no neighbourhood is collected in one place; a node with very many
edges is only a skewed join key, which adaptive execution splits (both sides of each join come straight from an exchange).
Each round is written to the shared folder and the loop ends when a round changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import materialise


def _spread(df: DataFrame) -> DataFrame:
    """A round-robin exchange, so that the join above deals this side anew and may split it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = _spread(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    return both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = _spread(edges.groupBy("u").agg(F.min("v").alias("m")))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(joined.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that edges a-b reach from each of n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = np.minimum(label, label[label])
        while (label != (further := label[label])).any():
            label = further
        if (label == before).all():
            return label


#: Edges that one task may hold: 16 MB as two columns of 64 bits.
SMALL = 1_000_000


def _finish(batches):
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = (table.column(c).to_numpy() for c in "uv")
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = spanning(len(nodes), at[: len(u)], at[len(u) :])
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[rest]), pa.array(nodes[label[rest]])], names=["u", "v"])


def stars(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (u, v) of 64-bit ids to one row (u, v) for each node that is not the least of its component, v being the least.

    Loops and repeated edges are allowed; null ends are not. No edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, "edges")
    if edges.count() <= small:
        return materialise(edges.coalesce(1).mapInArrow(_finish, "u long, v long"), "stars")
    mark = _mark(edges)
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    return edges
