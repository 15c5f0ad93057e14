"""Connected components on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.session import cut

#: Edges that one task contracts in memory before the distributed rounds.
EDGES_PER_TASK = 500_000


def forest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), sorted, and for each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        lu, lv = label[u], label[v]
        differ = lu != lv
        if not differ.any():
            break
        lu, lv = lu[differ], lv[differ]
        np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
        while not np.array_equal(label, hop := label[label]):
            label = hop
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if not parts:
        return
    node, root = forest_labels(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    keep = node != root
    yield pa.RecordBatch.from_arrays([pa.array(node[keep], pa.int64()), pa.array(root[keep], pa.int64())], names=["u", "v"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", loops: bool = True) -> DataFrame:
    """``(node, component)`` for every end of an edge; a component is named by its smallest node.

    Each task first replaces its share of the edges by a spanning star per local component; rounds of large-star and
    small-star contraction then join the shares. Minima are pre-aggregated before every shuffle, every round is
    materialised in the shared folder, and self loops name isolated nodes, unless ``loops`` says that there are none.
    Null ends are ignored.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    pairs = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = cut(pairs)
    alone = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    links = pairs.where("u <> v")
    count = links.count()
    if count == 0:
        return alone.select("node", F.col("node").alias("component"))
    tasks = -(-count // EDGES_PER_TASK)
    stars = cut(links.repartition(tasks).mapInArrow(_contract, "u long, v long"))
    before = None
    while tasks > 1:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.union(low).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    rooted = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    named = rooted.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if not loops:
        return named
    return named.union(alone.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
