"""Skeletons: trees of nodes ``(tree, node, x, y, z)`` and edges ``(tree, src, dst)``, and how far labels follow them.

Node ids are unique within a tree only; every join is on (tree, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators.graph import connected_components


def node_labels(nodes: DataFrame, vox: DataFrame, start: tuple[int, int, int] = (0, 0, 0), size: tuple[int, int, int] | None = None) -> DataFrame:
    """Nodes with the label at their place, positions less ``start``; nodes outside ``size`` are left out."""
    rows = nodes.select("tree", "node", *[(F.col(a) - s).alias(a) for a, s in zip("xyz", start, strict=True)])
    if size:
        inside = [(F.col(a) >= 0) & (F.col(a) < n) for a, n in zip("xyz", size, strict=True)]
        rows = rows.where(inside[0] & inside[1] & inside[2])
    return rows.join(vox.select("x", "y", "z", "label"), ["x", "y", "z"])


def labelled_edges(nodes: DataFrame, edges: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Edges both of whose ends are in ``nodes``: lengths, labels of both ends, and whether they differ."""
    ends = [nodes.select("tree", F.col("node").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in (*"xyz", "label", *[k for k in nodes.columns if k == "param"])]) for e in ("src", "dst")]
    extra = ["param"] if "param" in nodes.columns else []
    rows = edges.join(ends[0].withColumnRenamed("src_param", "param"), ["tree", "src"]).join(ends[1].withColumnRenamed("dst_param", "param"), ["tree", "dst", *extra])
    square = [((F.col(f"src_{a}") - F.col(f"dst_{a}")) * s) ** 2 for a, s in zip("xyz", scale, strict=True)]
    return rows.select(*extra, "tree", "src", "dst", "src_label", "dst_label", F.sqrt(square[0] + square[1] + square[2]).alias("length"), (F.col("src_label") != F.col("dst_label")).alias("split"))


def path_length(edges: DataFrame, *keys: str) -> DataFrame:
    """Share of path length free of errors: edges within one label that no other tree shares.

    Labels that occur at nodes of several trees' edges are merge errors. ``keys``, such as a threshold, score separately
    in one job.
    """
    ends = edges.select(*keys, "tree", F.col("src_label").alias("label")).union(edges.select(*keys, "tree", "dst_label"))
    merged = ends.groupBy(*keys, "label").agg(F.countDistinct("tree").alias("trees")).where("trees > 1").select(*keys, "label", F.lit(True).alias("bad"))
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(merged.withColumnsRenamed({"label": f"{end}_label", "bad": f"{end}_bad"}), [*keys, f"{end}_label"], "left")
    error = F.col("split") | F.coalesce("src_bad", F.lit(False)) | F.coalesce("dst_bad", F.lit(False))
    free = F.sum(F.when(error, 0.0).otherwise(F.col("length")))
    return rows.groupBy(*keys).agg(free.alias("free_length"), F.sum("length").alias("length"), (free / F.sum("length")).alias("eftpl"), F.count_if("split").alias("splits"), F.count_if(error).alias("errors"))


def path_length_classes(edges: DataFrame, min_edges: int = 1, empty: int = 0) -> DataFrame:
    """Per error rule the error-free share: ``splits`` only, ``mergers`` only, both, or none; a label counts as merged if at
    least ``min_edges`` of each of several trees touch it; ends in ``empty`` count as splits."""
    ends = edges.select("tree", F.col("src_label").alias("label")).union(edges.select("tree", "dst_label")).where(F.col("label") != empty)
    strong = ends.groupBy("label", "tree").agg(F.count("*").alias("k")).where(F.col("k") >= min_edges)
    merged = strong.groupBy("label").agg(F.count("*").alias("trees")).where("trees > 1").select("label", F.lit(True).alias("bad"))
    rows = edges
    for end in ("src", "dst"):
        rows = rows.join(merged.withColumnsRenamed({"label": f"{end}_label", "bad": f"{end}_bad"}), f"{end}_label", "left")
    split = F.col("split") | (F.col("src_label") == empty) | (F.col("dst_label") == empty)
    merge = F.coalesce("src_bad", F.lit(False)) | F.coalesce("dst_bad", F.lit(False))
    share = lambda bad: F.sum(F.when(bad, 0.0).otherwise(F.col("length"))) / F.sum("length")
    return rows.agg(share(split).alias("splits"), share(merge).alias("mergers"), share(split | merge).alias("both"), share(F.lit(False)).alias("none"))


def free_paths(edges: DataFrame, error: Column) -> DataFrame:
    """Error-free pieces of each tree, components once erroneous edges are out: ``(tree, piece, edges, length)``."""
    fine = edges.where(~error)
    key = lambda c: F.xxhash64("tree", c)
    found = connected_components(fine.select(key("src").alias("src"), key("dst").alias("dst")))
    return fine.join(found, key("src") == F.col("node")).groupBy("tree", F.col("component").alias("piece")).agg(F.count("*").alias("edges"), F.sum("length").alias("length"))


def cleaned(nodes: DataFrame, edges: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Without edges to missing nodes, nodes without edges, and trees of fewer than ``least`` nodes."""
    keys = nodes.select("tree", "node")
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(keys.withColumnRenamed("node", end), ["tree", end], "left_semi")
    used = kept.select("tree", F.col("src").alias("node")).union(kept.select("tree", "dst")).distinct()
    alive = used.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("tree")
    return nodes.join(used, ["tree", "node"], "left_semi").join(alive, "tree", "left_semi"), kept.join(alive, "tree", "left_semi")


def cropped(nodes: DataFrame, edges: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """Nodes in a box, ends exclusive, and the edges between them."""
    inside = [(F.col(a) >= b) & (F.col(a) < e) for a, b, e in zip("xyz", low, high, strict=True)]
    return cleaned(nodes.where(inside[0] & inside[1] & inside[2]), edges)


def per_plane(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One point per z plane along each edge, by linear interpolation: ``(tree, src, dst, z, x, y)``."""
    ends = [nodes.select("tree", F.col("node").alias(e), *[F.col(a).alias(f"{a}_{e}") for a in "xyz"]) for e in ("src", "dst")]
    rows = edges.join(ends[0], ["tree", "src"]).join(ends[1], ["tree", "dst"])
    rows = rows.withColumn("z", F.explode(F.sequence(F.least("z_src", "z_dst"), F.greatest("z_src", "z_dst"))))
    part = F.when(F.col("z_src") == F.col("z_dst"), 0.0).otherwise((F.col("z") - F.col("z_src")) / (F.col("z_dst") - F.col("z_src")))
    return rows.select("tree", "src", "dst", "z", *[(F.col(f"{a}_src") + part * (F.col(f"{a}_dst") - F.col(f"{a}_src"))).alias(a) for a in "xy"])


def downsampled(nodes: DataFrame, ratio: int) -> DataFrame:
    """Nodes at their places in a volume of which every ``ratio``-th voxel is kept."""
    return nodes.withColumns({a: F.floor(F.col(a) / ratio).cast("int") for a in "xyz"})


def rasterised(nodes: DataFrame, radius: int) -> DataFrame:
    """Voxels within a ball about each node, labelled by the tree; of several trees the lowest."""
    span = range(-radius, radius + 1)
    ball = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a in span for b in span for c in span if a * a + b * b + c * c <= radius * radius])
    rows = nodes.select("tree", "x", "y", "z", F.explode(ball).alias("d"))
    return rows.groupBy(*[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "xyz"]).agg(F.min("tree").alias("label"))


def near_nodes(nodes: DataFrame, vox: DataFrame, radius: float, cell: int) -> DataFrame:
    """Labels within ``radius`` of each node: both sides meet by the node's cell, then by exact distance.

    Voxels go to every cell that they are within ``radius`` of; a node has one place, so its counts are whole there. The
    sides are sorted and merged: sizes estimated from files don't know of the copies, so a broadcast could be of any size.
    """
    rows = nodes.select("tree", "node", *[F.col(a).alias(f"n{a}") for a in "xyz"], *[F.floor(F.col(a) / cell).alias(f"c{a}") for a in "xyz"])
    side = vox.where("label <> 0").select("x", "y", "z", "label")
    for a in "xyz":
        side = side.withColumn(f"c{a}", F.explode(F.sequence(*[F.floor((F.col(a) + d) / cell) for d in (-radius, radius)])))
    far = [(F.col(a) - F.col(f"n{a}")) * (F.col(a) - F.col(f"n{a}")) for a in "xyz"]
    cells = ["cx", "cy", "cz"]
    met = rows.hint("merge").join(side, cells).where(far[0] + far[1] + far[2] <= radius * radius)
    return met.groupBy(*cells, "tree", "node", "label").agg(F.count("*").alias("n_vox")).drop(*cells)


def with_errors(edges: DataFrame, split_share: float, seed: int = 1) -> DataFrame:
    """A share of the edges taken out by a seeded hash, the same on every run, and the components that remain."""
    kept = edges.where(F.pmod(F.xxhash64(F.lit(seed), "tree", "src", "dst"), F.lit(1 << 20)) >= F.lit(int(split_share * (1 << 20))))
    key = lambda c: F.xxhash64("tree", c)
    found = connected_components(kept.select(key("src").alias("src"), key("dst").alias("dst")))
    return kept.join(found, key("src") == F.col("node")).drop("node")
