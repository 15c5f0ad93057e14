"""Neighbour operators on voxel tables ``(x, y, z, ...)``: adjacency graph, adjacency removal, resampling, local sums."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(connectivity: int, forward: bool = True) -> list[tuple[int, int, int]]:
    """Steps to 6, 18 or 26 neighbours; ``forward`` gives one of each opposite pair."""
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= reach]
    return [d for d in steps if not forward or d > (0, 0, 0)]


def shifted(vox: DataFrame, steps: list[tuple[int, int, int]], *columns: str) -> DataFrame:
    """One row per voxel and step, at the place it steps to: ``(x, y, z, <column>_n ...)``."""
    every = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(("dx", "dy", "dz"), d, strict=True)]) for d in steps])
    rows = vox.select("x", "y", "z", *columns, F.explode(every).alias("d"))
    return rows.select((F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("z") + F.col("d.dz")).alias("z"), *[F.col(c).alias(f"{c}_n") for c in columns])


def adjacency(vox: DataFrame, connectivity: int = 26, label: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of neighbouring voxels with different labels other than 0, a < b; ``keep`` columns of both sides follow."""
    fore = vox.where(F.col(label) != 0)
    near = shifted(fore, offsets(connectivity), label, *keep)
    pairs = fore.join(near, ["x", "y", "z"]).where(F.col(label) != F.col(f"{label}_n"))
    return pairs.select(F.least(label, f"{label}_n").alias("a"), F.greatest(label, f"{label}_n").alias("b"), "x", "y", "z", *keep, *[f"{c}_n" for c in keep])


def adjacency_graph(vox: DataFrame, connectivity: int = 26, label: str = "label") -> DataFrame:
    """Edges between neighbouring labels with the number of voxel pairs at the border."""
    return adjacency(vox, connectivity, label).groupBy("a", "b").agg(F.count("*").alias("n_pairs"))


def adjacency_limited(vox: DataFrame, labels: DataFrame, connectivity: int = 26) -> DataFrame:
    """Edges among the given labels only."""
    return adjacency_graph(vox.join(labels, "label", "left_semi"), connectivity)


#: Steps of the 3x3x3 element cut to its lower triangle on the last two axes (x, y, z order: dz <= dy).
CUT_STEPS = [d for d in product((-1, 0, 1), repeat=3) if d != (0, 0, 0) and d[2] <= d[1]]


def adjacency_removed(vox: DataFrame, steps: list[tuple[int, int, int]] | None = None, label: str = "label") -> DataFrame:
    """Voxels that have, at one of the steps, a neighbour with another label other than 0 become background.

    All decisions read the unchanged labels, so their order doesn't matter.
    """
    fore = vox.where(F.col(label) != 0).select("x", "y", "z", label)
    back = [(-a, -b, -c) for a, b, c in (steps or CUT_STEPS)]
    touching = fore.join(shifted(fore, back, label), ["x", "y", "z"]).where(F.col(label) != F.col(f"{label}_n")).select("x", "y", "z").distinct().withColumn("__hit", F.lit(True))
    return vox.join(touching, ["x", "y", "z"], "left").withColumn(label, F.when(F.col("__hit"), F.lit(0)).otherwise(F.col(label))).drop("__hit")


def edges_removed_6(vox: DataFrame, label: str = "label") -> DataFrame:
    """As above for the three forward face neighbours, before components are labelled anew."""
    return adjacency_removed(vox, offsets(6), label)


def dilated(vox: DataFrame, connectivity: int = 6, label: str = "label") -> DataFrame:
    """``(x, y, z, label)``: each label and what one dilation adds to it; labels may overlap."""
    fore = vox.where(F.col(label) != 0).select("x", "y", "z", label)
    grown = shifted(fore, offsets(connectivity, forward=False), label).select("x", "y", "z", F.col(f"{label}_n").alias(label))
    inside = vox.select("x", "y", "z")
    return fore.union(grown.join(inside, ["x", "y", "z"], "left_semi")).distinct()


def affinity_targets(vox: DataFrame, label: str = "label") -> DataFrame:
    """Whether the forward neighbour on each axis has the same label other than 0."""
    out = vox
    for k, a in enumerate("xyz"):
        step = tuple(1 if i == k else 0 for i in range(3))
        near = shifted(vox, [tuple(-v for v in step)], label).withColumnRenamed(f"{label}_n", f"__{a}")
        out = out.join(near, ["x", "y", "z"], "left").withColumn(f"aff_{a}", F.coalesce((F.col(f"__{a}") == F.col(label)) & (F.col(label) != 0), F.lit(False)).cast("int")).drop(f"__{a}")
    return out


def border_class(vox: DataFrame, label: str = "label") -> DataFrame:
    """Class of each voxel: 0 background, 2 beside another label along an axis, else 1."""
    steps = offsets(6, forward=False)
    near = vox.select("x", "y", "z", label).where(F.col(label) != 0)
    hit = near.join(shifted(near, steps, label), ["x", "y", "z"]).where(F.col(label) != F.col(f"{label}_n")).select("x", "y", "z").distinct().withColumn("__b", F.lit(True))
    return vox.join(hit, ["x", "y", "z"], "left").withColumn("class", F.when(F.col(label) == 0, 0).when(F.col("__b"), 2).otherwise(1)).drop("__b")


def downsampled(vox: DataFrame, factor: int, how: str, value: str) -> DataFrame:
    """Blocks of ``factor`` cubed: ``none`` the corner, ``labels`` the corner or 0 if any voxel is 0, ``mean`` or ``median``."""
    cell = [F.floor(F.col(a) / factor).cast("long").alias(a) for a in "xyz"]
    if how == "none":
        corner = [F.col(a) % factor == 0 for a in "xyz"]
        return vox.where(corner[0] & corner[1] & corner[2]).select(*cell, value)
    first = F.min_by(value, F.struct("z", "y", "x"))
    made = {"labels": F.when(F.min(F.abs(value)) == 0, F.lit(0)).otherwise(first), "mean": F.avg(value), "median": F.median(value)}[how]
    return vox.groupBy(*cell).agg(made.alias(value))


def upsampled(vox: DataFrame, factor: int) -> DataFrame:
    """Each voxel repeated ``factor`` times on each axis."""
    rows = vox
    for a in "xyz":
        rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn(a, F.col(a) * factor + F.col("__k"))
    return rows.drop("__k")


def window_sums(tiles: DataFrame, keys: list[str], size: int, value: str = "v") -> DataFrame:
    """Sums over ``size`` by ``size`` windows of each tile's rows and columns ``(r, c)``, full windows only, by their last cell."""
    along = Window.partitionBy(*keys, "r").orderBy("c").rowsBetween(1 - size, 0)
    down = Window.partitionBy(*keys, "c").orderBy("r").rowsBetween(1 - size, 0)
    rows = tiles.withColumn("__s", F.sum(value).over(along)).where(F.col("c") >= size - 1)
    return rows.withColumn("window_sum", F.sum("__s").over(down)).where(F.col("r") >= size - 1).drop("__s", value)


def block_means(tiles: DataFrame, keys: list[str], size: int, value: str = "v") -> DataFrame:
    return tiles.groupBy(*keys, F.floor(F.col("r") / size).cast("long").alias("r"), F.floor(F.col("c") / size).cast("long").alias("c")).agg(F.avg(value).alias("mean"))


def box(x: tuple[int, int], y: tuple[int, int], z: tuple[int, int]) -> Column:
    """Whether a voxel is in a box, ends exclusive: plain comparisons, so they reach the scan."""
    return (F.col("x") >= x[0]) & (F.col("x") < x[1]) & (F.col("y") >= y[0]) & (F.col("y") < y[1]) & (F.col("z") >= z[0]) & (F.col("z") < z[1])
