"""Geometry of the borders between labels, and of labels: principal axes, ellipsoids, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.neighbours import adjacency


def border_voxels(vox: DataFrame, connectivity: int = 26) -> DataFrame:
    """``(a, b, x, y, z)``: distinct voxels on either side of each border."""
    pairs = adjacency(vox, connectivity)
    return pairs.select("a", "b", "x", "y", "z").distinct()


def moments(points: DataFrame, keys: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per group: count, centroid and covariances of scaled positions, by plain aggregation, so a group of any size is one row."""
    at = {a: F.col(a) * s for a, s in zip("xyz", scale, strict=True)}
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(at[a]).alias(f"c{a}") for a in "xyz"], *[F.covar_pop(at[a], at[b]).alias(f"k{a}{b}") for a, b in pairs], *[(F.max(at[a]) - F.min(at[a]) + s).alias(f"ext_{a}") for a, s in zip("xyz", scale, strict=True)])


def principal_axes(points: DataFrame, keys: list[str], scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Per group the variances along its principal axes, largest first, the main axis (its largest part positive), and the
    share of its box that it fills. A voxel's own extent adds s^2 / 12 per axis, so that flat groups have a defined axis."""
    rows = moments(points, keys, scale)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = list(rows.columns)

    def run(batches):
        for batch in batches:
            t = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            m = np.empty((batch.num_rows, 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    m[:, i, j] = t["k" + "".join(sorted(a + b))]
            m += np.diag(np.square(scale)) / 12
            values, axes = np.linalg.eigh(m)
            main = axes[:, :, 2]
            big = np.abs(main).argmax(1)
            main = main * np.sign(main[np.arange(len(main)), big])[:, None]
            fill = t["n"] * np.prod(scale) / (t["ext_x"] * t["ext_y"] * t["ext_z"])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(values[:, 2 - k]) for k in range(3)], *[pa.array(main[:, k]) for k in range(3)], pa.array(fill)], names=[*names, "var1", "var2", "var3", "axis_x", "axis_y", "axis_z", "box_fill"])

    schema = ", ".join(f"`{n}` {t}" for n, t in types.items()) + ", " + ", ".join(f"{n} double" for n in ("var1", "var2", "var3", "axis_x", "axis_y", "axis_z", "box_fill"))
    return rows.mapInArrow(run, schema)


def radial_spread(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the population deviation of the distance from its centroid."""
    centre = points.groupBy(*keys).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    far = [(F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"]
    return points.join(centre, keys).groupBy(*keys).agg(F.stddev_pop(F.sqrt(far[0] + far[1] + far[2])).alias("radial_std"))


def ellipsoids(vox: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Half axes of the solid ellipsoid with each label's moments, and the diameter of the sphere of its volume."""
    rows = principal_axes(vox.where("label <> 0"), ["label"], scale)
    volume = F.col("n") * float(np.prod(scale))
    return rows.select("label", "n", *[F.sqrt(5 * F.col(f"var{k}")).alias(f"half_axis{k}") for k in (1, 2, 3)], (2 * F.cbrt(3 * volume / (4 * 3.141592653589793))).alias("diameter"))


def nearest_neighbours(centres: DataFrame, k: int, cell: float) -> DataFrame:
    """``(label, other, rank)``: up to ``k`` nearest labels whose centres lie within a cell's width, a stand-in for a
    triangulation when partners to merge are drawn."""
    rows = centres
    for a in "xyz":
        rows = rows.withColumn(f"g{a}", F.floor(F.col(f"c{a}") / cell))
    near = rows
    for a in "xyz":
        near = near.withColumn(f"g{a}", F.explode(F.sequence(F.col(f"g{a}") - 1, F.col(f"g{a}") + 1)))
    other = near.select("gx", "gy", "gz", F.col("label").alias("other"), *[F.col(f"c{a}").alias(f"o{a}") for a in "xyz"])
    far = [(F.col(f"c{a}") - F.col(f"o{a}")) ** 2 for a in "xyz"]
    pairs = rows.join(other, ["gx", "gy", "gz"]).where("label <> other").withColumn("d2", far[0] + far[1] + far[2]).where(F.col("d2") <= cell * cell)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("d2", "other"))).where(F.col("rank") <= k).select("label", "other", "rank")


def augmented(vox: DataFrame, code: int, size: tuple[int, int, int]) -> DataFrame:
    """Bit-coded augmentation: 1, 2 and 4 reflect x, y and z; 8 swaps x and y."""
    out = vox
    for bit, (a, n) in zip((1, 2, 4), zip("xyz", size, strict=True), strict=True):
        if code & bit:
            out = out.withColumn(a, F.lit(n - 1) - F.col(a))
    swap = {"x": "y", "y": "x"}
    return out.select(*[F.col(swap.get(c, c)).alias(c) for c in vox.columns]) if code & 8 else out


def tile_index(indices: DataFrame, shape: tuple[int, int, int], tile: tuple[int, int, int], index: str = "idx") -> DataFrame:
    """Where a running tile number lies: the tile's first voxel on each axis, x fastest."""
    n = [s // t for s, t in zip(shape, tile, strict=True)]
    i = F.col(index)
    at = [i % n[0], F.floor(i / n[0]) % n[1], F.floor(i / (n[0] * n[1]))]
    return indices.withColumns({f"begin_{a}": (p * t).cast("long") for a, p, t in zip("xyz", at, tile, strict=True)})


def jackknife(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of a ratio's leave-one-group-out values and their standard error; ``value`` and ``length`` are summed per group."""
    per = rows.groupBy(group).agg(F.sum(value).alias("v"), F.sum("length").alias("l"))
    total = per.agg(F.sum("v").alias("tv"), F.sum("l").alias("tl"), F.count("*").alias("k"))
    left = per.crossJoin(F.broadcast(total)).select(((F.col("tv") - F.col("v")) / (F.col("tl") - F.col("l"))).alias("r"), "k")  # one row
    return left.agg(F.avg("r").alias("mean"), (F.sqrt((F.max("k") - 1) * F.var_pop("r"))).alias("std_error"))


def run_attributes(lines: DataFrame, patterns: dict[str, str], column: str = "value") -> DataFrame:
    """Attributes of a run out of its log lines, each by an expression with one group; the last line that matches counts."""
    rows = lines.withColumn("__at", F.monotonically_increasing_id())
    return rows.groupBy("file").agg(*[F.max_by(F.when(F.col(column).rlike(p), F.regexp_extract(column, p, 1)), F.when(F.col(column).rlike(p), F.col("__at"))).alias(name) for name, p in patterns.items()])
