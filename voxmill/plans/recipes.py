"""Fixed chains of operators: watershed over thresholds, label checking and proofing, evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators import kernels, metrics, skeleton
from voxmill.operators.agglomerate import agglomerated, merged_volume, slice_links
from voxmill.operators.graph import connected_components, forest_labels
from voxmill.operators.grid import with_halo
from voxmill.operators.labels import relabelled, sequential_relabel, size_filter
from voxmill.operators.neighbours import edges_removed_6
from voxmill.session import cut


METHODS = ("comps", "comps-ws", "skim-ws", "overlap")


def source_classes(types: np.ndarray, n_types: int, smallest: int = 0) -> np.ndarray:
    """Class probabilities 0 and 1 from labelled types: an alternative source of the watershed.

    With ``smallest`` of 2 or more, holes of fewer voxels in a foreground type and then its parts of fewer are dropped;
    what is left of no type is background.
    """
    if smallest < 2:
        return np.stack([(types == k).astype(float) for k in range(n_types)])
    out = np.zeros((n_types, *types.shape))
    for k in range(1, n_types):
        around = kernels.components(types != k, 6)
        inside = kernels.components(~np.isin(around, _of_size(around, smallest)), 6)
        out[k] = np.isin(inside, _of_size(inside, smallest))
    out[0] = ~out[1:].any(0)
    return out


def _of_size(labels: np.ndarray, smallest: int) -> np.ndarray:
    sizes = np.bincount(labels.ravel())
    return np.flatnonzero((sizes >= smallest) & (np.arange(len(sizes)) > 0))


def linked_planes(seeds: np.ndarray, own: np.ndarray, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Components of each plane, grown within ``own`` of that plane; those of neighbouring planes that overlap are one."""
    planes, top = np.zeros(seeds.shape, np.int64), 0
    for z in range(len(seeds)):
        found = kernels.components(seeds[z : z + 1], 6)
        grown = np.where(own[z : z + 1], kernels.nearest_fill(found, scale, own[z : z + 1]), 0)[0]
        planes[z] = np.where(grown > 0, grown + top, 0)
        top += int(found.max(initial=0))
    over = (planes[:-1] > 0) & (planes[1:] > 0)
    every = np.arange(1, top + 1)
    nodes, roots = forest_labels(np.concatenate([planes[:-1][over], every]), np.concatenate([planes[1:][over], every]))
    names = np.zeros(top + 1, np.int64)
    names[nodes] = np.unique(roots, return_inverse=True)[1] + 1
    return names[planes]


def _apart(labels: np.ndarray, connectivity: int) -> np.ndarray:
    """Labels without voxels whose forward face neighbour has another one, in components anew."""
    apart = labels.copy()
    for axis in range(3):
        a, b = np.moveaxis(labels, axis, 0)[:-1], np.moveaxis(labels, axis, 0)[1:]
        np.moveaxis(apart, axis, 0)[:-1][(a != b) & (a > 0) & (b > 0)] = 0
    return kernels.components(apart > 0, connectivity, apart)


def watershed_cube(classes: np.ndarray, thresholds: list[float], smallest: int | list[int], connectivity: int = 6, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), method: str = "comps", close: int = 0, fixed: dict[int, int] | None = None, saved: list[float] | None = None) -> dict:
    """Supervoxels of one cube at every threshold, from class probabilities ``[class, z, y, x]``, class 0 background.

    The likeliest class of a voxel, of equal ones the first, may only grow in its own voxels. As thresholds rise, components
    smaller than ``smallest`` are kept as seeds, so small objects survive. A class's components then grow within it: by
    simple points (``comps``), by simple points as the thresholds step back (``comps-ws``), by flooding of its
    probabilities from the components (``skim-ws``), or plane by plane (``overlap``). Three labellings: ``with_background``,
    whose components fill their own class and leave background 0; ``zero_background``, where the nearest label fills
    background too, so no 0 is left; and ``no_adjacencies``, the components before they fill their class, which nowhere touch.

    ``close``: radius of a grey closing of background and opening of the others beforehand. ``fixed``: one label for all
    of a class. ``saved``: the thresholds to return. Keys are thresholds or, for several ``smallest``, (smallest, threshold).
    """
    if method not in METHODS:
        raise ValueError(method)
    if close:
        classes = np.stack([kernels.grey_closed(classes[0], close), *[kernels.grey_opened(c, close) for c in classes[1:]]])
    won, order, made = classes.argmax(0), sorted(thresholds), {}
    for least in smallest if isinstance(smallest, list) else [smallest]:
        whole = {t: np.zeros(won.shape, np.int64) for t in order}
        parts = {t: np.zeros(won.shape, np.int64) for t in order}
        tops = {t: [0, 0] for t in order}
        for kind in range(1, len(classes)):
            own = won == kind
            p = np.where(own, classes[kind], 0.0)
            seeds = np.zeros(won.shape, bool)
            for i, t in enumerate(order):
                found = kernels.components(p > t, connectivity)
                start = (found > 0) | seeds
                if i < len(order) - 1:
                    small = np.bincount(found.ravel()) < least
                    small[0] = False
                    seeds |= small[found]
                if method == "overlap":
                    grown = linked_planes(start, own, scale)
                    apart = _apart(grown, connectivity)
                elif method == "skim-ws":
                    grown = kernels.flooded(p, kernels.components(start, connectivity), own, connectivity)
                    apart = _apart(grown, connectivity)
                else:
                    image = start
                    if method == "comps-ws":
                        for lower in order[:i][::-1]:
                            image = kernels.warp(image, own, own & (p > lower))
                    image = kernels.warp(image, own, own) if method == "comps" or i < 2 else image
                    grown = apart = kernels.components(image, connectivity)
                filled = np.where(own, kernels.nearest_fill(grown, scale, own), 0)
                for k, (out, labels) in enumerate(((whole[t], filled), (parts[t], apart))):
                    at = labels > 0
                    if fixed and kind in fixed:
                        out[at] = fixed[kind]
                        tops[t][k] += 1
                    else:
                        out[at] = labels[at] + tops[t][k]
                        tops[t][k] += int(labels.max(initial=0))
        for t in order:
            if saved is None or t in saved:
                made[(least, t) if isinstance(smallest, list) else t] = {"with_background": whole[t], "zero_background": kernels.nearest_fill(whole[t], scale), "no_adjacencies": parts[t]}
    return made


def watershed(probs: DataFrame, classes: list[str], thresholds: list[float], smallest: int | list[int], block: int, halo: int, **more) -> DataFrame:
    """``(bx, by, bz, smallest, threshold, x, y, z, with_background, zero_background, no_adjacencies, type)``: the cube recipe on each block with its halo.

    Labels are local to a block; blocks keep their halo, so that overlaps can be stitched.
    """
    schema = "bx int, by int, bz int, smallest int, threshold double, x long, y long, z long, with_background long, zero_background long, no_adjacencies long, type int"

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        x, y, z = (table[a].to_numpy() for a in "xyz")
        low = np.array([z.min(), y.min(), x.min()])
        spots = (z - low[0], y - low[1], x - low[2])
        cube = np.zeros((len(classes), *(np.array([z.max(), y.max(), x.max()]) - low + 1)))
        for k, c in enumerate(classes):
            cube[k][spots] = table[c].to_numpy()
        number, tables = [k.as_py() for k in keys], []
        for key, made in watershed_cube(cube, thresholds, smallest, **more).items():
            t, n = (key[1] if isinstance(key, tuple) else key), len(x)
            tables.append(pa.table({**{f"b{a}": pa.array([v] * n, pa.int32()) for a, v in zip("xyz", number)}, "smallest": pa.array([key[0] if isinstance(key, tuple) else smallest] * n, pa.int32()), "threshold": [t] * n, "x": x.astype(np.int64), "y": y.astype(np.int64), "z": z.astype(np.int64), **{k: v[spots].astype(np.int64) for k, v in made.items()}, "type": cube.argmax(0)[spots].astype(np.int32)}))
        return pa.concat_tables(tables)

    return with_halo(probs.select("x", "y", "z", *classes), block, halo).groupBy("bx", "by", "bz").applyInArrow(run, schema)


def label_check(vox: DataFrame, smallest: int, block: int, sigma: float = 1.0) -> DataFrame:
    """Smooth, part touching labels, label components anew, drop small ones, fill cavities of any extent."""
    halo = int(4 * sigma + 1)
    smooth = kernels.over_blocks(vox, lambda c: kernels.smoothed_labels(c, sigma), block, halo)
    apart = edges_removed_6(smooth)
    parts = kernels.block_components(apart, block).withColumnRenamed("component", "label")
    whole = vox.select("x", "y", "z").join(parts, ["x", "y", "z"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return cavities_filled(size_filter(whole, smallest), block)


def cavities_filled(vox: DataFrame, block: int, scale: tuple[float, float, float] = (1.0, 1.0, 1.0), connectivity: int = 6) -> DataFrame:
    """``(x, y, z, label)``: background that no side face of the whole volume (x or y ends) reaches takes the nearest label.

    Background components run over blocks, so a cavity may be of any extent; top and bottom planes don't count.
    """
    vox = vox.select("x", "y", "z", F.col("label").cast("long").alias("label"))
    found = kernels.block_components(vox.where("label = 0").withColumn("empty", F.lit(1)), block, "empty", connectivity)
    ends = vox.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xy" for f in (F.min, F.max)])
    side = (F.col("x") == F.col("min_x")) | (F.col("x") == F.col("max_x")) | (F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y"))
    reached = found.crossJoin(F.broadcast(ends)).where(side).select("component").distinct()  # one row of ends
    inner = cut(found.join(reached, "component", "left_anti").select("x", "y", "z").withColumn("inner", F.lit(True)))
    if inner.isEmpty():
        return vox
    filled = kernels.nearest_fill_all(vox, block, scale).select("x", "y", "z", F.col("label").alias("near"))
    rows = vox.join(inner, ["x", "y", "z"], "left").join(filled, ["x", "y", "z"])
    return rows.select("x", "y", "z", F.when(F.col("inner"), F.col("near")).otherwise(F.col("label")).alias("label"))


def small_cavity_labels_removed(vox: DataFrame, smallest: int, block: int) -> DataFrame:
    """Labels of fewer than ``smallest`` voxels that lie in cavities give way to what fills these; others come back; then
    labels are numbered anew. A label linked to the outside through other such labels stays."""
    own = vox.select("x", "y", "z", F.col("label").cast("long").alias("label"))
    large = size_filter(own, smallest, relabel=False)
    filled = cavities_filled(large, block).select("x", "y", "z", F.col("label").alias("near"))
    back = own.join(filled, ["x", "y", "z"]).select("x", "y", "z", F.when(F.col("near") == 0, F.col("label")).otherwise(F.col("near")).alias("label"))
    return size_filter(back, 1)


def ecs_replaced(vox: DataFrame, n_inner: int, ecs_label: int, shift: int = 0) -> DataFrame:
    """Labels above ``n_inner``, extracellular, become one label; the others, but 0, are moved up by ``shift``."""
    label = F.col("label")
    return vox.withColumn("label", F.when(label > n_inner, F.lit(ecs_label)).when(label > 0, label + shift).otherwise(label).cast("long"))


def scrub(vox: DataFrame, smallest: int, block: int = 0) -> DataFrame:
    """Labels below a size become background or, given a block, are filled from the nearest label."""
    kept = size_filter(vox.select("x", "y", "z", "label"), smallest)
    return kernels.nearest_fill_all(kept, block) if block else kept


def label_proof(vox: DataFrame, size: tuple[int, int, int], smallest: int = 28) -> DataFrame:
    """Corners zeroed, labels in sequence, small ones dropped."""
    ends = [F.col(a).isin(0, n - 1) for a, n in zip("xyz", size, strict=True)]
    zeroed = vox.withColumn("label", F.when(ends[0] & ends[1] & ends[2], 0).otherwise(F.col("label")))
    return size_filter(sequential_relabel(zeroed), smallest)


def linked_slices(vox: DataFrame) -> DataFrame:
    """Labels of slices that lie over each other become one, named by the smallest."""
    links = slice_links(vox).withColumnsRenamed({"a": "src", "b": "dst"})
    own = vox.where("label <> 0").select(F.col("label").alias("src"), F.col("label").alias("dst")).distinct()
    found = connected_components(links.union(own))
    return relabelled(vox, found.select(F.col("node").alias("old"), F.col("component").alias("new")))


def merge_edges(vox: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    return merged_volume(vox, agglomerated(edges, F.col("p") > threshold))


def evaluation(vox: DataFrame, truth: str, nodes: DataFrame, edges: DataFrame, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> dict[str, DataFrame]:
    """Rand metrics, variation of information and error-free path length of one labelling."""
    table = metrics.contingency(vox, truth, "label", drop_background=True)
    followed = skeleton.labelled_edges(skeleton.node_labels(nodes, vox), edges, scale)
    return {"rand": metrics.rand_metrics(table), "information": metrics.variation_of_information(table), "path_length": skeleton.path_length(followed)}


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as CSV with a header."""
    scores.write.mode("append").option("header", True).csv(path)
