"""Merging of labels: features of borders, thresholds, components, stitching of overlapping volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.graph import connected_components
from voxmill.operators.labels import best_overlap, relabelled
from voxmill.operators.neighbours import adjacency, offsets, shifted
from voxmill.session import cut


def voxel_components(vox: DataFrame, same: str, size: tuple[int, int, int], connectivity: int = 6) -> DataFrame:
    """``(idx, component)`` of voxels with a value of ``same`` other than null: neighbours with equal values are one.

    A component is named by its smallest linear index, x fastest.
    """
    rows = vox.where(F.col(same).isNotNull()).select("x", "y", "z", F.col(same).alias("s"), (F.col("x") + size[0] * (F.col("y") + size[1] * F.col("z"))).cast("long").alias("idx"))
    near = shifted(rows, offsets(connectivity), "s", "idx")
    edges = rows.join(near, ["x", "y", "z"]).where("s = s_n").select(F.col("idx").alias("src"), F.col("idx_n").alias("dst"))
    found = connected_components(edges.union(rows.select("idx", "idx")))
    return found.select(F.col("node").alias("idx"), "component")


def affinity_components(edges: DataFrame, threshold: float) -> DataFrame:
    """Components over edges ``(src, dst, weight)`` above a threshold; single voxels have none and so become background."""
    return connected_components(edges.where(F.col("weight") > threshold)).select(F.col("node").alias("idx"), "component")


def edge_features(vox: DataFrame, connectivity: int = 26, value: str = "v") -> DataFrame:
    """Per edge of the adjacency graph: border pairs, mean of the values at the border, its centroid, sizes of both labels
    as (smaller, larger) and their ratio's logarithm."""
    pairs = adjacency(vox, connectivity, keep=(value,))
    grouped = pairs.groupBy("a", "b").agg(F.count("*").alias("n_pairs"), F.avg((F.col(value) + F.col(f"{value}_n")) / 2.0).alias("mean_value"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    sizes = vox.where("label <> 0").groupBy("label").agg(F.count("*").alias("n"))
    ends = [sizes.select(F.col("label").alias(e), F.col("n").alias(f"n_{e}")) for e in "ab"]
    rows = grouped.join(ends[0], "a").join(ends[1], "b")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return rows.select("a", "b", "n_pairs", "mean_value", "cx", "cy", "cz", small.alias("n_small"), large.alias("n_large"), F.log10(large / small).alias("log_ratio"))


def agglomerated(edges: DataFrame, condition) -> DataFrame:
    """``(old, new)`` after merging the ends of the edges where ``condition`` holds; a merged label takes the smallest one."""
    merged = connected_components(edges.where(condition), "a", "b")
    return merged.select(F.col("node").alias("old"), F.col("component").alias("new"))


def threshold_agglomerate(edges: DataFrame, thresholds: list[float], weight: str = "p") -> DataFrame:
    """``(threshold, old, new)`` for edges strictly above each threshold.

    Components are nested as thresholds fall, so each step merges only the components of the step before.
    """
    out, mapping = None, None
    for t in sorted(thresholds, reverse=True):
        kept = edges.where(F.col(weight) > t).select("a", "b")
        if mapping is not None:
            for end in "ab":
                kept = kept.join(mapping.select(F.col("old").alias(end), F.col("new").alias("__n")), end, "left").withColumn(end, F.coalesce("__n", end)).drop("__n")
            kept = kept.where("a <> b").distinct()
        now = connected_components(kept, "a", "b").select(F.col("node").alias("__old"), F.col("component").alias("__new"))
        if mapping is None:
            mapping = now.select(F.col("__old").alias("old"), F.col("__new").alias("new"))
        else:
            known = mapping.join(now, mapping["new"] == now["__old"], "left").select("old", F.coalesce("__new", "new").alias("new"))
            fresh = now.join(mapping, now["__old"] == mapping["old"], "left_anti").select(F.col("__old").alias("old"), F.col("__new").alias("new"))
            mapping = known.union(fresh)
        mapping = cut(mapping)
        step = mapping.withColumn("threshold", F.lit(t))
        out = step if out is None else out.union(step)
    return out.select("threshold", "old", "new")


def value_at(rows: DataFrame, column: str, place: int) -> float | None:
    """The value at a place, from 0, of the descending order of a column without nulls.

    The range that holds it is cut into 4096 bins again and again; each step brings one row to the driver and no task
    sorts the values.
    """
    ends = rows.agg(F.max(column).alias("hi"), F.min(column).alias("lo"), F.count(column).alias("n")).first()
    if not 0 <= place < ends["n"]:
        return None
    hi, lo = ends["hi"], ends["lo"]
    running = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    while hi > lo:
        bins = rows.where(F.col(column).between(lo, hi)).groupBy(F.least(F.floor((F.lit(hi) - F.col(column)) / ((hi - lo) / 4096)), F.lit(4095)).alias("bin"))
        counted = bins.agg(F.count("*").alias("k"), F.max(column).alias("hi"), F.min(column).alias("lo")).withColumn("upto", F.sum("k").over(running))
        found = counted.where(F.col("upto") > place).orderBy("bin").first()
        place -= found["upto"] - found["k"]
        if (found["hi"], found["lo"]) == (hi, lo):  # the bins can't part these values
            return rows.where(F.col(column).between(lo, hi)).groupBy(column).agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy(F.desc(column)))).where(F.col("upto") > place).agg(F.max(column)).first()[0]
        hi, lo = found["hi"], found["lo"]
    return hi


def merge_percent(edges: DataFrame, percent: float, p: str = "p", predicted: str = "merge") -> DataFrame:
    """Edges predicted to merge whose probability is at least that at place ``int(n * percent)`` of the predicted ones'
    count, in the descending order of all; the place is clamped; ties at the threshold stay."""
    counts = edges.agg(F.count_if(predicted).alias("n"), F.count(p).alias("total")).first()
    threshold = value_at(edges.where(F.col(p).isNotNull()), p, min(int(counts["n"] * percent), counts["total"] - 1))
    return edges.where(F.col(predicted) & (F.col(p) >= F.lit(threshold)))


def stitched(vox: DataFrame, a: str = "first", b: str = "second", shift: int | None = None) -> DataFrame:
    """``(volume, old, new)``: labels of two volumes that cover the same voxels where both are known.

    Each label of the second is tied to the label of the first that it overlaps most, and each of the first likewise; tied labels
    become one, named by its smallest member, those of the second shifted so that they don't collide: by ``shift`` or, if
    it isn't given, by a power of two above all labels of the first. A shift that labels reach raises.
    """
    top = vox.agg(F.max(a)).first()[0] or 0
    shift = 1 << max(40, int(top).bit_length()) if shift is None else shift
    if top >= shift:
        raise ValueError(f"labels reach {top}, the shift is {shift}")
    both = vox.where(f"{a} is not null and {b} is not null")
    forward = best_overlap(both, b, a).where("best >= 0").select((F.col(b) + shift).alias("src"), F.col("best").alias("dst"))
    backward = best_overlap(both, a, b).where("best >= 0").select(F.col(a).alias("src"), (F.col("best") + shift).alias("dst"))
    everything = vox.select(F.col(a).alias("src")).union(vox.select(F.col(b) + shift)).where(f"src is not null and src not in (0, {shift})").distinct()
    found = connected_components(forward.union(backward).union(everything.select("src", F.col("src").alias("dst"))))
    return found.select(F.when(F.col("node") >= shift, 2).otherwise(1).alias("volume"), F.when(F.col("node") >= shift, F.col("node") - shift).otherwise(F.col("node")).alias("old"), F.col("component").alias("new"))


def appended(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds labels without an entry, numbered on from the largest new label in their order."""
    top = mapping.agg(F.coalesce(F.max("new"), F.lit(0)).alias("top"))
    rest = labels.join(mapping, labels["label"] == mapping["old"], "left_anti").where("label <> 0").distinct()
    from voxmill.operators.labels import dense_mapping

    numbered = dense_mapping(rest).crossJoin(F.broadcast(top)).select("old", (F.col("new") + F.col("top")).alias("new"))
    return mapping.select("old", "new").union(numbered)


def slice_links(vox: DataFrame, label: str = "label") -> DataFrame:
    """Pairs of labels, other than 0, that lie over each other in neighbouring slices."""
    fore = vox.where(F.col(label) != 0).select("x", "y", "z", F.col(label).alias("l"))
    above = fore.select("x", "y", (F.col("z") - 1).alias("z"), F.col("l").alias("m"))
    return fore.join(above, ["x", "y", "z"]).select(F.col("l").alias("a"), F.col("m").alias("b")).distinct()


def perfect_merge(vox: DataFrame, edges: DataFrame, truth: str = "truth") -> DataFrame:
    """Edges with ``target``: whether both ends overlap one true label most."""
    best = best_overlap(vox, "label", truth).select("label", "best")
    for end in "ab":
        edges = edges.join(best.select(F.col("label").alias(end), F.col("best").alias(f"t_{end}")), end, "left")
    return edges.withColumn("target", ((F.col("t_a") == F.col("t_b")) & (F.col("t_a") > 0)).cast("int")).drop("t_a", "t_b")


def merged_volume(vox: DataFrame, mapping: DataFrame) -> DataFrame:
    """Voxels under their merged labels; labels outside the mapping stay."""
    own = vox.select("label").distinct().join(mapping, F.col("label") == F.col("old"), "left").select(F.col("label").alias("old"), F.coalesce("new", "label").alias("new"))
    return relabelled(vox, own)
