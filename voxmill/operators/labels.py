"""Operators on labelled voxels: counts, relabelling, overlap between labellings, replicas.

Label 0 is background. A table has one row per voxel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_sizes(vox: DataFrame, label: str = "label") -> DataFrame:
    """Voxels of each label, background included."""
    return vox.groupBy(label).agg(F.count("*").alias("n_vox"))


def relabelled(vox: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Labels replaced by ``mapping(old, new)``; those without an entry become 0."""
    names = vox.columns
    own = mapping.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    joined = vox.join(own, F.col(label) == F.col("__old"), "left").withColumn(label, F.coalesce("__new", F.lit(0)).cast("long"))
    return joined.select(*names)


def dense_mapping(labels: DataFrame, label: str = "label") -> DataFrame:
    """``(old, new)``: labels other than 0 onto 1, 2, ... in their order.

    Ranks are counted within ranges of labels, and the ranges' sizes are summed, so no task ranks all labels.
    """
    distinct = labels.select(F.col(label).cast("long").alias("old")).where("old <> 0").distinct()
    ranged = distinct.withColumn("part", F.floor(F.col("old") / 65536))
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    total = before.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("old"))
    return ranged.withColumn("k", rank).join(total, "part").select("old", (F.col("k") + F.col("base")).cast("long").alias("new"))


def sequential_relabel(vox: DataFrame, label: str = "label") -> DataFrame:
    return relabelled(vox, dense_mapping(vox, label), label)


def size_filter(vox: DataFrame, size: int, label: str = "label", relabel: bool = True) -> DataFrame:
    """Labels with at least ``size`` voxels, or, if negative, with fewer than its amount; the others become 0."""
    sizes = label_sizes(vox.where(F.col(label) != 0), label)
    kept = sizes.where(F.col("n_vox") >= size if size >= 0 else F.col("n_vox") < -size)
    mapping = dense_mapping(kept, label) if relabel else kept.select(F.col(label).alias("old"), F.col(label).alias("new"))
    return relabelled(vox, mapping, label)


def type_counts(vox: DataFrame, kind: str = "type") -> DataFrame:
    return vox.groupBy(kind).agg(F.count("*").alias("n"))


def majority_type(vox: DataFrame, n_types: int, label: str = "label", kind: str = "type") -> DataFrame:
    """Most frequent type of each label; of equally frequent ones the highest; only types below ``n_types`` count, and a label
    without any gets the last one."""
    counts = vox.groupBy(label, kind).agg(F.count("*").alias("n"))
    valid = F.when(F.col(kind) < n_types, F.struct("n", F.col(kind).alias("t")))
    return counts.groupBy(label).agg(F.coalesce(F.max(valid)["t"], F.lit(n_types - 1)).cast("int").alias("major_type"))


def overlap(vox: DataFrame, a: str, b: str) -> DataFrame:
    """Voxels that each pair of labels of two labellings shares: the sparse contingency table."""
    return vox.groupBy(a, b).agg(F.count("*").alias("n"))


def best_overlap(vox: DataFrame, a: str, b: str) -> DataFrame:
    """For each label of ``a`` the label of ``b``, not 0, that shares most voxels; of equal ones the lowest; -1 if none."""
    counts = overlap(vox.where(F.col(a) != 0), a, b)
    pick = F.when(F.col(b) != 0, F.struct("n", (-F.col(b)).alias("less")))
    return counts.groupBy(a).agg(F.coalesce(-F.max(pick)["less"], F.lit(-1)).cast("long").alias("best"), F.coalesce(F.max(pick)["n"], F.lit(0)).alias("n"))


def overlap_percent(vox: DataFrame, a: str, b: str) -> DataFrame:
    """Per pair of labels other than 0: shares of either in the pair, and of ``a`` in background of ``b``."""
    counts = overlap(vox.where(F.col(a) != 0), a, b)
    size_a = counts.groupBy(a).agg(F.sum("n").alias("n_a"), F.sum(F.when(F.col(b) == 0, F.col("n")).otherwise(0)).alias("n_bg"))
    size_b = overlap(vox.where(F.col(b) != 0), a, b).groupBy(b).agg(F.sum("n").alias("n_b"))
    rows = counts.where(F.col(b) != 0).join(size_a, a).join(size_b, b)
    return rows.select(a, b, "n", (F.col("n") / F.col("n_a")).alias("of_a"), (F.col("n") / F.col("n_b")).alias("of_b"), (F.col("n_bg") / F.col("n_a")).alias("a_in_background"))


def bounding_boxes(vox: DataFrame, label: str = "label") -> DataFrame:
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
    return vox.groupBy(label).agg(*ends, F.count("*").alias("n_vox"))


def merge_replicas(rows: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """Weighted mean, minimum, maximum and population deviation of replicas; a total weight of 0 counts as 1."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg((F.sum(weight * value) / F.when(total == 0, 1.0).otherwise(total)).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.stddev_pop(value).alias("std"))


def zscored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a deviation of 0 counts as 1."""
    stats = rows.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).select(*rows.columns)


def lowest_per_bin(rows: DataFrame, value: str, low: float, step: float, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each bin of ``value``, in ``order``."""
    binned = rows.withColumn("bin", F.floor((F.col(value) - low) / step).cast("long"))
    return binned.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(*order))).where(F.col("rank") <= k)


def histogram(rows: DataFrame, value: str, low: float, step: float) -> DataFrame:
    return rows.groupBy(F.floor((F.col(value) - low) / step).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def class_priors(rows: DataFrame, kind: str) -> DataFrame:
    """Share of each class."""
    counts = type_counts(rows, kind)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(kind, "n", (F.col("n") / F.col("total")).alias("prior"))


def replace_background(vox: DataFrame, kind: str = "type", label: str = "label") -> DataFrame:
    """Label 0 where the type is 0."""
    return vox.withColumn(label, F.when(F.col(kind) == 0, F.lit(0)).otherwise(F.col(label)))


def select_ecs(vox: DataFrame, ecs: int, label: str = "label") -> DataFrame:
    """Marks extracellular voxels: a positive ``ecs`` names their label, a negative one means the largest, 0 none."""
    if ecs > 0:
        return vox.withColumn("is_ecs", F.col(label) == ecs)
    if ecs == 0:
        return vox.withColumn("is_ecs", F.lit(False))
    top = vox.agg(F.max(label).alias("__top"))
    return vox.crossJoin(F.broadcast(top)).withColumn("is_ecs", F.col(label) == F.col("__top")).drop("__top")


def reorder_by_type(vox: DataFrame, n_types: int, label: str = "label", kind: str = "type") -> DataFrame:
    """Labels renumbered so that those of one majority type follow each other, in their old order.

    Ranks are counted within ranges of labels of a type, as in ``dense_mapping``.
    """
    types = majority_type(vox.where(F.col(label) != 0), n_types, label, kind)
    ranged = types.withColumn("part", F.floor(F.col(label) / 65536))
    sizes = ranged.groupBy("major_type", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("major_type", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rank = F.row_number().over(Window.partitionBy("major_type", "part").orderBy(label))
    mapping = ranged.withColumn("k", rank).join(sizes.select("major_type", "part", before.alias("base")), ["major_type", "part"])
    return relabelled(vox, mapping.select(F.col(label).alias("old"), (F.col("k") + F.col("base")).alias("new")), label)
