"""Metrics of segmentations, each from a sparse contingency table ``(truth, proposed, n)`` or from columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(rows: DataFrame, truth: str, proposed: str, drop_background: bool = False) -> DataFrame:
    kept = rows.where(F.col(truth) != 0) if drop_background else rows
    return kept.groupBy(F.col(truth).alias("truth"), F.col(proposed).alias("proposed")).agg(F.count("*").alias("n"))


def _sums(table: DataFrame, *keys: str) -> DataFrame:
    """One row: sums over cells, rows and columns of n squared, in exact decimals, and n."""
    square = lambda c: F.sum((F.col(c).cast("decimal(19,0)") * F.col(c)).cast("decimal(38,0)"))
    cell = table.groupBy(*keys).agg(square("n").alias("cell"), F.sum("n").alias("total"))
    for name, side in (("row", "truth"), ("col", "proposed")):
        one = table.groupBy(*keys, side).agg(F.sum("n").alias("n")).groupBy(*keys).agg(square("n").alias(name))
        cell = cell.join(one, list(keys)) if keys else cell.crossJoin(one)  # one row each
    return cell


def rand_metrics(table: DataFrame, *keys: str) -> DataFrame:
    """Adapted Rand error with its precision and recall, Rand index, adjusted Rand index; by ``keys`` if given."""
    t, p, q, n = [F.col(c).cast("double") - (F.col("total") if c != "total" else 0) for c in ("cell", "row", "col", "total")]
    precision = F.when(q == 0, 1.0).otherwise(t / q)
    recall = F.when(p == 0, 1.0).otherwise(t / p)
    pairs = n * (n - 1)
    expected = p * q / pairs
    error = 1 - F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    adjusted = F.when((p + q) / 2 == expected, 1.0).otherwise((t - expected) / ((p + q) / 2 - expected))
    return _sums(table, *keys).select(*keys, precision.alias("precision"), recall.alias("recall"), error.alias("are"), ((pairs - p - q + 2 * t) / pairs).alias("rand_index"), adjusted.alias("adjusted_rand"))


def variation_of_information(table: DataFrame) -> DataFrame:
    """Conditional entropies, in nats: truth given proposed (merges), proposed given truth (splits), and their sum."""
    rows = table.groupBy("truth").agg(F.sum("n").alias("rn"))
    cols = table.groupBy("proposed").agg(F.sum("n").alias("cn"))
    total = table.agg(F.sum("n").alias("total"))
    full = table.join(rows, "truth").join(cols, "proposed").crossJoin(F.broadcast(total))  # one row
    part = F.col("n") / F.col("total")
    split, merge = -F.sum(part * F.log(F.col("n") / F.col("rn"))), -F.sum(part * F.log(F.col("n") / F.col("cn")))
    return full.agg(merge.alias("merge_entropy"), split.alias("split_entropy"), (merge + split).alias("variation"))


def pixel_scores(rows: DataFrame, truth: Column, proposed: Column, *keys: str) -> DataFrame:
    """Counts, precision (0 if undefined), recall (1 if undefined), F-score, error and false positive rate."""
    n = lambda c: F.count_if(c)
    rows = rows.groupBy(*keys).agg(n(truth & proposed).alias("tp"), n(~truth & proposed).alias("fp"), n(truth & ~proposed).alias("fn"), n(~truth & ~proposed).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    score = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.select(*keys, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), score.alias("f_score"), ((fp + fn) / (tp + fp + fn + tn)).alias("error"), F.when(fp + tn > 0, fp / (fp + tn)).otherwise(0.0).alias("fpr"))


def categorisation_error(rows: DataFrame, truth: str, proposed: str) -> DataFrame:
    return rows.agg(F.avg((F.col(truth) != F.col(proposed)).cast("double")).alias("error"))


def classification_cost(rows: DataFrame, truth: str, classes: list[str]) -> DataFrame:
    """Share of rows whose likeliest class isn't the true one, and the mean cross entropy."""
    from voxmill.functions.expressions import winner

    p = F.get(F.array(*classes), F.col(truth))
    return rows.agg(F.avg((winner([F.col(c) for c in classes]) != F.col(truth)).cast("double")).alias("error"), F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("cross_entropy"))


def bootstrap(table: DataFrame, replicates: int, keep: float = 0.5) -> DataFrame:
    """Rand metrics of resampled objects: in each replicate a true object stays with probability ``keep``, by an arithmetic
    hash of its id and the replicate, so the result repeats."""
    draws = table.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    mixed = F.pmod((F.col("truth") * 7919 + F.col("replicate") * 104729 + 12345) * 31 % 1000003, F.lit(1000))
    return rand_metrics(draws.where(mixed < int(1000 * keep)), "replicate")


def confidence(values: DataFrame, value: str = "are", level: float = 0.9) -> DataFrame:
    """Mean and the interval that holds ``level`` of the replicates."""
    tail = (1 - level) / 2
    return values.agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, {tail})").alias("low"), F.expr(f"percentile({value}, {1 - tail})").alias("high"))


def split_merge_counts(table: DataFrame) -> DataFrame:
    """Splits: labels beyond the first that a true object falls into; merges: objects beyond the first that a label holds;
    proposed label 0 doesn't count."""
    hits = table.where("truth <> 0 and proposed <> 0")
    splits = hits.groupBy("truth").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("splits"))
    merges = hits.groupBy("proposed").agg((F.count("*") - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("merges"))
    return splits.crossJoin(merges)  # one row each
