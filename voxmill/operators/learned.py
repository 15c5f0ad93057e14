"""Learned merging: feature sets, classifiers on edges, iterated agglomeration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators.agglomerate import agglomerated, merge_percent
from voxmill.operators.features import SETS, feature_names

#: Columns of an edge by feature set: the named sets of ``features.edge_table``, and plain ones of ``agglomerate.edge_features``.
FEATURE_SETS = {name: feature_names(name) for name in SETS} | {
    "plain-minimal": ["n_pairs", "mean_value"],
    "plain-small": ["n_pairs", "mean_value", "n_small", "n_large"],
    "plain": ["n_pairs", "mean_value", "n_small", "n_large", "log_ratio"],
    "plain-places": ["n_pairs", "mean_value", "n_small", "n_large", "log_ratio", "cx", "cy", "cz"],
}


@dataclass(frozen=True)
class MergeConfig:
    classifier: str = "rf"
    features: str = "plain"
    iterations: int = 3
    percent: float = 0.5
    seed: int = 1
    trees: int = 256
    depth: int = 16
    thresholds: list[float] = field(default_factory=lambda: [0.5])

    def __post_init__(self):
        if self.classifier not in ("rf", "lr", "nb", "dc", "ada") or self.features not in FEATURE_SETS:
            raise ValueError(f"{self.classifier}, {self.features}")
        if self.iterations < 1 or not 0 < self.percent <= 1:
            raise ValueError("iterations must be 1 or more, percent above 0 and 1 at most")


def classifier(config: MergeConfig):
    """Scaled features (mean 0, deviation 1) and the classifier of that name; ``ada`` is boosted trees."""
    made = {
        "rf": lambda: RandomForestClassifier(labelCol="target", featuresCol="scaled", numTrees=config.trees, maxDepth=config.depth, seed=config.seed),
        "lr": lambda: LogisticRegression(labelCol="target", featuresCol="scaled"),
        "nb": lambda: NaiveBayes(labelCol="target", featuresCol="scaled", modelType="gaussian"),
        "dc": lambda: DecisionTreeClassifier(labelCol="target", featuresCol="scaled", seed=config.seed),
        "ada": lambda: GBTClassifier(labelCol="target", featuresCol="scaled", maxIter=10, seed=config.seed),
    }[config.classifier]()
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURE_SETS[config.features], outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), made])


def fit(edges: DataFrame, config: MergeConfig):
    return classifier(config).fit(edges)


def predicted(model, edges: DataFrame) -> DataFrame:
    """Edges with ``p``, the probability of a merge, and ``merge``, the prediction."""
    out = model.transform(edges)
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn("merge", F.col("prediction") == 1.0).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def linear_discriminant(edges: DataFrame, columns: list[str], target: str = "target") -> list[float]:
    """Weights, then the constant, of the linear discriminant of two classes, from grouped moments: one small row per class."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = edges.groupBy(target).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).collect()
    by = {int(r[target]): r for r in rows}
    total = sum(r["n"] for r in rows)
    cov = np.zeros((len(columns),) * 2)
    for r in rows:
        for a, b in pairs:
            i, j = columns.index(a), columns.index(b)
            cov[i, j] += r["n"] * r[f"c_{a}_{b}"] / total
            cov[j, i] = cov[i, j]
    m = {k: np.array([r[f"m_{c}"] for c in columns]) for k, r in by.items()}
    w = np.linalg.pinv(cov) @ (m[1] - m[0])
    return [*w.tolist(), float(-0.5 * w @ (m[0] + m[1]) + np.log(by[1]["n"] / by[0]["n"]))]


def leave_out(edges: DataFrame, chunk: str, held: list[int]) -> tuple[DataFrame, DataFrame]:
    return edges.where(~F.col(chunk).isin(held)), edges.where(F.col(chunk).isin(held))


def balanced(edges: DataFrame, per_class: int, seed: int = 1) -> DataFrame:
    """``per_class`` rows of each class at most, chosen by a seeded hash: a sampling operator.

    Two limits, which Spark takes from each partition first, so no task ranks a whole class.
    """
    order = [F.xxhash64(F.lit(seed), "a", "b"), F.col("a"), F.col("b")]
    return edges.where("target = 0").orderBy(*order).limit(per_class).union(edges.where("target = 1").orderBy(*order).limit(per_class))


def uniform_sample(vox: DataFrame, kind: str, per_kind: int, seed: int = 1) -> DataFrame:
    """``per_kind`` voxels of each kind at most, every voxel of a kind as likely as another: a sampling operator.

    Each task keeps its own lowest hashes of a kind before the shuffle, so a frequent kind isn't one task's work.
    """
    from pyspark.sql import Window

    rows = vox.withColumn("__h", F.xxhash64(F.lit(seed), "x", "y", "z"))
    part = rows.withColumn("__p", F.pmod(F.xxhash64("__h", F.lit(1)), F.lit(256)))
    for keys in ([kind, "__p"], [kind]):
        part = part.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "x", "y", "z"))).where(F.col("__k") <= per_kind).drop("__k")
    return part.drop("__h", "__p")


def saved(model, path: str) -> None:
    """Writes a fitted pipeline; ``loaded`` reads it."""
    model.write().overwrite().save(path)


def loaded(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def iterate_trained(vox: DataFrame, features, config: MergeConfig, truth: str = "truth", path: str | None = None) -> tuple[DataFrame, list]:
    """Rounds of: features of the graph, targets from ``truth``, a classifier fitted anew and, given a path, saved, its surest
    merges, agglomeration; fewer rounds if no two classes of edges are left. Returns the voxels and the models, by which ``iterate_with`` treats other volumes alike."""
    from voxmill.operators.agglomerate import merged_volume, perfect_merge
    from voxmill.session import cut

    models = []
    for k in range(config.iterations):
        edges = cut(perfect_merge(vox, features(vox), truth))
        if edges.select("target").distinct().count() < 2:  # nothing is left to tell apart
            break
        models.append(fit(edges, config))
        if path:
            saved(models[-1], f"{path}/round-{k}")
        chosen = merge_percent(predicted(models[-1], edges), config.percent)
        vox = cut(merged_volume(vox, agglomerated(chosen, F.lit(True))))
    return vox, models


def iterate_with(vox: DataFrame, features, models: list, config: MergeConfig) -> DataFrame:
    """The rounds of ``iterate_trained`` with its models, one a round."""
    for model in models:
        vox = iterate(vox, features, model, MergeConfig(config.classifier, config.features, 1, config.percent, config.seed, config.trees, config.depth))
    return vox


def iterate(vox: DataFrame, features, model, config: MergeConfig) -> DataFrame:
    """``vox`` after rounds of: features of the graph, prediction, the surest share of merges, agglomeration."""
    from voxmill.operators.agglomerate import merged_volume
    from voxmill.session import cut

    for _ in range(config.iterations):
        chosen = merge_percent(predicted(model, features(vox)), config.percent)
        vox = cut(merged_volume(vox, agglomerated(chosen, F.lit(True))))
    return vox


def diagnostics(rows: DataFrame, threshold: float) -> DataFrame:
    from voxmill.operators.metrics import pixel_scores

    return pixel_scores(rows, F.col("target") == 1, F.col("p") >= threshold)
