"""Op 5, a quality classifier: a factorisation machine on hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pairs cost linear time, as their sum is half
of the squared sum less the sum of squares, per factor.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import give_up_cache, id_and_text, rows_of
from voxmill.session import read_table

#: Slots for hashed words; the statistics' slots follow.
WORDS = 1 << 15
FACTORS = 8
#: Labelled rows, at most, that a model is fitted on: those whose hashed ids are the smallest.
SAMPLE = 6000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 1e-5
THRESHOLD = 0.3

_SYMBOLS = [ord(x) for x in "%$#&*|!<>{}=_/\\@~^+"]
_SHARE = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])
_SIZE = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384])
#: Statistics, each one slot out of 16 by its bin.
STATISTICS = 16
SLOTS = WORDS + 16 * STATISTICS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a whole text; a null one counts as empty. Neither language, source, id nor label is looked at."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars, n = max(1, int(raw.sum())), max(1, len(words))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    lines = [x for x in text.split("\n") if x]
    symbols = raw[_SYMBOLS]
    share = [
        raw[65:91].sum() / letters, raw[48:58].sum() / chars, symbols.sum() / chars, symbols.max() / chars, raw[124] / chars,
        1 - len(counts) / n, max(counts.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        (raw[46] + raw[63]) / n, raw[44] / n, len(lines) / n, sum(raw[128:]) / chars,
    ]
    sizes = [len(words), chars / n * 8, chars]
    bins = np.concatenate([np.searchsorted(_SHARE, share), np.searchsorted(_SIZE, sizes)])
    stats = WORDS + 16 * np.arange(STATISTICS) + bins
    slots = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in counts), np.int64, len(counts)) % WORDS
    tf = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = np.sqrt((tf * tf).sum()) or 1.0
    return np.concatenate([slots, stats]), np.concatenate([tf / norm, np.full(STATISTICS, 1 / np.sqrt(STATISTICS))])


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For rows laid end to end: row i begins at ``starts[i]``; no row is empty."""
        v = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(v, starts)
        squares = np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * (sums * sums - squares).sum(1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in rows])[:-1]])
        return _sigmoid(self.margins(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over small batches. Without rows of both labels the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    mean = (labels.sum() + 1.0) / (len(labels) + 2.0)
    model = Machine(float(np.log(mean / (1 - mean))), np.zeros(SLOTS), rng.normal(0, 0.05, (SLOTS, FACTORS)))
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    g_bias, g_linear, g_factors = 1.0, np.ones(SLOTS), np.ones((SLOTS, FACTORS))
    # both labels weigh half in all, so the rarer one is not drowned
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, len(labels) - labels.sum())) * len(labels)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            slots, values = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            error = (_sigmoid(model.margins(slots, values, starts)) - labels[chosen]) * weight[chosen] / len(chosen)
            each = np.repeat(error, lengths) * values
            sums = np.repeat(np.add.reduceat(model.factors[slots] * values[:, None], starts), lengths, axis=0)
            to_factors = each[:, None] * (sums - model.factors[slots] * values[:, None])
            touched, back = np.unique(slots, return_inverse=True)
            linear, factors = np.zeros(len(touched)), np.zeros((len(touched), FACTORS))
            np.add.at(linear, back, each)
            np.add.at(factors, back, to_factors)
            linear += DECAY * model.linear[touched]
            factors += DECAY * model.factors[touched]
            g_linear[touched] += linear**2 * 100
            g_factors[touched] += factors**2 * 100
            model.linear[touched] -= RATE * 10 * linear / np.sqrt(g_linear[touched])
            model.factors[touched] -= RATE * 10 * factors / np.sqrt(g_factors[touched])
            g_bias += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(g_bias)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine from labelled rows that aren't held out, ``sample`` at most, chosen by hashed id.

    Null labels don't count; of several labels of an id the largest counts; ids or texts that repeat weigh as often as
    they occur, within twice the sample in all (rows of the lowest hashed ids first). Only the chosen rows' hashed features come to the driver.
    """
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            made = [features(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype("<u4").tobytes() for s, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())], names=["doc_id", "label", "slots", "xs"])

    rows = texts.mapInArrow(run, "doc_id long, label int, slots binary, xs binary").orderBy(F.xxhash64("doc_id"), "doc_id", "slots").limit(2 * sample).collect()
    return train([(np.frombuffer(r.slots, "<u4").astype(np.int64), np.frombuffer(r.xs, "<f4").astype(np.float64)) for r in rows], np.array([float(r.label > 0) for r in rows]))


def score(df: DataFrame, model: Machine, text_col: str = "text", to: str = "score") -> DataFrame:
    """Adds ``score``, from 0 to 1, of every whole text; null texts are empty and get a score too. All columns and rows stay."""
    names = [x for x in df.columns if x != to]
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32)))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_up_cache()
        own = Machine(*shared.value)
        for batch in rows_of(batches, 128):
            scores = own.scores([features(x) for x in batch.column(at).cast(pa.string()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, to])

    kept = df.select(*[F.col(f"`{x}`") for x in names])
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema)
    return kept.mapInArrow(run, f"{schema}, `{to}` double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, null and empty ones too; repeated rows are scored alike, an empty table has none."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
