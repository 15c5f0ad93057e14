"""Corpus pipeline: quality filter, near-duplicate removal, redaction of personal data, packing into sequences.

Each stage works on whole texts and on all that the one before kept. Rows with null ids or texts, repeated rows and empty
tables pass through as the operators define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import neardup, packing, pii, quality
from voxmill.session import cut, read_table, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at its threshold or above; it learns from labels that aren't held out.

    A null text counts as empty and has a score; repeated rows are scored alike; an empty table gives an empty one.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id: five-word shingles, similarity 0.8 or more.

    Rows are told apart by all their columns, so rows that repeat an id with other texts are judged by their own texts;
    null ids come last in a group. A row without words is in no group and stays. Rows equal in every column are one row.
    """
    shown = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (F.col(c).cast("string") for c in COLUMNS)]
    rows = docs.select(*COLUMNS, F.unhex(F.sha2(F.concat(*shown), 256)).alias("row"))
    classes = cut(neardup.near_duplicates(rows, also=["row"]))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = classes.where("class_no is not null").groupBy("class_no").agg(F.min(order).alias("first")).select("first.row")
    kept = first.union(classes.where("class_no is null").select("row")).distinct().withColumnRenamed("row", "kept")
    single = rows.groupBy("row").agg(*[F.first(c).alias(c) for c in COLUMNS])
    return single.join(kept, F.col("row") == F.col("kept"), "left_semi").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each personal datum replaced by its kind in brackets; n_chars follows. A null text stays null."""
    found = pii.add_spans(docs)
    text = F.when(F.size("spans") > 0, pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised texts with their places in sequences of at most 2048 ids; ``ids`` as 32-bit integers.

    A null or empty text is its end id alone; null ids stay null; repeated rows stay apart; an empty table has no pieces.
    """
    import public_tokenizers

    return packing.packed_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_filter), ("MinHash near-dedup", near_dedup), ("PII", redact), ("best-fit packing", pack)]

#: The classifier can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
