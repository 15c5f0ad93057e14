"""New blocks as a stream: each micro-batch becomes a version of the blocks that it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.sources.blocks import SCHEMA, write_dataset

KEYS = ["cx", "cy", "cz"]


def watch(spark: SparkSession, source: str, store: str, dataset: str, checkpoint: str, order: str | None = None):
    """Appends arriving block files to a dataset; the stream ends when all files are in.

    A batch's version follows the latest one that the dataset had when the batch came, whoever wrote it; a batch that is
    repeated after a failure is applied again under a later version, with the same blocks. Of one block in a batch the one
    with the largest ``order`` column counts, without it the largest payload.
    """

    def apply(batch: DataFrame, number: int) -> None:
        kept = spark.read.parquet(f"{store}/blocks").where(F.col("dataset") == dataset) if exists(spark, f"{store}/blocks") else None
        latest = kept.agg(F.max("version")).first()[0] if kept is not None else None
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rank = F.max(F.struct(*([order] if order else []), *[c for c in names if c not in KEYS][::-1]))
        one = batch.groupBy(*KEYS).agg(rank.alias("r")).select(*KEYS, *[F.col(f"r.{c}") for c in names if c not in KEYS])
        write_dataset(one, store, dataset, version=0 if latest is None else latest + 1)

    schema = SCHEMA + (f", {order} long" if order else "")
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
