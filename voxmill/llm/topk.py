"""Op 1, exact top-k search by inner product.

Vectors are packed into blocks; every block of queries meets every shard of candidate blocks in a tile, one matrix
product; a tile keeps each query's best few; lists merge in a tree of bounded groups. What crosses the network is the
query blocks once per shard and lists of k entries, never scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import cut, read_table

#: Vectors in a candidate block and in a query block: a tile has so many scores at most.
CANDIDATES, QUERIES = 4096, 1024
#: Vectors in a shard, that is, candidates for which a query block is sent once.
SHARD = 65_536
#: Lists that one merge takes.
FAN = 16
#: Up to this bound sums of products are exact in double precision.
_EXACT = float(1 << 53)
_MOST = (1 << 63) - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exactly; beyond the range of a long they stay at its ends.

    Only rows with components too large for exact sums in double precision go through Python integers.
    """
    most = [np.abs(x).max(axis=1, initial=0) for x in (a, b)]
    if most[0].max(initial=0) * most[1].max(initial=0) * max(1, a.shape[1]) < _EXACT:
        return (a @ b.T).astype(np.int64)
    limit = np.sqrt(_EXACT / max(1, a.shape[1])) / 2
    big = [np.flatnonzero(m > limit) for m in most]
    plain = [np.where((m > limit)[:, None], 0.0, x) for m, x in zip(most, (a, b), strict=True)]
    out = (plain[0] @ plain[1].T).astype(np.int64)
    out[big[0]] = _whole(a[big[0]], b)
    out[:, big[1]] = _whole(a, b[big[1]])
    return out


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    rows = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    exact = rows[0] @ rows[1].T
    return np.array([[max(-_MOST, min(_MOST, x)) for x in row] for row in exact], dtype=np.int64).reshape(len(a), len(b))


def tile_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each query's best k in a tile, best first, ties to the smaller id; a query isn't its own match."""
    scores = products(queries, vectors)
    own = query_ids[:, None] == ids[None, :]
    scores[own] = -_MOST - 1
    kth = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -_MOST - 1)
    row, col = np.nonzero((scores >= kth[:, None]) & ~own)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], ids[col[keep]], scores[row[keep], col[keep]]


def _blocks(rows: DataFrame, size: int, shards: int) -> DataFrame:
    """``(dim, shard, ids, data)``: up to ``size`` vectors of one length in a row, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list]]] = {}
        made = 0
        spare = TaskContext.get().partitionId()

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            part = held.pop(dim)
            made += 1
            ids = np.array([x[0] for x in part], np.int64)
            data = np.floor(np.array([x[1] for x in part], np.float64))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([(spare + made) % shards], pa.int64()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], names=["dim", "shard", "ids", "data"])

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = held.setdefault(len(vector), [])
                part.append((key, vector))
                if len(part) == size:
                    yield block(len(vector))
        for dim in sorted(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, shard long, ids binary, data binary")


def top_k(df: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, id, score)``: for each row where ``is_query``, its k best others by inner product.

    Components x count as floor(scale * x). Rows without an id and vectors that are null or hold a null or non-finite
    component take no part. Repeated rows of an id count once; of different vectors under one id the last in array
    order counts. Only vectors of equal length are compared. Equal scores go to the smaller id. A query with fewer
    than k others has all of them; an empty table gives an empty result. Other columns are left out; ``is_query`` is
    a condition on ``id``.
    """
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double") * scale)
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.groupBy("id").agg(F.max("v").alias("v"))
    counted = df.select(F.count("*")).first()[0]
    shards = max(1, -(-counted // SHARD))
    candidates = cut(_blocks(rows, CANDIDATES, shards))
    asked = cut(_blocks(rows.where(is_query), QUERIES, shards))
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    tiles = candidates.join(asked, ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, shard, ids, data, q_ids, q_data in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                keys, q_keys = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                row, found, score = tile_best(q_keys, np.frombuffer(q_data).reshape(len(q_keys), dim), keys, np.frombuffer(data).reshape(len(keys), dim), k)
                # a list per query: rows come in order of the query
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]]).astype(np.int32) if len(row) else np.zeros(1, np.int32)
                entries = pa.StructArray.from_arrays([pa.array(-score, pa.int64()), pa.array(found, pa.int64())], names=["loss", "id"])
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([pa.array(q_keys[row[cuts[:-1]]] if len(row) else [], pa.int64()), pa.array([shard] * len(lists), pa.int64()), lists], names=["query_id", "part", "best"])

    best = tiles.select("dim", "shard", "ids", "data", "q_ids", "q_data").mapInArrow(run, "query_id long, part long, best array<struct<loss: long, id: long>>")
    groups = shards
    while True:
        best = best.groupBy("query_id", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if groups == 1:
            break
        groups = -(-groups // FAN)
        best = best.withColumn("part", F.expr(f"part div {FAN}"))
    spread = best.select("query_id", F.posexplode("best").alias("at", "entry"))
    return spread.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("entry.id").alias("id"), (-F.col("entry.loss")).alias("score"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every 50th vector of ``embeddings``; odd vectors as in ``top_k``."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5).withColumnRenamed("id", "vec_id")


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
