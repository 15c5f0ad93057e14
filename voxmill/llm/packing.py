"""Op 9, best-fit packing of token sequences into rows of a fixed length.

Bounded-space online best-fit: a task keeps a fixed number of open bins; a bitset with one bit per amount of free space
finds the fullest bin that still takes a piece; when too many bins are open, the fullest closes first. What is open at
the end of a task is packed again, as pieces of the bins' fill, in ever fewer tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import encoder, id_and_text, rows_of
from voxmill.session import cut, read_table

LENGTH = 2048
OPEN_BINS = 1024
END_ID = 0
#: Left-over bins that one task packs again.
BINS_PER_TASK = 200_000
_SPOT = ["__task", "__bin", "__at", "__fill"]
_SPOT_TYPES = ", ".join(f"{x} long" for x in _SPOT)
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class BestFit:
    """Open bins by free space; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit k: some open bin has k free
        self.open = self.made = 0

    def _pop(self, room: int) -> int:
        stack = self.free[room]
        chosen = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        self.open -= 1
        return chosen

    def place(self, size: int) -> tuple[int, int]:
        if fits := self.bits >> size:
            room = size + (fits & -fits).bit_length() - 1
            chosen = self._pop(room)
        else:
            chosen, room = self.made, self.capacity
            self.made += 1
        left = room - size
        if left:
            self.free[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)
        return chosen, self.capacity - room

    def left(self) -> list[tuple[int, int]]:
        """(bin, fill) of what is still open."""
        return [(x, self.capacity - room) for room, stack in enumerate(self.free) for x in stack]


def _cut_up(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int, digests: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches' texts, one small batch after the other."""
    own, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digests else pa.binary())
    for batch in rows_of(batches):
        out: list[tuple] = []
        for doc, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part) if digests else part))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32" if digests else "ids"])


def _placed(batches: Iterator[pa.RecordBatch], length_col: str, capacity: int, open_bins: int) -> Iterator[pa.RecordBatch]:
    """The batches with task, bin and offset of each row; after them, with null columns, the bins that are still open."""
    own, task, fields = BestFit(capacity, open_bins), TaskContext.get().partitionId(), None
    for batch in rows_of(batches, 1 << 16):
        fields = fields or batch.schema
        sizes = batch.column(fields.get_field_index(length_col)).to_pylist()
        if any(x is None or not 0 < x <= capacity for x in sizes):
            raise ValueError(f"{length_col} must be from 1 to {capacity}")
        placed = [own.place(x) for x in sizes]
        spot = [pa.array([task] * len(placed), pa.int64()), pa.array([x[0] for x in placed], pa.int64()), pa.array([x[1] for x in placed], pa.int64()), pa.nulls(len(placed), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *spot], names=[*fields.names, *_SPOT])
    if fields is not None and (left := own.left()):
        nothing = [pa.nulls(len(left), x.type) for x in fields]
        spot = [pa.array([task] * len(left), pa.int64()), pa.array([x[0] for x in left], pa.int64()), pa.nulls(len(left), pa.int64()), pa.array([x[1] for x in left], pa.int64())]
        yield pa.RecordBatch.from_arrays([*nothing, *spot], names=[*fields.names, *_SPOT])


def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the ids of each whole text and an end id, in pieces of at most ``length``.

    ids: little-endian unsigned 32-bit. A null or empty text is its end id alone; a null doc_id stays null; repeated rows
    stay apart; other columns are left out; an empty table has no pieces.
    """
    return id_and_text(df, id_col, text_col).mapInArrow(lambda batches: _cut_up(batches, path, length, end_id, False), PIECES)


def pack(df: DataFrame, length_col: str = "length", capacity: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """The rows of ``df`` with ``sequence_id`` and ``offset``: lengths in a sequence sum to ``capacity`` at most, without gaps.

    A length is from 1 to ``capacity``; other lengths raise. Columns of these two names are replaced; others, of any name,
    stay. An empty table gives an empty one. Which pieces share a sequence follows the order of the rows and is no part
    of the contract.
    """
    kept = df.drop("sequence_id", "offset")
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema)
    rows = kept.mapInArrow(lambda batches: _placed(batches, length_col, capacity, open_bins), f"{schema}, {_SPOT_TYPES}")
    return _settled(rows, kept.columns, capacity, open_bins)


def packed_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS, digests: bool = False) -> DataFrame:
    """``pack`` of ``token_pieces``, in one pass: one Python worker a task both encodes and places.

    With ``digests``, ``ids_crc32`` in place of ``ids``. Odd rows as in ``token_pieces``.
    """
    schema = PIECES.replace("ids binary", "ids_crc32 long") if digests else PIECES
    run = lambda batches: _placed(_cut_up(batches, path, length, end_id, digests), "length", length, open_bins)
    rows = id_and_text(df, id_col, text_col).mapInArrow(run, f"{schema}, {_SPOT_TYPES}")
    return _settled(rows, [x.split()[0] for x in schema.split(", ")], length, open_bins)


def _settled(placed: DataFrame, names: list[str], capacity: int, open_bins: int) -> DataFrame:
    """Rows of ``_placed`` with their final sequence and offset, after the open bins are packed again."""
    rows = cut(placed)
    # bins: what is open, under the bin of the last level that holds it, and the pieces' way there
    number = lambda level: F.lit(level).cast("long") * (1 << 56) + F.col("__task") * (1 << 32) + F.col("__bin")
    pieces = rows.where("__fill is null").withColumn("__key", number(0))
    bins = rows.where("__fill is not null").select(number(0).alias("key"), F.col("__fill").alias("fill"))
    way = _repack(bins, capacity, open_bins).select(F.col("key").alias("__left"), F.col("to").alias("__to"), F.col("base").alias("__base"))
    merged = pieces.join(way, F.col("__key") == F.col("__left"), "left")
    return merged.select(*[F.col(f"`{x}`") for x in names], F.coalesce("__to", "__key").alias("sequence_id"), (F.col("__at") + F.coalesce("__base", F.lit(0))).alias("offset"))


def _repack(bins: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """``(key, to, base)`` for each left-over bin: the sequence that takes it, and where in it."""
    level, way, tasks = 0, None, None
    while True:
        level += 1
        count = bins.count()
        tasks = min(-(-count // BINS_PER_TASK) or 1, max(1, (tasks or 1 << 30) // 2))

        def fit(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            own, task = BestFit(capacity, open_bins), TaskContext.get().partitionId()
            rows = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            rows.sort(key=lambda x: (-x[1], x[0]))  # the fullest first: small ones fill what these leave
            name = lambda chosen: (level << 56) + (task << 32) + chosen
            spots = [own.place(x[1]) for x in rows]
            out = [(key, name(b), at, None) for (key, _), (b, at) in zip(rows, spots, strict=True)] + [(None, name(b), None, fill) for b, fill in own.left()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "to", "base", "fill"])

        step = cut(bins.repartition(tasks).mapInArrow(fit, "key long, to long, base long, fill long"))
        moved = step.where("key is not null").select("key", "to", "base")
        if way is None:
            way = moved
        else:
            then = moved.select(F.col("key").alias("k2"), F.col("to").alias("to2"), F.col("base").alias("base2"))
            way = way.join(then, F.col("to") == F.col("k2"), "left").select("key", F.coalesce("to2", "to").alias("to"), (F.col("base") + F.coalesce("base2", F.lit(0))).alias("base"))
        if tasks == 1:
            return way
        bins = step.where("key is null").select(F.col("to").alias("key"), "fill")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the packed rows themselves; a group is one sequence, so at most ``capacity`` ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in sequences of at most 2048 ids; null and empty texts are their end id alone."""
    import public_tokenizers

    return packed_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
