"""Op 10, token ids in binary files with Elias-Fano coded document boundaries.

A file: a header, the ids of all its documents in one array (2 bytes each if every id fits, else 4), the documents' ends
and the documents' ids, both as Elias-Fano sequences, and a checksum. An Elias-Fano sequence of n values below u holds
the low ``log2(u / n)`` bits of each value in a packed array and the high parts in unary in a bit vector, about
``2 + log2(u / n)`` bits a value; the place of every 256th set bit is stored, so one offset is found without decoding
the rest and without a table of 64-bit offsets. The text sink, which writes the files, puts a line end after each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm.tokens import encoder, id_and_text, rows_of
from voxmill.session import cut, read_table, shared_dir

MAGIC = b"EFTK"
SAMPLE = 256
END_ID = 2
#: Ids after which a task starts another file.
FILE_IDS = 4_000_000
#: magic, bytes an id, spare, documents with a null id, documents, ids, place of the file
_HEADER = struct.Struct("<4sBBHQQQQ")
#: Documents that a reader finds at once.
BLOCK = 512
#: values, base, low bits, bytes of low part, bytes of high part, samples
_PART = struct.Struct("<QqBQQQ")


class EliasFano:
    """A non-decreasing sequence of integers."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        base = int(values[0])
        gaps = values.astype(np.uint64) - np.uint64(base % (1 << 64))  # modulo 2^64: right for any signed range
        low_bits = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        bits = (gaps[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (gaps >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1, np.uint8)
        flags[places] = 1
        return cls(n, base, low_bits, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        low, high, samples = self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u4").tobytes()
        return _PART.pack(self.n, self.base, self.low_bits, len(low), len(high), len(self.samples)) + low + high + samples

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, base, low_bits, low, high, samples = _PART.unpack_from(data, at)
        at += _PART.size
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (4 * samples, np.dtype("<u4"))):
            parts.append(np.frombuffer(data[at : at + size], kind))
            at += size
        return cls(n, base, low_bits, *parts), at

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        start, stop = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start]
        return (bits.reshape(count, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def _signed(self, gaps: np.ndarray) -> np.ndarray:
        return (gaps + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def all(self) -> np.ndarray:
        highs = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        return self._signed((highs.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n))

    def between(self, first: int, stop: int) -> np.ndarray:
        """Values ``first`` to ``stop - 1``: from the sample before on, only the bytes that hold their bits are read."""
        if not 0 <= first < stop <= self.n:
            return np.zeros(0, np.int64)
        begin, after = first - first % SAMPLE, -(-stop // SAMPLE)
        start = int(self.samples[begin // SAMPLE])
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : end // 8 + 1], bitorder="little")[start % 8 :]
        places = np.flatnonzero(bits)[first - begin : stop - begin] + start
        highs = (places - np.arange(first, stop)).astype(np.uint64)
        return self._signed((highs << np.uint64(self.low_bits)) | self._lows(first, stop - first))

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, only the bytes up to its bit are read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = int(self.samples[i // SAMPLE]) // 8, i - i % SAMPLE
        seen -= int(self.high[byte] & ((1 << int(self.samples[i // SAMPLE]) % 8) - 1)).bit_count()
        while seen + (ones := int(self.high[byte]).bit_count()) <= i:
            seen, byte = seen + ones, byte + 1
        place = byte * 8 + int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[i - seen])
        return int(self._signed(np.array([place - i], np.uint64) << np.uint64(self.low_bits) | self._lows(i, 1))[0])


def file_bytes(docs: list[int | None], ids: list[bytes], place: int) -> bytes:
    """One file; ``ids`` little-endian unsigned 32-bit, ``docs`` ascending with nulls first."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    nulls = sum(x is None for x in docs)
    parts = [_HEADER.pack(MAGIC, width, 0, 0, nulls, len(docs), len(flat), place), flat.astype(f"<u{width}").tobytes()]
    parts += [EliasFano.of(np.cumsum([len(x) // 4 for x in ids])).to_bytes(), EliasFano.of(np.array(docs[nulls:], np.int64)).to_bytes()]
    check = 0
    for x in parts:
        check = zlib.crc32(x, check)
    return b"".join([*parts, struct.pack("<I", check)])


def place_and_ids(content: pa.Buffer) -> tuple[int, int]:
    """A file's place and number of ids, from its header alone."""
    head = _HEADER.unpack_from(content)
    return head[7], head[6]


class TokenFile:
    """A file's content: ``place``, ``doc_ids``, and ids by number of the document."""

    def __init__(self, content: bytes):
        self.magic, self.width, _, _, self.nulls, self.n_docs, self.n_ids, self.place = _HEADER.unpack_from(content)
        view = memoryview(content)
        at = _HEADER.size + self.width * self.n_ids
        if self.magic != MAGIC:
            raise ValueError("not a token file")
        self.ids = np.frombuffer(view[_HEADER.size : at], f"<u{self.width}")
        self.ends, at = EliasFano.from_bytes(view, at)
        self._docs, at = EliasFano.from_bytes(view, at)
        if struct.unpack_from("<I", content, at)[0] != zlib.crc32(view[:at]):
            raise ValueError("a token file is damaged")

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + self._docs.all().tolist()

    def block(self, first: int, stop: int) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents ``first`` to ``stop - 1``, and the places where they begin and the last one ends."""
        ends = self.ends.between(first, stop)
        begin = self.ends.select(first - 1) if first else 0
        docs = [None] * max(0, min(stop, self.nulls) - first)
        return docs + self._docs.between(max(first - self.nulls, 0), stop - self.nulls).tolist(), np.concatenate([[begin], ends])

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)].astype("<u4")


def write_token_files(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encodes every whole text, appends ``end_id`` and writes the files under ``path``, in ascending doc_id order.

    Texts are range-partitioned and sorted by id, then text; null ids come first. A null text is empty; repeated rows stay.
    Each file is one row of Spark's text sink, whose bytes go out as they are, so the sink's commit protocol holds and
    any store that Spark can write will do. An empty table writes no file.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("spread").asc()]
    rows = id_and_text(df, id_col, text_col).withColumn("spread", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = encoder(tokenizer), TaskContext.get().partitionId() << 32
        docs: list[int | None] = []
        ids: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file_bytes(docs, ids, place)], pa.binary())], names=["file"])

        for batch in rows_of(batches):
            for doc, x in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                docs.append(doc)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= file_ids:
                    yield done()
                    docs, ids, size, place = [], [], 0, place + 1
        if docs:
            yield done()

    rows.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of all files: start counts the ids of all documents before; with ``digests``
    ``ids_crc32`` in place of ``ids``. Nothing written gives an empty table.

    Documents are found through the files' select structures, a block of neighbours at a time. With digests the files are
    read once; their rows are small and are kept, and the files' totals come from these. The totals are summed in order of
    place, first in runs of files and then over the runs' totals, so no single task has to take every file.
    """
    kind, name = (pa.int64(), "ids_crc32") if digests else (pa.binary(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                file = TokenFile(content.as_buffer())
                for first in range(0, file.n_docs, BLOCK):
                    docs, cuts = file.block(first, min(first + BLOCK, file.n_docs))
                    ids = [file.ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    ids = list(map(zlib.crc32, ids)) if digests else ids
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cuts[:-1], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(ids, kind), pa.array([file.place] * len(docs), pa.int64())], names=["doc_id", "at", "n_tokens", name, "place"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [place_and_ids(x.as_buffer()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in heads], pa.int64()) for k in (0, 1)], names=["place", "n"])

    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(run, f"doc_id long, at long, n_tokens long, {name} {'long' if digests else 'binary'}, place long")
    if digests:
        rows = cut(rows)
        totals = rows.groupBy("place").agg(F.sum("n_tokens").alias("n"))
    else:
        totals = files.mapInArrow(sizes, "place long, n long")
    totals = cut(totals).withColumn("run", F.shiftright("place", 32).cast("long"))
    runs = totals.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("place")) - F.col("n")
    bases = totals.withColumn("inside", inside).join(runs, "run").select(F.col("place").alias("p"), (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(bases, F.col("place") == F.col("p")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", name)


def op10_elias_fano_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of ``documents``, written and read again; null and empty texts are their end id alone, null ids come
    first, repeated rows stay, an empty table has no rows."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, digests=True)
