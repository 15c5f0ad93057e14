"""Op 4, byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.tokens import id_and_text, rows_of
from voxmill.session import read_table

#: Longer texts are encoded in spans of about so many characters, each ended at a safe boundary.
SPAN_CHARS = 100_000

#: No match of the split pattern spans a blank between two characters that are no white space, other than as its first.
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, size: int = SPAN_CHARS) -> list[str]:
    """The text in pieces whose encodings join to that of the whole; a text without a safe boundary stays whole."""
    out, start = [], 0
    while len(text) - start > size and (found := _SAFE_BLANK.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def encode_text(encoding, text: str) -> bytes:
    return b"".join(np.array(encoding.encode_ordinary(x), dtype="<u4").tobytes() for x in spans(text))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, with ``decoded`` also the bytes that the ids stand for.

    ids: little-endian unsigned 32-bit. Null and empty texts have no ids. Rows stay apart, also repeated ones and those
    with a null doc_id. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path, pattern)
        for batch in rows_of(batches):
            ids = [encode_text(own, x or "") for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)``: raw bytes, as ids may end inside a character; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoding(path, pattern)
        for batch in rows_of(batches):
            out = [None if x is None else own.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text of ``documents``, as digests; null and empty texts have no ids, repeated rows stay."""
    import public_tokenizers

    done = encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
