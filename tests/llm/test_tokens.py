"""Encoding, packing and token files against the libraries themselves and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from voxmill.llm import bpe, elias_fano, packing
from voxmill.llm.tokens import ChunkEncoder

ODD = [
    "", " ", "  ", "a", "a b", " a  b ", "it's we'll\n x\t y \n\n z ", "x" * 3000, " a  b", "Ünï cödé ñ 東京 🙂🙂 á b ́c", "a \x1cb \x85 c\x1c d",
    "<|endoftext|> a <|endoftext|>b", "1 22 333 4444", "The the THE, the.\nThe", "line\n\nline  two   three \n", "a" + " " * 50 + "b", "Σας ΣΑΣ. ΑΣ", None,
]


def reference(name, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path(name))
    own.encode_special_tokens = True
    return [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def mixed(count, seed=1):
    rng = random.Random(seed)
    marks = [" ", " ", " ", "  ", "\n", " \n", ". ", "'s ", ", ", " ", "é", "Word", "a", "the", "12", "́", "\t", "-", "東"]
    return ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(count)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_join_to_the_whole(name):
    texts = ODD + mixed(2000)
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(P.path(name)).encode(texts)]
    assert got == reference(name, texts)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("voxmill.llm.tokens.CACHED_CHUNKS", 5)
    texts = mixed(200, 2)
    got = [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(P.path("byte_bpe_50k.json")).encode(texts)]
    assert got == reference("byte_bpe_50k.json", texts)


def frame(spark, texts, ids=None):
    rows = [(i, t, "x", 7) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(3)


def test_op4_matches_the_library_and_decodes(spark):
    own = bpe._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ODD + mixed(200)
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decoded=True).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(got[i].ids) // 4 and bytes(got[i].decoded) == (t or "").encode()
    again = bpe.decode(bpe.encode(frame(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in again.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode(frame(spark, texts).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op4_spans_are_safe():
    own = bpe._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in mixed(300, 5) + [" ".join(mixed(50, 6))]:
        assert "".join(bpe.spans(t, 7)) == t
        assert [y for x in bpe.spans(t, 7) for y in own.encode_ordinary(x)] == own.encode_ordinary(t)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op9_pieces_and_sequences(spark):
    texts = ODD + [" ".join(["word"] * n) for n in (2046, 2047, 2048, 4095, 4096, 9000)] + mixed(300)
    path = P.path("word_bpe_49k.json")
    pieces = packing.token_pieces(frame(spark, texts), path)
    rows = packing.pack(pieces).collect()
    want = {i: x + [0] for i, x in enumerate(reference("word_bpe_49k.json", texts))}
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(got.setdefault(r.doc_id, [])) and r.start == 2048 * r.piece
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == want
    count = check_packing(rows, 2048)
    total = sum(map(len, want.values()))
    assert count <= -(-total // 2048) + 2
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == total and all(len(r.ids) <= 4 * 2048 for r in whole)


@pytest.mark.parametrize("bins", [1, 3, 64])
def test_op9_packs_any_lengths(spark, bins, monkeypatch):
    monkeypatch.setattr("voxmill.llm.packing.BINS_PER_TASK", 5)
    rng = random.Random(bins)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 20), 100]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "k long, length long").repartition(7)
    rows = packing.pack(df, capacity=100, open_bins=bins).collect()
    assert sorted((r.k, r.length) for r in rows) == list(enumerate(lengths))
    check_packing(rows, 100)
    assert packing.pack(df.limit(0), capacity=100).count() == 0


def test_op9_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr("voxmill.llm.packing.BINS_PER_TASK", 5)
    df = spark.createDataFrame([(i, i % 7 + 1, "a", "b", None) for i in range(60)], "key long, length long, to string, base string, sequence_id string").repartition(3)
    rows = packing.pack(df, capacity=10, open_bins=3).collect()
    assert sorted((r.key, r.length, r.to, r.base) for r in rows) == [(i, i % 7 + 1, "a", "b") for i in range(60)]
    check_packing(rows, 10)


def test_elias_fano_round_trip():
    rng = random.Random(3)
    for values in ([], [0], [5, 5, 5], [-(2**63), 0, 2**63 - 1], sorted(rng.randrange(-(10**9), 10**12) for _ in range(3000)), list(range(1000)), [0] * 999 + [10**15]):
        made = elias_fano.EliasFano.of(np.array(values, np.int64))
        back, _ = elias_fano.EliasFano.from_bytes(memoryview(b"xx" + made.to_bytes()), 2)
        assert back.all().tolist() == values
        assert all(back.select(i) == values[i] for i in range(0, len(values), max(1, len(values) // 97)))
        for a in range(0, len(values), max(1, len(values) // 11)):
            for b in (a + 1, a + 255, a + 256, a + 700, len(values)):
                assert back.between(a, min(b, len(values))).tolist() == values[a : min(b, len(values))]


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert len(elias_fano.EliasFano.of(ends).to_bytes()) * 8 / 100_000 < 2 + np.log2(1000) + 1.5


def test_op10_files_round_trip(spark, tmp_path):
    texts = ODD + mixed(200) + ["again", "again", "other"]
    ids = list(range(-5, len(texts) - 8)) + [None, None, 3]
    path = f"{tmp_path}/files"
    elias_fano.write_token_files(frame(spark, texts, ids), path, P.path("byte_bpe_50k.json"), file_ids=300)
    rows = sorted(elias_fano.read_token_files(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = {}
    for i, x in zip(ids, reference("byte_bpe_50k.json", texts)):
        want.setdefault(i, []).append(x + [2])
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
        want[r.doc_id].remove(np.frombuffer(r.ids, "<u4").tolist())
    assert not any(want.values())
    digests = sorted(elias_fano.read_token_files(spark, path, digests=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digests] == [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows]
    frame(spark, texts).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert elias_fano.op10_elias_fano_output(spark, str(tmp_path)).count() == 0
    assert packing.op9_best_fit_packing(spark, str(tmp_path)).count() == 0


def test_op10_file_finds_a_document(spark, tmp_path):
    path = f"{tmp_path}/files"
    elias_fano.write_token_files(frame(spark, mixed(100)), path, P.path("byte_bpe_50k.json"))
    contents = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
    docs = {i: x + [2] for i, x in enumerate(reference("byte_bpe_50k.json", mixed(100)))}
    for file in map(elias_fano.TokenFile, contents):
        for k, doc in enumerate(file.doc_ids()):
            assert file.document(k).tolist() == docs[doc]
    with pytest.raises(ValueError):
        elias_fano.TokenFile(contents[0][:70] + b"?" + contents[0][71:])


def test_registered_queries_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    own = bpe._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: r for r in bpe.op4_byte_bpe(spark, sf).collect()}
    for i, t in docs:
        ids = own.encode_ordinary(t or "")
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_tokens == len(ids)
    got, at = {r.doc_id: r for r in elias_fano.op10_elias_fano_output(spark, sf).collect()}, 0
    for (i, _), x in zip(docs, reference("byte_bpe_50k.json", [t for _, t in docs])):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(x) + 1, zlib.crc32(np.array(x + [2], "<u4").tobytes()))
        at += len(x) + 1
    rows = packing.op9_best_fit_packing(spark, sf).collect()
    check_packing(rows, 2048)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for (i, _), x in zip(docs, reference("word_bpe_49k.json", [t for _, t in docs])):
        x = x + [0]
        want |= {(i, k): (s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(x), 2048))}
    assert got == want
