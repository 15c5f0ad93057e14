"""The pipeline against brute force, stage by stage."""

import re

import numpy as np
import public_tokenizers as P

import corpus_pipeline as C
from tests.llm.test_operators import base_spans, brute_groups
from tests.llm.test_tokens import check_packing, reference
from voxmill.llm import quality

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = [], 0
    for start, less, kind in sorted((a, -b, k) for k, a, b in base_spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -less)
    return "".join(out) + text[at:]


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    model = quality.Machine(model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32))
    good = [r for r, s in zip(rows, model.scores([quality.features(t) for _, t in rows])) if s >= quality.THRESHOLD]
    groups = brute_groups(good, 5)
    kept = [(i, redacted(t)) for i, t in good if groups[i][1] == i]
    got = {}
    out = C.run(spark, SF).collect()
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {i: x + [0] for (i, _), x in zip(kept, reference("word_bpe_49k.json", [t for _, t in kept]))}
    check_packing(out, 2048)


def test_stages_keep_columns_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    same = "one two three four five six seven eight nine ten, mail a.b@c.de"
    rows = [(1, same, "en", None, 1), (1, same, "en", None, 1), (None, same, None, None, None), (2, None, "de", "s", 0), (3, "", "de", "s", 0), (4, same, "x", "s", 1)]
    df = spark.createDataFrame(rows, schema)
    out = C.near_dedup(spark, df, SF)
    assert out.columns == C.COLUMNS and sorted((r.doc_id or 0) for r in out.collect()) == [1, 2, 3]
    out = {r.doc_id: r for r in C.redact(spark, df, SF).collect()}
    assert out[4].text.endswith("mail [EMAIL]") and out[4].n_chars == len(out[4].text) and out[2].text is None and out[3].n_chars == 0
    for _, stage in C.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0
    assert re.fullmatch("quality classifier|PII|best-fit packing|MinHash near-dedup", C.STAGES[0][0])


def test_near_dedup_keeps_every_distinct_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    x, y, z = (" ".join(f"{k}{i}" for i in range(12)) for k in "xyz")
    rows = [(2, x, "en", "s", 1), (5, x, "en", "s", 1), (5, y, "en", "s", 1), (5, y, "en", "s", 1), (5, y, "de", "s", 1), (None, z, None, None, None), (None, z, "q", None, None), (7, None, None, None, None)]
    outs = [sorted(((r.doc_id or 0, r.text or "") for r in C.near_dedup(spark, spark.createDataFrame(rows[::step], schema).repartition(3), SF).collect())) for step in (1, -1)]
    assert outs[0] == outs[1] == [(0, z), (2, x), (5, y), (7, "")]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (3, "x" * 200_000, "en", "s", 1)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], schema + ", class_no string, row int")
    for _, stage in C.STAGES[1:]:
        assert {r.doc_id for r in stage(spark, df, SF).collect()} == ({1, 3} if stage is C.near_dedup else {1, 2, 3})
