"""The corpus pipeline over a planted table: what goes, what stays, and that every kept id is packed once."""

import random

import numpy as np
import pytest

import corpus_pipeline
from wayloom.llm import token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "the of and road river house tree stone light water north south hill field bird song rain snow wind night".split()


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(rng.randint(40, 90)), "en", "src0") for i in range(150)]
    exact = [(200 + k, rows[k][1] + " ", "en", "src1") for k in range(5)]  # longer by a space: these stay
    near = [(300 + k, rows[50 + k][1] + " more", "en", "src1") for k in range(5)]
    toxic = [(400 + k, prose(30) + " idiot idiot " + prose(30), "en", "src2") for k in range(30)]
    odd = [(500, "123 %%", "en", "src3"), (501, None, "en", "src3"), (502, rows[0][1] + " ", None, "src3")]
    table = [(*r, len(r[1] or "")) for r in rows + exact + near + toxic + odd]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in rows[:80]] + [(r[0], 1, 1) for r in toxic[:20]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in docs.collect()}
    every = {r[0] for r in table}
    assert left["language_id"] == every - {500, 501}
    assert left["exact_dedup"] == left["language_id"] - {0, 1, 2, 3, 4, 502}
    assert left["near_dedup"] == left["exact_dedup"] - {300 + k for k in range(5)}
    assert {i for i in left["mixing"] if i < 400} == {i for i in left["near_dedup"] if i < 400} and len([i for i in left["mixing"] if i >= 400]) < 5
    pieces = out.collect()
    assert {p.doc_id for p in pieces} == left["mixing"]
    tok, text = token_count.tokenizer(public_tokenizers.path("word_bpe_49k.json")), {r[0]: r[1] for r in table}
    for i in left["mixing"]:
        assert sum(p.length for p in pieces if p.doc_id == i) == len(tok.encode(text[i], add_special_tokens=False).ids) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)
    assert np.all([p.offset + p.length <= 4096 for p in pieces])


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(9000)
    table = [(5, a), (None, a), (None, b), (None, b), (1, b + " "), (7, c), (7, prose(50)), (8, c + " x"), (None, a + " y"), (9, None), (9, "")]
    rows = [(i, t, "en", "s", len(t or ""), "clash", 3) for i, t in table] + [(100 + k, prose(40), "en", "s", 1, "clash", 3) for k in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + k, 1, 0) for k in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    exact = corpus_pipeline.drop_exact_copies(spark, docs, str(tmp_path))
    assert exact.columns == corpus_pipeline.COLUMNS
    kept = sorted((r.doc_id or 0, len(r.text or "")) for r in exact.collect() if (r.doc_id or 0) < 100)
    assert kept == sorted([(5, len(a)), (1, len(b) + 1), (7, len(c)), (7, len(table[6][1])), (8, len(c) + 2), (0, len(a) + 2), (9, 0)])
    near = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in near.collect() if (r.doc_id or 0) < 100) == [1, 5, 7, 7, 9]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 9").count() == 0


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
