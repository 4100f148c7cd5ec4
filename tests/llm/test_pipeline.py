import hashlib

import public_tokenizers as tokenizers

import corpus_pipeline
from tessera.llm import bpe, langid
from test_similar import brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns, name
        rows = after.collect()
        ids = {r["doc_id"] for r in rows}
        before = {r["doc_id"]: r["text"] for r in at.collect()}
        assert ids <= set(before), name
        if name == "language_id":
            assert ids <= {i for i, t in before.items() if langid.LETTER.search(t or "")} and len(ids) >= 0.97 * len(before)
        if name == "line_dedup":
            assert all(set((r["text"] or "").split("\n")) <= set(before[r["doc_id"]].split("\n")) for r in rows)
        if name == "near_dedup":
            assert ids == brute(before.items())
        at = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    enc = bpe.TreeCoder(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN).encoding
    texts = {r["doc_id"]: r["text"] for r in at.collect()}
    assert len(out) == at.count()
    assert sorted(map(str, out)) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
    for r in out:
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
