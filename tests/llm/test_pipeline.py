"""The pipeline's stages, on documents and on odd rows."""

import hashlib

import corpus_pipeline
from test_text import SCHEMA, base_rows

from ledgerloom.llm import minhash, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_one_another(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        kept[name] = docs.count()
        if n == 0:
            want = quality.classify(before, spark.read.parquet(f"{sf}/labels.parquet")).where("is_kept")
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect())
        if n == 1:
            want = minhash.near_duplicates(before).where("is_kept")
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(r[0] for r in want.select("doc_id").collect())
        if n == 2:
            want = {r.doc_id: r.text for r in pii.pseudonymised(before.select("doc_id", "text"), pii.secret(spark)).collect()}
            assert {r.doc_id: r.text for r in docs.collect()} == want
        if n == 3:
            assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
            mixed = docs
        if n == 4:
            want = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect())
            assert sorted((r.doc_id, r.decoded_sha256) for r in docs.collect()) == want
    assert kept["near duplicates"] <= kept["quality classifier"] <= 200


def test_stages_take_odd_rows(spark, sf, tmp_path):
    docs = spark.createDataFrame(base_rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "in"))
    for empty in (False, True):
        now = spark.read.parquet(str(tmp_path / "in")).where("not " + str(empty).lower())
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, sf)
            out.write.parquet(str(tmp_path / f"{empty}{n}"))
            now = spark.read.schema(out.schema).parquet(str(tmp_path / f"{empty}{n}"))
        assert (now.count() == 0) == empty
