"""The pipeline's stages one after another, each against a plain version on its own input."""

from hashlib import sha256

import corpus_pipeline
from gramwise.llm import toxicity
from gramwise.llm.mixing import mix
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = docs.collect()
        docs = spark.createDataFrame(after, docs.schema)
        ids = sorted(r["doc_id"] for r in after)
        if name == "toxicity":
            scored = toxicity.score(spark.createDataFrame(before, docs.schema), spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert ids == sorted(r["doc_id"] for r in scored if not r["predicted"]) and len(ids) > 0.8 * len(before)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                k = (r["text"] or "").translate(brute.LOW)
                best[k] = max(best.get(k, -1), r["doc_id"])
            assert ids == sorted(best.values())
        elif name == "near_dedup":
            assert ids == sorted({c for _, c in brute.simhash([(r["doc_id"], r["text"]) for r in before]).values()})
        else:
            want = [r["doc_id"] for r in mix(spark.createDataFrame(before, docs.schema)).collect() for _ in range(r["copies"])]
            assert ids == sorted(want)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["decoded_sha256"] == sha256(texts[r["doc_id"]].encode()).hexdigest() for r in last)
    assert len(last) == docs.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, SF)
            assert docs.columns == columns
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (docs.count() > 0)
