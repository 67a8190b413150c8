import re

import corpus_pipeline
from strandloom.llm import near, packing, secret, toxicity
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_their_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        kept[name] = docs, (out := spark.read.parquet(f"{tmp_path}/{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs = out
    before, after = kept["toxicity"]
    chain = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    gone = {r.doc_id for r in before.collect() if chain.score(chain.tag(words(r.text))[1], len(words(r.text))) >= 0.3}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone
    before, after = kept["minhash_near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, _, c in brute(rows, 5, 80) if d == c)
    before, after = kept["secret_scan"]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text and secret.redact(r.text) for r in before.collect()}
    before, after = kept["mix_sources"]
    assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
    before, after = kept["best_fit_packing"]
    assert after.where("piece = 0").count() == before.count() and after.columns[-2:] == ["sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None and near.Near().words == 5 and packing.CAPACITY == 2048
    assert corpus_pipeline.run(spark, SF).count() == after.count()
