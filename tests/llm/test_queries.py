import hashlib

import pytest

from strandloom.llm import queries, sql
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], sql.oracle_sql()[name], SF)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 13))


def test_near_duplicates_query_equals_brute_force(spark):
    from tests.llm.test_near import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op4_minhash_near_dedup(spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute([tuple(d) for d in docs], 3, 85))


def test_embeddings_query_equals_brute_force(spark):
    from tests.llm.test_vectors import brute

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op9_embedding_near_dedup(spark, SF).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == brute(rows)


def test_spans_queries_equal_patterns(spark):
    from tests.llm.test_scans import private, secrets

    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for query, found, kinds in ((queries.op3_secret_scan, secrets, ("assign", "access", "hex")), (queries.op8_personal_data, private, ("email", "ip", "card", "phone"))):
        rows = query(spark, SF).collect()
        assert sorted(r.doc_id for r in rows) == sorted(text)
        for r in rows:
            base = found(text[r.doc_id] or "")
            assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in base) for k in kinds]
            spans = [f"{k}:{s}:{e}" for k, s, e in base]
            assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
            assert [s for s in r.spans.split(",") if s.partition(":")[0] in kinds] == spans
