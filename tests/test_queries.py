import subprocess
import sys

import pytest

import __spark_entry__
from strandloom import file_queries, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(file_queries.oracle_sql()))
def test_file_query_equals_sql(spark, name):
    same(spark, file_queries.queries()[name], file_queries.oracle_sql()[name], SF)


def test_all_tie_breaks_occur(spark):
    """On the fixture made for them: alone, by frequency, by base pairs, by frequent neighbours."""
    found = {r.how for r in queries.correct_ties(spark, "/root/testdata/sf0.01").select("how").distinct().collect()}
    assert found == {"hamming", "minilist", "jaccard", "extended"}


def test_null_distance_equals_brute_force(spark):
    """Means and deviations from distances by an alignment of substrings, on a few reads."""
    from strandloom.operators import align
    from tests.test_alignment import lev

    plan = queries.plan_of(spark, SF)
    reads = queries.mixed(spark, SF).where("rid < 8")
    texts = {r.rid: r.seq for r in reads.collect()}
    queries_of = dict(a for a in plan.adapters if a[0] in ("forw_primer", "rc_forw_primer"))
    for r in align.align_stats(reads, list(queries_of.items()), "rid").collect():
        q, t = queries_of[r.query_id], texts[r.id]
        best = min(lev(q, t[i : i + n]) for i in range(0, len(t), 1) for n in (len(q) - 2, len(q), len(q) + 2))
        assert r.best_edit_distance <= best
        assert lev(q, t[r.best_start_pos - 1 : r.best_stop_pos]) == r.best_edit_distance


def test_every_query_has_a_name_and_columns():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and "cell_umi_counts" in found


def test_works_without_training_data_operators():
    code = "import sys; sys.modules['strandloom.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'demultiplex' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=".", capture_output=True, timeout=120).returncode == 0
