"""The jobs on copies of tables that grow, and on files."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from jobs import config_of, demultiplex_reads, queries, sort_texts
from strandloom import fixtures
from strandloom.operators.align import find_tags, pieces_of
from strandloom.plans import demux, layout
from strandloom.sources import sinks, tables
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def _cells(spark, out):
    return sorted(map(tuple, demultiplex_reads.read_cells(spark, out).collect()))


def _parts(spark, tmp_path, n):
    """Orders as n files, in a folder for each."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    for k in range(n):
        orders.where(f"o_orderkey % {n} = {k}").coalesce(1).write.parquet(f"{tmp_path}/parts/{k}")


def _grow(tmp_path, k, into):
    into.mkdir(exist_ok=True)
    for p in (tmp_path / f"parts/{k}").glob("*.parquet"):
        shutil.copy(p, into / f"{k}.parquet")


def test_reads_of_a_growing_table_are_aligned_once(spark, tmp_path):
    """Two runs over growing input, and a third over the same, give what one run over all of it gives."""
    _parts(spark, tmp_path, 3)
    known = fixtures.frame(spark, SF, fixtures.READS).select("true_barcode").distinct()
    sinks.write_lines(known, "true_barcode", f"{tmp_path}/whitelist")
    sql = f"SELECT id, seq, qual FROM ({fixtures.MIXED.replace('FROM orders', 'FROM {input}')})"
    config = config_of(demultiplex_reads.JOB) | {"format": "parquet", "reads_sql": sql, "files_per_batch": 1}
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.sources.partitionOverwriteMode")}
    run = lambda: demultiplex_reads.run(spark, f"{tmp_path}/in", f"{tmp_path}/whitelist", f"{tmp_path}/out", f"{tmp_path}/state", config)
    rows = [spark.read.parquet(f"{tmp_path}/parts/{k}").count() for k in range(3)]
    _grow(tmp_path, 0, tmp_path / "in")
    _grow(tmp_path, 1, tmp_path / "in")
    first = run()
    assert first["batches"] == 2 and first["new_reads"] == rows[0] + rows[1]
    half = _cells(spark, f"{tmp_path}/out")
    _grow(tmp_path, 2, tmp_path / "in")
    second = run()
    assert second["batches"] == 1 and second["new_reads"] == rows[2] and second["cut"] > first["cut"]
    whole = _cells(spark, f"{tmp_path}/out")
    third = run()
    assert third["batches"] == third["new_reads"] == 0 and _cells(spark, f"{tmp_path}/out") == whole != half
    assert before == {k: spark.conf.get(k) for k in before} and not spark.catalog.listTables()
    # one run over all reads, by the thresholds that the first run measured
    plan = layout.kit("three", whitelist=tables.read_whitelist(spark, f"{tmp_path}/whitelist"))
    null = demux.calibrate.collected(spark.read.option("header", True).csv(f"{tmp_path}/out/misalignment_distances", schema="query_id string, null_distance double, sd_null double"))
    reads = spark.sql(sql, input=spark.read.parquet(f"{tmp_path}/in"))
    cells = demux.cell_counts(demux.demux(spark, plan, reads=reads, null=null)).collect()
    assert sorted((r.barcode, r.reads, r.umis, r.barcode[:2]) for r in cells) == whole


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    reads = fixtures.frame(spark, SF, fixtures.READS)
    sinks.write_reads(reads, f"{tmp_path}/in")
    sinks.write_lines(reads.select("true_barcode").distinct(), "true_barcode", f"{tmp_path}/whitelist")
    config = config_of(demultiplex_reads.JOB) | {"files_per_batch": 1}
    run = lambda out: demultiplex_reads.run(spark, f"{tmp_path}/in", f"{tmp_path}/whitelist", f"{tmp_path}/{out}", f"{tmp_path}/state-{out}", config)
    whole = run("whole")
    write, calls = sinks.write_signatures, []

    def breaks(*a, **k):
        write(*a, **k)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "write_signatures", breaks)
    with pytest.raises(Exception, match="lost"):
        run("broken")
    again = run("broken")
    assert again["cut"] == whole["cut"] and again["batches"] == whole["batches"] - 1
    assert _cells(spark, f"{tmp_path}/broken") == _cells(spark, f"{tmp_path}/whole")
    assert spark.read.text(f"{tmp_path}/broken/sigsummary").count() == spark.read.text(f"{tmp_path}/whole/sigsummary").count()


def test_texts_by_their_tags(spark, tmp_path):
    config = {"format": "parquet", "text_column": "text", "most": 2, "tags": {"one": "alpha beta gamma", "two": "ACGTACGTACGT"}}
    rows = [(1, "x alpha beta gamma y", "p"), (2, "alphabeta gamme", "q"), (3, None, "r"), (4, "", None), (None, "ACGTACCTACGT alpha beta gamma", "s"), (5, "alpha", "t"), (6, "é" * 5000 + "ACGACGTACGT" + "é" * 200_000 + "ACGTACTACGT", "u"), (1, "x alpha beta gamma y", "p")]
    spark.createDataFrame(rows, "id long, text string, label_of string").write.parquet(f"{tmp_path}/in")
    counts = sort_texts.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config)
    read = lambda: sorted(((r.id or 0, r.label, r.label_of or "", [(t.tag, t.distance, t.starts, t.stops) for t in r.tags]) for r in sort_texts.read_sorted(spark, f"{tmp_path}/out").collect()), key=repr)
    got = read()
    assert counts == {"one": 3, "two": 1, "several": 1, "none": 3} and sort_texts.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config) == counts and read() == got
    found = {(i, lab): tags for i, lab, _, tags in got}
    assert found[1, "one"] == [("one", 0, [3], [18])] and found[2, "one"][0][1] == 2 and found[0, "several"][0][:2] == ("one", 0) and found[0, "several"][1][:2] == ("two", 1)
    assert found[6, "two"][0][1] == 1 and len(found[6, "two"][0][2]) >= 2 and found[6, "two"][0][3][-1] == 5000 + 11 + 200_000 + 11
    assert sum(i in (3, 4, 5) for i, lab, *_ in got if lab == "none") == 3


def test_tags_equal_a_table_of_distances(spark):
    """All texts with a place within the edits are found, though only those that hold a part as it is are aligned."""
    import random

    from tests.test_alignment import table

    rng = random.Random(31)
    tags = {"a": "the quick brown", "b": "lazy dogs", "c": "aaaaaaaa"}
    texts = []
    for _ in range(150):
        t = list(rng.choice([*tags.values(), "", "other words"]))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a", " "])
        texts.append("zz a " * rng.randint(0, 3) + "".join(t) + rng.choice(["", " tail", "aa"]))
    got = find_tags(spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id int, text string, tags string"), "text", tags, 2).collect()
    assert sorted(r.id for r in got) == list(range(len(texts)))
    for r in got:
        want = []
        for name, phrase in tags.items():
            last = table(phrase, r.text, (), False)[-1]
            if min(last) <= 2:
                want.append((name, min(last), [j for j, v in enumerate(last) if v == min(last)]))
        assert [(t.tag, t.distance, t.stops) for t in r.tags] == want
    assert "".join(p for _, p in pieces_of("abcdefg", 2)) == "abcdefg"
    with pytest.raises(ValueError):
        pieces_of("ab", 2)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    assert sort_texts.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", config_of(sort_texts.JOB)) == {}


def test_command_line(tmp_path):
    """In a session of its own, from another folder."""
    import pandas

    pandas.DataFrame({"id": [1, 2], "text": ["say ABCDEFGH", "no"]}).to_parquet(tmp_path / "in.parquet")
    (tmp_path / "config.json").write_text(json.dumps({"tags": {"t": "ABCDEFGX"}, "most": 1}))
    env = os.environ | {"PYTHONPATH": os.getcwd()}
    command = [sys.executable, "-m", "jobs.sort_texts", "--input", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "out"), "--config", str(tmp_path / "config.json")]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0 and "2 texts written" in done.stderr, done.stderr[-2000:]
    assert sorted(os.listdir(tmp_path / "out"))[-2:] == ["label=none", "label=t"]


def test_jobs_import_nothing_of_llm():
    code = "import sys; sys.modules['strandloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import jobs.queries"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=120).returncode == 0
