import gzip
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandloom import fixtures, scratch
from strandloom.functions import sequence as S
from strandloom.plans import demux, layout
from strandloom.sources import records, sinks, tables
from strandloom.streaming import demux as stream


@pytest.fixture
def fastq(tmp_path):
    rows = [(f"@r{k} x", "ACGT" * (k % 5 + 1), ("@" if k % 3 == 0 else "I") + "I" * (4 * (k % 5 + 1) - 1)) for k in range(500)]
    text = "".join(f"{a}\n{b}\n+\n{c}\n" for a, b, c in rows)
    (tmp_path / "in").mkdir()
    with gzip.open(tmp_path / "in/a.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "plain.fastq").write_text(text)
    return tmp_path, rows


def test_fastq(spark, fastq):
    folder, rows = fastq
    want = {(a.split()[0], b, c) for a, b, c in rows}
    got = records.read_records(spark, f"{folder}/in", full_id=True, glob="*.gz").collect()
    assert {(r.id, r.seq, r.qual) for r in got} == want and {r.full_id for r in got} == {a for a, _, _ in rows}
    part = records.read_records(spark, f"{folder}/in", start=3, stop=5, legacy_names=True).collect()
    assert {r.id for r in part} == {"@r2", "@r3", "@r4"} and part[0].fastq_files


def test_fastq_in_splits(spark, fastq):
    folder, rows = fastq
    for size in ("700", "1111", "4096"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = records.read_records(spark, f"{folder}/plain.fastq").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r.id, r.seq, r.qual) for r in got) == sorted((a.split()[0], b, c) for a, b, c in rows)


def test_fasta_and_sinks(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\nGG\n")
    got = records.read_records(spark, f"{tmp_path}/x.fa", "fasta")
    assert {(r.id, r.seq) for r in got.collect()} == {(">a one", "ACGTAC"), (">b", "GG")}
    sinks.write_reads(got, f"{tmp_path}/out", "fasta")
    assert {(r.id, r.seq) for r in records.read_records(spark, f"{tmp_path}/out", "fasta").collect()} == {(">a one", "ACGTAC"), (">b", "GG")}
    df = spark.createDataFrame([("@q", "ACGT", "IIII")], "id string, seq string, qual string")
    for _ in range(2):
        sinks.write_reads(df, f"{tmp_path}/fq", mode="append")
    assert records.read_records(spark, f"{tmp_path}/fq").count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "w1").write_text("ACTG\nACTG\nAAAA\n")
    (tmp_path / "w2").write_text("27\n0\n")
    for name in ("w1", "w2"):
        assert {r.whitelist_bcs for r in tables.read_whitelist(spark, f"{tmp_path}/{name}", save=f"{tmp_path}/{name}-bits").collect()} == {27, 0}
    assert {r.whitelist_bcs for r in tables.read_whitelist(spark, f"{tmp_path}/w1-bits").collect()} == {27, 0}
    fixed = "r1\t100\t1\t90\t+\tchr1\t1000\t5\t95\t80\t90\t60"
    (tmp_path / "p.paf").write_text(f"{fixed}\tNM:i:1\ttp:A:P\n{fixed}\ttp:A:S\n{fixed.replace('+', '')}\n")
    rows = tables.read_paf(spark, f"{tmp_path}/p.paf").orderBy("tp").collect()
    assert [(r.tp, r.NM, r.qr, r.ql) for r in rows] == [(None, None, None, 100.0), ("tp:A:P", "NM:i:1", "+", 100.0), ("tp:A:S", None, "+", 100.0)]


def test_paf_is_split_once_a_pass_and_numbers_are_told_early(spark, tmp_path, monkeypatch):
    frame = type(spark.range(1))
    fixed = "r1\t100\t1\t90\t+\tchr1\t1000\t5\t95\t80\t90\t60"
    late = fixed.replace("\t60", "\tx")
    lines = [*[f"{fixed}\tNM:i:{k}\t12345" for k in range(3 * tables.FIRST)], f"{fixed}\t\tNM:i:1\ttp:A:P\tNM:i:2\t", "", late]
    (tmp_path / "p.paf").write_text("\n".join(lines) + "\n")
    asked, plans, agg, collect = [], [], frame.agg, frame.collect
    monkeypatch.setattr(frame, "agg", lambda d, *x: asked.append(len(x)) or agg(d, *x))
    monkeypatch.setattr(frame, "collect", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or collect(d))
    got = tables.read_paf(spark, f"{tmp_path}/p.paf")
    # of 15 columns id, qr, sn and NM have no numbers in the first rows; tp's few values come later
    assert asked == [11] and plans[0].count("split(") == 1
    assert "map_from_arrays" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == [*tables.PAF, "12", "NM", "tp"]
    assert [c for c, t in got.dtypes if t == "string"] == ["id", "qr", "sn", "mq", "NM", "tp"] and dict(got.dtypes)["12"] == "double"
    rows = got.collect()
    assert len(rows) == len(lines)
    last = [(r["mq"], r["12"], r.NM, r.tp) for r in rows if r["12"] is None]
    assert sorted(last, key=str) == sorted([("60", None, "NM:i:2", "tp:A:P"), (None, None, None, None), ("x", None, None, None)], key=str)
    # the same from a map
    maps = tables.read_paf(spark, f"{tmp_path}/p.paf", as_map=True)
    key = lambda r: (r.ql, r["mq"], r.NM, r.tp, r["12"])
    cut = maps.select("*", *[maps.tags[t].alias(t) for t in ("12", "NM", "tp")]).withColumn("12", F.expr("try_cast(`12` AS double)"))
    assert sorted(map(key, cut.collect()), key=str) == sorted(map(key, rows), key=str)
    assert tables.read_paf(spark, f"{tmp_path}/p.paf", tags=["zz"]).where("zz IS NOT NULL").count() == 0


def test_layout_files(spark, tmp_path):
    (tmp_path / "layout.csv").write_text("title\nid,seq,expected_length,type\nforw_primer,CTACACGACGCTCTTCCGATCT,,adapter\nbarcode,,16,barcode\numi,,12,umi\npoly_t,,12,poly_t\nread,,,read\nrev_primer,CCCATGTACTCTGCGTTGATACCACTGCTT,,adapter\n")
    (tmp_path / "w").write_text("ACTG\n")
    (tmp_path / "paths.csv").write_text(f"title\npath_type,actual_path\nfile,{tmp_path}\nwhitelist,{tmp_path}/w\n")
    plan = layout.build_plan(spark, f"{tmp_path}/layout.csv", f"{tmp_path}/paths.csv")
    assert plan.layout == layout.kit("three").layout and plan.whitelist.count() == 1


def test_whole_run_and_stream(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    reads = fixtures.frame(spark, sf, fixtures.READS)
    truth = {r.id: (r.true_barcode, r.true_umi) for r in reads.collect()}
    sinks.write_reads(reads, f"{tmp_path}/reads")
    (tmp_path / "w").write_text("\n".join({b for b, _ in truth.values()}))
    plan = layout.kit("three", whitelist=tables.read_whitelist(spark, f"{tmp_path}/w"), paths={"file": f"{tmp_path}/reads", "output_dir": f"{tmp_path}/out"})
    demux.run(spark, plan)
    found = records.read_records(spark, f"{tmp_path}/out/filtered_reads").collect()
    names = [r.id.split("_") for r in found]
    right = sum(truth[a] == (c, b) for a, b, c in names)
    # a primer found by chance on the other strand leaves one or two reads in a hundred undecided
    assert len(found) >= 0.97 * len(truth) and right >= 0.99 * len(found)
    null = demux.calibrate.collected(demux.null_distances(reads, plan))
    lines = lambda out, name: sorted(r.value for r in spark.read.text(f"{tmp_path}/{out}/{name}").drop("batch").collect())
    # however files come, the stream leaves what one run does
    for n in (1, 3):
        told = []
        for _ in range(2):
            stream.start(spark, plan, null, f"{tmp_path}/reads", f"{tmp_path}/stream-{n}", f"{tmp_path}/check-{n}", files=n, told=told.append).awaitTermination()
        assert len(told) == -(-len(list((tmp_path / "reads").glob("*.gz"))) // n) and sum(t["reads"] for t in told) == len(truth)
        for _ in range(2):
            stream.settled(spark, plan, f"{tmp_path}/stream-{n}")
        for name in ("sigsummary", "all_barcodes", "filtered_reads"):
            assert lines(f"stream-{n}", name) == lines("out", name)


def test_a_run_leaves_no_tables_and_reruns_alike(spark, tmp_path):
    reads = fixtures.frame(spark, "/root/testdata/sf0.001", fixtures.MIXED)
    sinks.write_reads(reads, f"{tmp_path}/reads")
    plan = layout.kit("three", whitelist=reads.select(demux.correct.encode("true_barcode").alias("whitelist_bcs")).distinct(), paths={"file": f"{tmp_path}/reads", "output_dir": f"{tmp_path}/out"})
    shared = scratch.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    first = demux.run(spark, plan)
    names = ("sigsummary", "all_barcodes", "filtered_reads", "misalignment_distances")
    read = lambda: [sorted(r.value for r in spark.read.text(f"{tmp_path}/out/{n}").collect()) for n in names]
    left = read()
    assert demux.run(spark, plan) == first and read() == left
    assert set(os.listdir(shared)) == before
    assert first["reads"] == 1500 and first["reads"] - first["short"] == sum(first[c] for c in ("forward", "reverse", "rescuable_concatenates", "undecided")) == len(left[0])
    null = demux.calibrate.collected(demux.null_distances(reads, plan))
    stream.start(spark, plan, null, f"{tmp_path}/reads", f"{tmp_path}/stream", f"{tmp_path}/check").awaitTermination()
    stream.settled(spark, plan, f"{tmp_path}/stream")
    assert set(os.listdir(shared)) == before
    assert demux.run(spark, plan, demux.Options(barcorrect=False))["kept"] == first["listed"]


def test_compressed_files_are_read_once(spark, fastq):
    folder, _ = fastq
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(records.read_records(spark, f"{folder}/in")) == 1
    assert scans(records.read_records(spark, f"{folder}/plain.fastq")) == 2


def test_first_records_open_the_first_files_alone(spark, tmp_path):
    for k in range(6):
        text = "".join(f"@f{k}r{n} x\nACGT\n+\nIIII\n" for n in range(10))
        for kind, opened in (("gz", gzip.open), ("plain", open)):
            (tmp_path / kind).mkdir(exist_ok=True)
            with opened(tmp_path / kind / f"{k}.fastq{'.gz' if kind == 'gz' else ''}", "wt") as f:
                f.write(text)
        (tmp_path / "fa").mkdir(exist_ok=True)
        with gzip.open(tmp_path / f"fa/{k}.fa.gz", "wt") as f:
            f.write("".join(f">f{k}r{n}\nAC\nGT\n" for n in range(10)))
    for name in ("5.fastq.gz", "4.fastq.gz"):
        (tmp_path / "gz" / name).write_bytes(b"broken")  # never opened
    for kind, fmt, mark in (("gz", "fastq", "@"), ("plain", "fastq", "@"), ("fa", "fasta", ">")):
        got = records.first_records(spark, f"{tmp_path}/{kind}", 25, 3, fmt).collect()
        assert sorted(r.id for r in got) == sorted(f"{mark}f{k}r{n}" for k in range(3) for n in range(10) if 10 * k + n < 25) and {r.seq for r in got} == {"ACGT"}
        assert records.first_records(spark, f"{tmp_path}/{kind}", 1000, 2, fmt).count() == 20


def test_records_over_many_splits(spark, tmp_path):
    wrapped = {f">c{k}": "".join("ACGT"[(i * i + k) % 4] for i in range(n)) for k, n in enumerate((9000, 40, 5001, 0, 3000))}
    (tmp_path / "x.fa").write_text("".join(f"{h}\n" + "".join(f"{q[i : i + 60]}\n" for i in range(0, len(q), 60)) for h, q in wrapped.items()))
    long = [(f"@r{k}", "ACGT" * n, "@" + "I" * (4 * n - 1)) for k, n in enumerate((400, 3, 900, 150, 150, 5, 700))]
    (tmp_path / "x.fastq").write_text("".join(f"{h}\n{q}\n+\n{z}\n" for h, q, z in long))
    for size in ("300", "700", "1500"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            fasta = records.read_records(spark, f"{tmp_path}/x.fa", "fasta").collect()
            fastq = records.read_records(spark, f"{tmp_path}/x.fastq").collect()
            part = records.read_records(spark, f"{tmp_path}/x.fastq", start=3, stop=5).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert {r.id: r.seq for r in fasta} == wrapped and len(fasta) == len(wrapped)
        assert sorted((r.id, r.seq, r.qual) for r in fastq) == sorted(long)
        assert {r.id for r in part} == {"@r2", "@r3", "@r4"}


def test_parts_of_a_fixture_are_a_task_each(spark):
    """Each part is alone in its task and in order, and writing it sorts orders, not the reads made of them."""
    rows = fixtures.parted(spark, "/root/testdata/sf0.001", fixtures.MIXED, 8)
    found = rows.select("rid", "part", F.spark_partition_id().alias("task")).collect()
    assert len({r.part for r in found}) == 8 == len({(r.part, r.task) for r in found}) == len({r.task for r in found})
    assert all([r.rid for r in found if r.part == p] == sorted(r.rid for r in found if r.part == p) for p in range(10, 18))
    kept = fixtures.frame(spark, "/root/testdata/sf0.001", fixtures.MIXED)
    assert sorted(rows.drop("part").collect()) == sorted(kept.collect())
    ordered = rows._jdf.queryExecution().optimizedPlan().outputOrdering()
    assert ordered.size() and "part" in ordered.apply(0).sql()


def test_a_run_takes_reads_to_python_once(spark, tmp_path, monkeypatch):
    """And leaves what the operators leave one after another, which it does without."""
    sf = "/root/testdata/sf0.001"
    reads = fixtures.frame(spark, sf, fixtures.MIXED).select("id", "seq", "qual")
    odd = reads.where(F.crc32("id") % 10 == 0).withColumn("id", F.concat("id", F.lit("x*y and more"))).withColumn("seq", F.when(F.crc32("id") % 3 == 0, F.concat("seq", S.revcomp("seq"), F.substring("seq", 1, 70))).when(F.crc32("id") % 3 == 1, F.substring("seq", 21, 170)).otherwise(F.lower("seq"))).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    sinks.write_reads(reads.unionByName(odd).coalesce(3), f"{tmp_path}/reads")
    plan = layout.kit("three", whitelist=fixtures.barcodes(spark, sf).select(S.encode("true_barcode").alias("whitelist_bcs")))
    left, counts = {}, {}
    for out in ("apart", "once", "sorted"):
        with monkeypatch.context() as m:
            if out == "apart":
                m.setattr(demux.onepass.Cutter, "of", lambda *_: None)
            else:
                m.setattr(demux.extract, "extract", lambda *_: pytest.fail("cut a second time"))
            if out == "sorted":
                m.setattr(demux, "MOST_SENT", 0)
            counts[out] = demux.run(spark, replace(plan, paths={"file": f"{tmp_path}/reads", "output_dir": f"{tmp_path}/{out}"}))
        left[out] = [sorted(r.value for r in spark.read.text(f"{tmp_path}/{out}/{part}").collect()) for part in ("misalignment_distances", "sigsummary", "all_barcodes", "filtered_reads")]
    assert left["apart"] == left["once"] == left["sorted"] and counts["apart"] == counts["once"] == counts["sorted"]
    assert counts["once"]["kept"] > 1000 and counts["once"]["minilist"] + counts["once"]["hamming"] > 0


def test_lines_are_framed_four_at_a_time(spark, tmp_path):
    """Over batches that end anywhere, with empty lines between records, empty reads, cut files, and files in one task."""
    texts = ["".join(f"@{f}{k} x\n{'ACG'[: k % 4]}\n+\n{'III'[: k % 4]}\n" + "\n" * (f == 1 and k % 5 == 0) for k in range(20)) + "@cut\nA\n" * (f == 2) for f in range(4)]
    for f, text in enumerate(texts):
        with gzip.open(f"{tmp_path}/{f}.fastq.gz", "wt") as file:
            file.write(text)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (3, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = records.read_records(spark, str(tmp_path), full_id=True).select("id", "full_id", "seq", "qual", F.regexp_extract("file", "(.)[.]fastq", 1).alias("f")).collect()
            assert sorted(map(tuple, got)) == sorted((f"@{f}{k}", f"@{f}{k} x", "ACG"[: k % 4], "III"[: k % 4], str(f)) for f in range(4) for k in range(20))
            assert sorted(r.id for r in records.read_names(spark, str(tmp_path)).collect()) == sorted(r.id for r in got)
            assert sorted(r.id for r in records.first_records(spark, f"{tmp_path}", 50, 3).collect()) == sorted([f"@{f}{k}" for f in (0, 1) for k in range(20)] + [f"@2{k}" for k in range(10)])
            assert sorted(r.id for r in records.first_records(spark, f"{tmp_path}/1.fastq.gz", 15, 3).collect()) == sorted(f"@1{k}" for k in range(15))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fixtures_are_made_as_their_sql_has_them(spark, tmp_path):
    """With null and negative keys, and gaps."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey").where("o_orderkey % 13 <> 4")
    orders.select(F.expr("CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey > 1200 THEN -o_orderkey ELSE o_orderkey END").alias("o_orderkey"), F.expr("CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE o_custkey END").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    orders = spark.read.parquet(f"{tmp_path}/orders.parquet")
    by_sql = lambda sql: spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders)
    for sql in (fixtures.READS, fixtures.MIXED, fixtures.CHAINS):
        got = fixtures.chains(spark, str(tmp_path)) if sql == fixtures.CHAINS else fixtures.made(spark, str(tmp_path), sql)
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, by_sql(sql).collect()))
    assert sorted(map(str, fixtures.barcodes(spark, str(tmp_path)).collect())) == sorted(map(str, by_sql(fixtures.READS).select("true_barcode").distinct().collect()))


def test_calibration_opens_no_file_that_it_does_not_need(spark, tmp_path):
    with gzip.open(f"{tmp_path}/a.fastq.gz", "wt") as file:
        file.write("".join(f"@{k}\nACG\n+\nIII\n" for k in range(30)))
    (tmp_path / "b.fastq.gz").write_bytes(b"no gzip")
    assert sorted(r.id for r in records.first_records(spark, str(tmp_path), 30, 2).collect()) == sorted(f"@{k}" for k in range(30))
