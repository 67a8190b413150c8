import gzip

from pyspark.sql import functions as F

from strandloom.llm import warc

ROWS = [(k, f"http://h/{k}", f"<p>é {k}</p>" * (k % 5), "x") for k in range(60)] + [(7, "http://h/7", "<p>é 7</p>" * 2, "x"), (None, None, None, "x"), (7, "http://h/7", "other", "x")]
SCHEMA = "page_id long, url string, html string, archive string"


def test_audit_finds_every_fault(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 20)
    left = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ({3}, {3, 4, 41}, set(), set(range(60))):
        right = left.withColumn("html", F.when(F.col("page_id").isin(*bad, -1), F.regexp_replace("html", "p", "q")).otherwise(F.col("html")))
        got = warc.audit(left, right).collect()
        changed = {r[0] for r in ROWS if r[0] in bad and r[2] and "p" in r[2]}
        assert {r.page_id for r in got if r.corrupt} == changed and len(got) == 62
        assert {r.copies for r in got if r.page_id == 7} == {1, 2} or 7 not in {r.page_id for r in got}
    for (archive,) in {(r.archive,) for r in got}:
        own = sorted((r.start, r.stop) for r in got if r.archive == archive)
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_lost_records(spark):
    left = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.audit(left, left.where("page_id IS NULL OR page_id <> 30")).collect()
    # those after it only lie elsewhere
    assert [r.page_id for r in got if r.corrupt] == [30] and not any(r.corrupt for r in warc.audit(left, left.repartition(5)).collect())
    longer = left.withColumn("html", F.when(F.col("page_id").isin(2, 31), F.concat("html", F.lit("more"))).otherwise(F.col("html")))
    assert sorted(r.page_id for r in warc.audit(left, longer).collect() if r.corrupt) == [2, 31]
    assert not any(r.corrupt for r in warc.audit(left.where("page_id IS NULL OR page_id <> 30"), left).collect())
    assert warc.audit(left.limit(0), left.limit(0)).count() == 0


def test_files_round_trip(spark, tmp_path):
    left = spark.createDataFrame(ROWS, SCHEMA)
    warc.write_archives(left, f"{tmp_path}/w", 3)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert sorted((r.url or "", bytes(r.payload).decode()) for r in got) == sorted({(r[0], r[1] or "", r[2] or "") for r in ROWS} and [(u, h) for _, u, h in {(r[0], r[1] or "", r[2] or "") for r in ROWS}])
    placed = warc.placed(warc.leaves(left), 3).collect()
    assert sorted((r.url or "", r.start, r.stop) for r in placed) == sorted((r.url or "", r.start, r.stop) for r in got)


def test_broken_and_gzipped_files(spark, tmp_path):
    record = lambda body: b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: http://h\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)
    one, two, bad, cut = record(b"one"), record(b"two\r\n\r\n"), record(b"bad").replace(b"Length: 3", b"Length: x"), record(b"cut short")[:-7]
    (tmp_path / "a.warc").write_bytes(one + bad + two + cut)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(bad)[:-3])
    (tmp_path / "c.warc").write_bytes(b"")
    got = {}
    for r in warc.read_archives(spark, str(tmp_path)).collect():
        got.setdefault(r.file[-1], []).append((r.start, r.stop, r.type, bytes(r.payload)))
    sizes = [len(x) for x in (one, bad, two, cut)]
    ends = [sum(sizes[: k + 1]) for k in range(4)]
    assert sorted(got["c"]) == [(0, ends[0], "resource", b"one"), (ends[0], ends[1], "broken", bad), (ends[1], ends[2], "resource", b"two\r\n\r\n"), (ends[2], ends[3], "broken", cut)]
    assert [x[2] for x in sorted(got["z"])] == ["resource", "resource", "broken"] and sorted(got) == ["c", "z"]


def test_lost_copies(spark):
    left = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.audit(left, left.dropDuplicates()).collect()
    assert [(r.page_id, r.copies) for r in got if r.corrupt] == [(7, 2)] and len(got) == 62


def test_one_archive_is_many_tasks(spark):
    left = spark.createDataFrame([(None if k % 3 else 1, f"http://h/{k % 150}", f"{k}", "x") for k in range(300)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = warc.placed(warc.leaves(left), 1).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at = 0
    for k, r in enumerate(sorted(got, key=lambda r: (r.page_id is not None, r.url, r.sha256))):
        assert (r.ordinal, r.start, r.stop) == (k, at, at + r.bytes)
        at += r.bytes
    assert len(got) == 300 and len({r.task for r in got}) > 1
