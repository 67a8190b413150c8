"""Queries over files: fixtures written by the sinks, or as text, to the shared folder, and read back by the sources."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import fixtures
from strandloom.functions import sequence as S
from strandloom.operators import calibrate
from strandloom.plans import demux, layout
from strandloom.scratch import Scratch
from strandloom.sources import sinks, tables
from strandloom.sources.records import read_names, read_records

Query = Callable[[SparkSession, str], DataFrame]
#: Reads that calibration_files may use: fewer than its files have in each of the tables given.
CALIBRATION = 700


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, sf_dir, fixtures.MIXED)


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.barcodes(spark, sf_dir)


def _text(spark: SparkSession, name: str, text: str) -> str:
    """The path of a folder with one file of so much text."""
    folder = Scratch(spark, "files").folder(name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(folder)
    return folder


def _write_parts(reads: DataFrame, folder: str, compression: str = "none") -> None:
    """Reads as FASTQ, each part a file of its own, in the order they come in."""
    reads.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value"), "part").write.partitionBy("part").option("compression", compression).text(folder)


def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped FASTQ of two folders, headers with a description, read as a list of paths."""
    scratch, reads = Scratch(spark, "files"), _mixed(spark, sf_dir).select("rid", F.concat("id", F.lit(" run=1 ch="), F.col("rid") % 7).alias("id"), "seq", "qual")
    folders = [scratch.folder(f"reads-{k}") for k in (0, 1)]
    for k, folder in enumerate(folders):
        sinks.write_reads(reads.where(F.col("rid") % 2 == k).drop("rid"), folder)
    return read_records(spark, folders, full_id=True).select("id", "full_id", "seq", "qual")


def fastq_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain FASTQ, which splits, found by its ending beside other files; names of old."""
    folder = Scratch(spark, "files").folder("reads")
    sinks.write_reads(_mixed(spark, sf_dir).select("id", "seq", "qual"), folder, compression="none")
    sinks.write_lines(_barcodes(spark, sf_dir), "true_barcode", f"{folder}/more", mode="overwrite")
    return read_records(spark, folder, glob="*.txt", legacy_names=True).select("id", "fastq_files", "qc")


def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA, once as the sink writes it and once with lines of 60 bases."""
    scratch, reads = Scratch(spark, "files"), _mixed(spark, sf_dir).select(F.concat(F.lit("r"), "rid").alias("id"), "seq")
    flat, wrapped = scratch.folder("flat"), scratch.folder("wrapped")
    sinks.write_reads(reads, flat, fmt="fasta")
    reads.select(F.concat(F.lit(">w"), "id", F.lit("\n"), F.regexp_replace("seq", "(.{60})", "$1\n")).alias("value")).write.text(wrapped)
    return read_records(spark, flat, "fasta").unionByName(read_records(spark, wrapped, "fasta")).select("id", "seq", F.col("qual").isNull().alias("bare"))


def record_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records 31 to 120 of each of eight plain files, which split."""
    folder = Scratch(spark, "files").folder("ordered")
    _write_parts(fixtures.parted(spark, sf_dir, fixtures.MIXED, 8), folder)
    return read_records(spark, folder, start=31, stop=120).select("id", "seq")


def whitelist_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whitelist half of bases and half of codes, imported, saved as codes, and those imported again."""
    scratch = Scratch(spark, "files")
    raw, saved = scratch.folder("raw"), scratch.folder("saved")
    code = S.encode("true_barcode")
    sinks.write_lines(_barcodes(spark, sf_dir).select(F.when(code % 2 == 0, F.col("true_barcode")).otherwise(code.cast("string")).alias("b")), "b", raw)
    first = tables.read_whitelist(spark, raw, save=saved).withColumn("source", F.lit("raw"))
    return first.unionByName(tables.read_whitelist(spark, saved).withColumn("source", F.lit("saved")))


def layout_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout of the five-prime kit from a file."""
    rows = "\n".join(f"{n},{s or ''},{k or ''},{t}" for n, s, k, t in layout.KITS["five"])
    return layout.as_frame(spark, layout.read_layout(spark, _text(spark, "layout", f"a title\nid,seq,expected_length,type\n{rows}")))


def plan_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan from files: its paths, the codes of its whitelist and its external barcodes, counted."""
    scratch = Scratch(spark, "files")
    listed, external = scratch.folder("whitelist"), scratch.folder("external")
    sinks.write_lines(_barcodes(spark, sf_dir), "true_barcode", listed)
    sinks.write_lines(_barcodes(spark, sf_dir), "true_barcode", external)
    rows = "\n".join(f"{n},{s or ''},{k or ''},{t}" for n, s, k, t in layout.KITS["three"])
    plan = layout.build_plan(spark, _text(spark, "layout", f"title\nid,seq,expected_length,type\n{rows}"), _text(spark, "paths", f"title\npath_type,actual_path\nfile,/in\noutput_dir,\nwhitelist,{listed}\nexternal_sr_bc,{external}"))
    counts = plan.whitelist.agg(F.count("*").alias("listed")).crossJoin(plan.external.agg(F.countDistinct("barcode").alias("external")))  # one row each
    return counts.select(F.lit(plan.paths["file"]).alias("file"), F.lit(plan.paths["output_dir"]).alias("output_dir"), F.lit(plan.barcode_length).alias("barcode_length"), F.lit(len(plan.layout)).alias("pieces"), "listed", "external")


def paf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAF lines of line items from files; tags as found, columns of numbers as numbers."""
    from strandloom.queries import _paf_line

    folder = Scratch(spark, "files").folder("paf")
    sinks.write_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(_paf_line().alias("value")), "value", folder)
    return tables.read_paf(spark, folder).select("id", "ql", "qs", "qr", "sn", "se", "mq", "NM", "ms", "tp")


def thresholds_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of quantities in lineitem's orders, written and read back."""
    from strandloom.queries import _quantities

    folder = f"{Scratch(spark, 'files').folder('thresholds')}/table"
    sinks.write_thresholds(calibrate.calibrate(_quantities(spark, sf_dir), ["q0", "q1"], ["q2", "q3"]), folder)
    return spark.read.option("header", True).csv(folder, schema="query_id string, null_distance double, sd_null double")


def calibration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by the first reads of the first of thirty files, fewer than there are."""
    folder = Scratch(spark, "files").folder("many")
    _write_parts(fixtures.parted(spark, sf_dir, fixtures.READS, 30), folder, "gzip")
    return demux.null_distances_of_files(spark, folder, layout.kit("three"), demux.Options(calibration_reads=CALIBRATION, calibration_files=20))


def _written(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, int]]:
    """The folder of a whole run over FASTQ files of the mixed reads, and its counts."""
    scratch = Scratch(spark, "files")
    source, out = scratch.folder("in"), scratch.folder("out")
    # made as they are written: the files are what is read
    sinks.write_reads(fixtures.made(spark, sf_dir, fixtures.MIXED).select("id", "seq", "qual"), source)
    plan = layout.kit("three", whitelist=_barcodes(spark, sf_dir).select(S.encode("true_barcode").alias("whitelist_bcs")), paths={"file": source, "output_dir": out})
    return out, demux.run(spark, plan)


def demux_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a run's stages, as it observed them."""
    return spark.createDataFrame(list(_written(spark, sf_dir)[1].items()), "counter string, n bigint")


def demux_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run from FASTQ to its output folder: lines of signatures and barcodes, and names of reads, with how often each is there."""
    out, _ = _written(spark, sf_dir)
    lines = [spark.read.text(f"{out}/{name}").select(F.lit(name).alias("output"), F.col("value").alias("line")) for name in ("sigsummary", "all_barcodes")]
    names = read_names(spark, f"{out}/filtered_reads").select(F.lit("filtered_reads").alias("output"), F.col("id").alias("line"))
    return lines[0].unionByName(lines[1]).unionByName(names).groupBy("output", "line").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (fastq_files, fastq_plain, fasta_files, record_range, whitelist_file, layout_file, plan_file, paf_file, thresholds_file, calibration_files, demux_files, demux_counters)}


def oracle_sql() -> dict[str, str]:
    from strandloom.alignment_sql import null_distance
    from strandloom.queries import _BARCODES, _Q, counters_sql, run_sql

    mixed, reads = fixtures.duck(fixtures.MIXED), fixtures.duck(fixtures.READS)
    return {
        "fastq_files": f"SELECT id, id || ' run=1 ch=' || (rid % 7) AS full_id, seq, qual FROM ({mixed})",
        "fastq_plain": f"SELECT id, seq AS fastq_files, qual AS qc FROM ({mixed})",
        "fasta_files": f"SELECT '>' || w || 'r' || rid AS id, seq, true AS bare FROM ({mixed}), (VALUES (''), ('w')) t(w)",
        "record_range": f"SELECT id, seq FROM ({mixed}) QUALIFY row_number() OVER (PARTITION BY rid % 8 ORDER BY rid) BETWEEN 31 AND 120",
        "whitelist_file": f"WITH {_BARCODES} SELECT whitelist_bcs, source FROM w, (VALUES ('raw'), ('saved')) t(source)",
        "layout_file": """SELECT * FROM (VALUES
            ('forw_primer', 'CTACACGACGCTCTTCCGATCT', 22, 'flanking_adapter', 1, 'forward'), ('barcode', NULL, 16, 'barcode', 2, 'forward'), ('umi', NULL, 10, 'umi', 3, 'forward'), ('tso', 'TTTCTTATATGGG', 13, 'adapter', 4, 'forward'),
            ('read', NULL, NULL, 'read', 5, 'forward'), ('rev_primer', 'GTACTCTGCGTTGATACCACTGCTT', 25, 'adapter', 6, 'forward'), ('rc_forw_primer', 'AGATCGGAAGAGCGTCGTGTAG', 22, 'flanking_adapter', 7, 'reverse'),
            ('rc_barcode', NULL, 16, 'barcode', 8, 'reverse'), ('rc_umi', NULL, 10, 'umi', 9, 'reverse'), ('rc_tso', 'CCCATATAAGAAA', 13, 'adapter', 10, 'reverse'), ('rc_read', NULL, NULL, 'read', 11, 'reverse'),
            ('rc_rev_primer', 'AAGCAGTGGTATCAACGCAGAGTAC', 25, 'adapter', 12, 'reverse')) t(id, seq, expected_length, type, "order", direction)""",
        "plan_file": f"SELECT '/in' AS file, CAST(NULL AS VARCHAR) AS output_dir, 16 AS barcode_length, 12 AS pieces, count(DISTINCT true_barcode) AS listed, count(DISTINCT true_barcode) AS external FROM ({reads})",
        "paf_file": """WITH l AS (SELECT l_orderkey || '_' || l_linenumber AS id, l_orderkey AS k, l_linenumber AS n FROM lineitem)
            SELECT id, 216.0::DOUBLE AS ql, n::DOUBLE AS qs, CASE WHEN n % 2 = 0 THEN '+' END AS qr, 'chr' || n AS sn, 205.0::DOUBLE AS se, k::DOUBLE AS mq, CASE k % 3 WHEN 0 THEN 'NM:i:3' WHEN 1 THEN 'NM:i:4' END AS "NM", CASE k % 3 WHEN 0 THEN 'ms:i:' || n WHEN 2 THEN 'ms:i:' || k END AS ms, CASE k % 3 WHEN 0 THEN 'tp:A:P' WHEN 1 THEN 'tp:A:S' END AS tp FROM l""",
        "thresholds_file": f"WITH {_Q} SELECT query_id, avg(d) AS null_distance, stddev_samp(d) AS sd_null FROM o GROUP BY query_id",
        "calibration_files": null_distance(f"SELECT * FROM ({reads}) WHERE rid % 30 < 20 ORDER BY rid % 30, rid LIMIT {CALIBRATION}"),
        "demux_files": run_sql(mixed),
        "demux_counters": counters_sql(mixed),
    }
