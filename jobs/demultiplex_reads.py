"""Reads of a growing folder, or table, to counts of each cell: each file is aligned once, when it is new.

    python -m jobs.demultiplex_reads --input reads/ --whitelist barcodes.txt --output out/ --checkpoint state/

The stream's checkpoint knows the files that are done. Thresholds are measured in the first run and kept, as later files
must be held against the same ones. The output has

- misalignment_distances: the thresholds
- sigsummary/batch=n, cut/batch=n: what each batch of files was annotated as, and what was cut out of it
- all_barcodes, filtered_reads: after correction of all that is cut so far
- cells/lead=..: reads and tags of each barcode, by its first two bases

The last two are written anew in each run, since barcodes that come later can decide ties of earlier ones; that reads cut
reads again, and aligns nothing. A run that broke off is made good by the next.
"""

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import command
from strandloom.operators import calibrate
from strandloom.plans import demux, layout
from strandloom.sources import sinks, tables
from strandloom.sources.records import read_records
from strandloom.streaming import demux as stream

JOB = "demultiplex_reads"
log = logging.getLogger(f"jobs.{JOB}")


def run(spark: SparkSession, input: str, whitelist: str, output: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Demultiplexes the files of the input that are new, and counts the cells of all so far."""
    options = demux.Options(least_read=config["least_read"], calibration_reads=config["calibration_reads"], calibration_files=config["calibration_files"])
    plan = layout.kit(config["kit"], whitelist=tables.read_whitelist(spark, whitelist))

    def reads_of(rows: DataFrame) -> DataFrame:
        if config["spread_by"]:
            # a small file whose rows stand for long reads is many tasks'
            rows = rows.repartition(spark.sparkContext.defaultParallelism, config["spread_by"])
        return rows.sparkSession.sql(config["reads_sql"], input=rows)

    null = _thresholds(spark, input, output, plan, options, config, reads_of)
    batches: list[dict] = []

    def told(counts: dict) -> None:
        batches.append(counts)
        log.info("batch %s of %s: %s", counts["batch"], input, {k: v for k, v in counts.items() if k != "batch"})

    if config["format"] == "fastq":
        query = stream.start(spark, plan, null, input, output, checkpoint, options, config["files_per_batch"], told=told)
    else:
        table = spark.read.format(config["format"]).load(input)
        rows = spark.readStream.format(config["format"]).schema(table.schema).option("maxFilesPerTrigger", config["files_per_batch"]).load(_streamed(input, table))
        query = stream.over(rows, reads_of, plan, null, output, checkpoint, options, told)
    query.awaitTermination()
    counts = {"batches": len(batches), "new_reads": sum(b["reads"] for b in batches), **stream.settled(spark, plan, output, options)}
    counts["cells"] = _write_cells(spark, output)
    log.info("%s: %s new batches with %s reads; %s reads cut so far, %s on the list, %s cells in %s/cells", input, counts["batches"], counts["new_reads"], counts["cut"], counts["kept"], counts["cells"], output)
    return counts


def _streamed(input: str, table: DataFrame) -> str:
    """The path for a stream, which takes a folder or a pattern: a single file is a pattern that fits it alone."""
    name = input.rstrip("/")
    return f"{name[:-1]}[{name[-1]}]" if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == [name.rsplit("/", 1)[-1]] else input


def _thresholds(spark: SparkSession, input: str, output: str, plan: layout.DemuxPlan, options: demux.Options, config: dict, reads_of) -> dict:
    """Those that an earlier run kept; else measured on the input, and kept."""
    folder = f"{output}/misalignment_distances"
    kept = lambda: spark.read.option("header", True).csv(folder, schema="query_id string, null_distance double, sd_null double")
    try:
        found = calibrate.collected(kept())
        if found:
            log.info("thresholds of %s adapters from %s", len(found), folder)
            return found
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if config["format"] == "fastq":
        measured = demux.null_distances_of_files(spark, input, plan, options)
    else:
        measured = demux.null_distances(reads_of(spark.read.format(config["format"]).load(input)), plan, options)
    sinks.write_thresholds(measured, folder)
    found = calibrate.collected(kept())
    log.info("thresholds of %s adapters measured on %s, written to %s", len(found), input, folder)
    return found


def _write_cells(spark: SparkSession, output: str) -> int:
    named = read_records(spark, f"{output}/filtered_reads").select(F.split("id", "_").alias("p"))
    cells = demux.cell_counts(named.select(F.element_at("p", -1).alias("barcode"), F.element_at("p", -2).alias("umi")))
    cells.withColumn("lead", F.substring("barcode", 1, 2)).write.mode("overwrite").partitionBy("lead").parquet(f"{output}/cells")
    return read_cells(spark, output).count()


def read_cells(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("barcode string, reads bigint, umis bigint, lead string").parquet(f"{output}/cells")


if __name__ == "__main__":
    command(JOB, ["input", "whitelist", "output", "checkpoint"], run)
