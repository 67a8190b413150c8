"""Demultiplexing files as they arrive: a folder of FASTQ files, or a table of reads, as a stream with fixed thresholds."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators import extract
from strandloom.plans.demux import Options, settle, write_annotated
from strandloom.plans.layout import DemuxPlan
from strandloom.scratch import Scratch
from strandloom.sources import sinks
from strandloom.sources.records import frame


def start(spark: SparkSession, plan: DemuxPlan, null: dict, source: str, out: str, checkpoint: str, options: Options = Options(), files: int = 50, glob: str | None = None, told: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Aligns and cuts all files there are, so many a batch, and stops; a later start goes on with new files.

    Each batch writes sigsummary/batch=n and cut/batch=n. A batch that is run again writes over what it left, so each
    file's reads are there once. settled() then corrects all that is cut. told gets a batch's counts.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(source).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return over(lines, lambda df: frame(df, "fastq").select(F.substring_index("header", " ", 1).alias("id"), "seq", "qual"), plan, null, out, checkpoint, options, told)


def over(rows: DataFrame, reads_of: Callable[[DataFrame], DataFrame], plan: DemuxPlan, null: dict, out: str, checkpoint: str, options: Options = Options(), told: Callable[[dict], None] | None = None) -> StreamingQuery:
    """start() over any stream: reads_of makes id, seq, qual of a batch's rows."""

    def batch(df: DataFrame, epoch: int) -> None:
        scratch = Scratch(df.sparkSession, "batch")
        found, counts = write_annotated(reads_of(df), plan, null, options, scratch)
        sinks.write_signatures(found, f"{out}/sigsummary/batch={epoch}")
        extract.extract(found, plan.exact_coords).write.mode("overwrite").parquet(f"{out}/cut/batch={epoch}")
        scratch.close()
        if told:
            told({"batch": epoch, **counts})

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(spark: SparkSession, plan: DemuxPlan, out: str, options: Options = Options()) -> dict[str, int]:
    """all_barcodes and filtered_reads of all batches so far, and their counts: what one run over all files leaves, however they came.

    Frequencies count all batches, so a later one may change what an earlier one's barcodes become; only cut reads are read
    again for that, nothing is aligned.
    """
    return settle(spark.read.parquet(f"{out}/cut").drop("batch"), plan, out, options)
