"""What a run writes: reads, thresholds, barcodes and signatures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.signature import render


def write_reads(df: DataFrame, path: str, fmt: str = "fastq", mode: str = "errorifexists", compression: str = "gzip") -> None:
    """Rows id, seq, qual as four-line FASTQ or as FASTA records, in a folder of files. mode append adds files.

    FASTA ids get a > unless some id has one.
    """
    if fmt == "fastq":
        out = df.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value"))
    else:
        marked = df.select(F.max(F.col("id").contains(">"))).first()[0]
        out = df.select(F.concat(F.lit("" if marked else ">"), F.col("id"), F.lit("\n"), F.col("seq")).alias("value"))
    # gzip at its fastest: bases hardly compress beyond that
    out.write.mode(mode).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(path)


def write_thresholds(null: DataFrame, path: str, mode: str = "overwrite") -> None:
    null.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_signatures(annotated: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A signature with its category for each annotated read, one a line."""
    write_lines(annotated.select(render("signature", "category").alias("line")), "line", path, mode)


def write_lines(df: DataFrame, column: str, path: str, mode: str = "append") -> None:
    """A text column, one value a line: barcodes, signatures."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)
