"""Texts sorted by the known lines that they carry, found as adapters are in reads: anywhere, with a few wrong letters.

    python -m jobs.sort_texts --input documents.parquet --output sorted/

The output has all rows of the input, with tags (what was found: distance, starts and stops of its places) and in folders by
label: a tag, several, or none. A rerun writes over it.
"""

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import command
from strandloom.operators.align import find_tags

JOB = "sort_texts"
log = logging.getLogger(f"jobs.{JOB}")


def run(spark: SparkSession, input: str, output: str, config: dict) -> dict[str, int]:
    """Finds the tags in the input's texts, and writes the rows by label."""
    rows = spark.read.format(config["format"]).load(input)
    found = find_tags(rows, config["text_column"], config["tags"], config["most"])
    label = F.when(F.size("tags") == 0, "none").when(F.size("tags") == 1, F.col("tags")[0]["tag"]).otherwise("several")
    log.info("%s: looking for %s tags with up to %s wrong letters", input, len(config["tags"]), config["most"])
    found.withColumn("label", label).write.mode("overwrite").partitionBy("label").parquet(output)
    written = spark.read.parquet(output) if rows.head(1) else rows.withColumn("label", F.lit(""))
    counts = {r["label"]: r["count"] for r in written.groupBy("label").count().collect()}
    log.info("%s: %s texts written to %s: %s", input, sum(counts.values()), output, counts)
    return counts


def read_sorted(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output)


if __name__ == "__main__":
    command(JOB, ["input", "output"], run)
