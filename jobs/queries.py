"""The jobs as registered queries: each runs twice into a new folder, which stays, and gives what is there then. And their SQL."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import config_of, demultiplex_reads, sort_texts
from strandloom import fixtures
from strandloom.operators.align import pieces_of
from strandloom.queries import demux_sql
from strandloom.scratch import shared_folder
from strandloom.sources import sinks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_demultiplex_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the reads that orders stand for."""
    folder, orders = _folder(spark, "job1"), f"{sf_dir}/orders.parquet"
    known = spark.sql(fixtures.READS.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(orders).select("o_orderkey", "o_custkey"))
    sinks.write_lines(known.select("true_barcode").distinct(), "true_barcode", f"{folder}/whitelist")
    config = config_of(demultiplex_reads.JOB) | {"format": "parquet", "spread_by": "o_orderkey", "reads_sql": f"SELECT id, seq, qual FROM ({fixtures.MIXED.replace('FROM orders', 'FROM {input}')})"}
    for _ in range(2):
        demultiplex_reads.run(spark, orders, f"{folder}/whitelist", f"{folder}/out", f"{folder}/checkpoint", config)
    return demultiplex_reads.read_cells(spark, f"{folder}/out")


def job2_sort_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the licence lines that they carry."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        sort_texts.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", config_of(sort_texts.JOB))
    places = F.transform("tags", lambda t: F.concat_ws(":", t["tag"], t["distance"], F.array_join(t["starts"], "+"), F.array_join(t["stops"], "+")))
    return sort_texts.read_sorted(spark, f"{folder}/out").withColumn("tags", F.array_join(places, "|"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_demultiplex_reads, job2_sort_texts)}


def _sorted_sql(tags: dict[str, str], most: int) -> str:
    """Around each exact occurrence of a part of a tag, one more part than letters may be wrong, all substrings within reach."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    parts = ", ".join(f"({text(n)}, {k}, {text(phrase)}, {at}, {text(piece)})" for k, (n, phrase) in enumerate(tags.items()) for at, piece in pieces_of(phrase, most))
    return f"""WITH g(tag, rank, phrase, off, piece) AS (VALUES {parts}), d AS (SELECT *, row_number() OVER () AS rid FROM documents),
p AS (SELECT rid, tag, rank, phrase, off, length(piece) AS n, text, string_split(text, piece) AS cut FROM d, g WHERE contains(text, piece)),
i AS (SELECT *, unnest(range(1, len(cut))) AS i FROM p),
w AS (SELECT DISTINCT rid, tag, rank, phrase, text, CAST(1 + list_sum(list_transform(cut[1:i], lambda x: length(x))) + (i - 1) * n - off AS INT) AS origin FROM i),
s AS (SELECT rid, tag, rank, origin + shift AS start, origin + shift + length(phrase) + more - 1 AS stop, levenshtein(phrase, substr(text, origin + shift, length(phrase) + more)) AS far
  FROM w, (SELECT unnest(range({-most}, {most + 1}))::INT AS shift), (SELECT unnest(range({-most}, {most + 1}))::INT AS more) WHERE origin + shift >= 1 AND origin + shift + length(phrase) + more - 1 <= length(text)),
b AS (SELECT * FROM s WHERE far <= {most} QUALIFY far = min(far) OVER (PARTITION BY rid, tag)),
e AS (SELECT rid, tag, rank, stop, any_value(far) AS far, min(start) AS start FROM b GROUP BY rid, tag, rank, stop),
t AS (SELECT rid, tag, rank, tag || ':' || any_value(far) || ':' || string_agg(start, '+' ORDER BY stop) || ':' || string_agg(stop, '+' ORDER BY stop) AS place FROM e GROUP BY rid, tag, rank),
l AS (SELECT rid, string_agg(place, '|' ORDER BY rank) AS tags, CASE WHEN count(*) = 1 THEN any_value(tag) ELSE 'several' END AS label FROM t GROUP BY rid)
SELECT d.* EXCLUDE (rid), coalesce(tags, '') AS tags, coalesce(label, 'none') AS label FROM d LEFT JOIN l USING (rid)"""


def oracle_sql() -> dict[str, str]:
    config = config_of(sort_texts.JOB)
    return {
        "job1_demultiplex_reads": demux_sql(fixtures.duck(fixtures.MIXED)).replace("SELECT barcode, count(*) AS reads", "SELECT substr(barcode, 1, 2) AS lead, barcode, count(*) AS reads"),
        "job2_sort_texts": _sorted_sql(config["tags"], config["most"]),
    }
