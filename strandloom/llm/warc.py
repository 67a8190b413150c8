"""WARC fixity: records and ordered offset ranges hashed into Merkle trees, audited from the roots down."""

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.rows import map_rows
from strandloom.llm.scratch import Scratch

#: Children of a node, levels above the records, and records of an archive on average. A node of the highest level stands
#: for 4096 records; should an archive have more, it has several such nodes, and its root is over all of them.
FANOUT, LEVELS, RECORDS = 16, 3, 512
DATE = "1970-01-01T00:00:00Z"


def record(id_column: str, url_column: str, html_column: str) -> F.Column:
    """A WARC/1.1 resource record, without the line break that ends it: text, whose UTF-8 bytes are the record."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    h = F.md5(F.concat_ws("\n", text(id_column), text(url_column)))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(text(url_column), r"[\r\n]", "%0A"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text(html_column)).cast("string"), F.lit("\r\n\r\n"), text(html_column), F.lit("\r\n"))


def archive_of(page_id: F.Column, archives: int) -> F.Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(page_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(archives))


def leaves(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, sha256 and bytes of each record, and copies: equal rows are one record, counted before they move.

    The hash is of the record with the line break that ends it. Null ids, URLs and pages are empty in records. Other
    columns aren't read; page contents don't leave the scan.
    """
    whole = F.concat(record(id_column, url_column, html_column), F.lit("\r\n"))
    found = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), whole.alias("record"))
    found = found.select("page_id", "url", F.sha2(F.col("record"), 256).alias("sha256"), F.octet_length("record").cast("long").alias("bytes"))
    return found.groupBy("page_id", "url", "sha256", "bytes").agg(F.count("*").alias("copies"))


def placed(found: DataFrame, archives: int) -> DataFrame:
    """leaves() with archive, ordinal, and the offsets from which to which a record lies there: by id, URL and hash, null first.

    Records are dealt by ranges of that order, so an archive with many records, as of null or equal ids, is many tasks'.
    """
    spark = found.sparkSession
    key = ["page_id", "url", "sha256"]
    dealt = found.withColumn("archive", archive_of(F.col("page_id"), archives))
    dealt = dealt.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive", *key).withColumn("part", F.spark_partition_id())
    dealt = Scratch(spark, "placed").keep(dealt, "dealt")
    before = Window.partitionBy("archive").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("archive", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    base = sums.select("archive", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "size")])
    order = Window.partitionBy("archive", "part").orderBy(*key)
    out = dealt.join(base, ["archive", "part"]).withColumn("ordinal", (F.col("n_before") + F.row_number().over(order) - 1).cast("long"))
    out = out.withColumn("stop", F.col("size_before") + F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*found.columns, "archive", "ordinal", "stop", (F.col("stop") - F.col("bytes")).alias("start"))


def tree(records: DataFrame) -> DataFrame:
    """Nodes of placed(): archive, level, index, start, stop, hash, counts. Level 0 are records, the last level is an archive's root.

    A node's hash is the SHA-256 of its range and of its children's hashes in their order. counts is a tree of its own
    beside that, over how many copies of each record there are. A group has 16 children at most; a root has one for 4096
    records of its archive.
    """
    level = records.select("archive", F.lit(0).alias("level"), F.col("ordinal").alias("index"), "start", "stop", F.col("sha256").alias("hash"), F.col("copies").cast("string").alias("counts"))
    nodes = level
    for k in range(1, LEVELS + 2):
        parent = F.floor(F.col("index") / FANOUT).cast("long") if k <= LEVELS else F.lit(0).cast("long")
        level = level.groupBy("archive", parent.alias("parent")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("index", "hash", "counts"))).alias("c"))
        joined = lambda c: F.array_join(F.transform("c", lambda x: x[c]), ":")
        level = level.select("archive", F.lit(k).alias("level"), F.col("parent").alias("index"), "start", "stop", F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("stop").cast("string"), joined("hash")), 256).alias("hash"), F.sha2(joined("counts"), 256).alias("counts"))
        nodes = nodes.unionByName(level)
    return nodes


def differing(left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """(archive, ordinal, left_hash, right_hash, start, stop) of the records in which two trees differ.

    Roots are compared first; below, only children of nodes that differ, or that one side lacks, are. Each step's
    differing nodes are written, so trees are read level by level and no step sees more than it must.
    """
    differ = None
    for k in range(LEVELS + 1, -1, -1):
        parent = F.floor(F.col("index") / FANOUT).cast("long") if k < LEVELS else F.lit(0).cast("long")
        sides = []
        for name, nodes in (("left", left), ("right", right)):
            side = nodes.where(F.col("level") == k)
            if differ is not None:
                above = differ.select(F.col("archive").alias("a"), F.col("index").alias("p"))
                side = side.join(above, (F.col("archive") == F.col("a")) & (parent == F.col("p")), "left_semi")
            sides.append(side.select("archive", "index", *[F.col(c).alias(f"{name}_{c}") for c in ("hash", "counts", "start", "stop")]))
        both = sides[0].join(sides[1], ["archive", "index"], "full").where(~(F.col("left_hash").eqNullSafe(F.col("right_hash")) & F.col("left_counts").eqNullSafe(F.col("right_counts"))))
        differ = scratch.keep(both, f"level-{k}")
    return differ.select("archive", F.col("index").alias("ordinal"), "left_hash", "right_hash", F.coalesce("left_start", "right_start").alias("start"), F.coalesce("left_stop", "right_stop").alias("stop"))


def audit(left: DataFrame, right: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row a record of left: page_id, url, archive, ordinal, start, stop, sha256, copies, root (its archive's), corrupt.

    corrupt tells if the audit of right, a replica, ends at that record, and the record isn't there: its bytes or its copies
    differ, or it is missing. Records that only lie elsewhere, as others before them are lost or longer, are not corrupt.
    Records that only right has don't show. Two empty tables give no rows.
    """
    scratch = Scratch(left.sparkSession, "warc")
    first = scratch.keep(leaves(left, id_column, url_column, html_column), "left")
    second = scratch.keep(leaves(right, id_column, url_column, html_column), "right")
    archives = max(1, -(-first.count() // RECORDS))
    records = scratch.keep(placed(first, archives), "records")
    others = scratch.keep(placed(second, archives), "right-records")
    ours, theirs = scratch.keep(tree(records), "left-tree"), scratch.keep(tree(others), "right-tree")
    places = differing(ours, theirs, scratch).select(F.col("archive").alias("a"), F.col("ordinal").alias("o"))
    at = (F.col("archive") == F.col("a")) & (F.col("ordinal") == F.col("o"))
    there = others.join(places, at, "left_semi").select(*[F.col(c).alias(f"r_{c}") for c in ("archive", "page_id", "url", "sha256", "copies")])
    same = (F.col("archive") == F.col("r_archive")) & (F.col("sha256") == F.col("r_sha256")) & (F.col("copies") == F.col("r_copies"))
    same = same & F.col("page_id").eqNullSafe(F.col("r_page_id")) & F.col("url").eqNullSafe(F.col("r_url"))
    found = records.join(places, at, "left_semi").join(there, same, "left_anti").select(F.col("archive").alias("a"), F.col("ordinal").alias("o"), F.lit(True).alias("found"))
    found = scratch.keep(found, "found")
    scratch.only("records", "left-tree", "found")
    roots = ours.where(F.col("level") == LEVELS + 1).select(F.col("archive").alias("root_of"), F.col("hash").alias("root"))
    out = records.join(found, at, "left").join(roots, F.col("archive") == F.col("root_of"))
    return out.select("page_id", "url", "archive", "ordinal", "start", "stop", "sha256", "copies", "root", F.coalesce("found", F.lit(False)).alias("corrupt"))


def damaged(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """A replica with faults: in pages whose id's MD5 starts with 0a, the first byte, if ASCII, is another. For drills of audits."""
    hit = (F.substring(F.md5(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit(""))), 1, 2) == "0a") & F.col(f"`{html_column}`").rlike(r"^[\x00-\x7F]")
    other = F.when(F.substring(F.col(f"`{html_column}`"), 1, 1) == "#", "!").otherwise("#")
    return pages.withColumn(html_column, F.when(hit, F.concat(other, F.expr(f"substring(`{html_column}`, 2)"))).otherwise(F.col(f"`{html_column}`")))


def write_archives(pages: DataFrame, folder: str, archives: int, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> None:
    """The records as WARC files, one a folder archive=K, in the order of their offsets.

    Null ids, URLs and pages are empty in records, equal rows are one record, an empty table gives no files. An archive is
    written by one task.
    """
    body = record(id_column, url_column, html_column)
    found = pages.select(archive_of(F.col(f"`{id_column}`"), archives).alias("archive"), F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), body.alias("value"))
    found = found.withColumn("sha256", F.sha2(F.concat("value", F.lit("\r\n")), 256)).dropDuplicates(["page_id", "url", "sha256"])
    found = found.repartition("archive").sortWithinPartitions("archive", "page_id", "url", "sha256")
    found.select("archive", "value").write.partitionBy("archive").option("lineSep", "\r\n").text(folder)


def inflated(data: bytes) -> tuple[bytes, bytes]:
    """Gzipped data, of any number of members, as plain data; and what can't be read of it, with the rest from there on."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            part = member.decompress(data)
        except zlib.error:
            return b"".join(out), data
        if not member.eof:
            return b"".join(out), data
        out.append(part)
        data = member.unused_data
    return b"".join(out), b""


def records_of(data: bytes) -> Iterator[tuple[int, int, str | None, str | None, bytes]]:
    """(start, stop, type, url, payload) of the records of a WARC file's bytes. What is no whole record has type broken, up to
    where the next one seems to start, its bytes being the payload."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        fields, stop = {}, -1
        if head >= 0 and data.startswith(b"WARC/", at):
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:head].decode(errors="replace").split("\r\n")[1:])}
            if fields.get("content-length", "").isdecimal():
                stop = head + 4 + int(fields["content-length"]) + 4
        if stop >= 0 and data[stop - 4 : stop] == b"\r\n\r\n":
            yield at, stop, fields.get("warc-type"), fields.get("warc-target-uri"), data[head + 4 : stop - 4]
        else:
            following = data.find(b"\r\n\r\nWARC/", at + 1)
            stop = len(data) if following < 0 else following + 4
            yield at, stop, "broken", None, data[at:stop]
        at = stop


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, stop, type, url, payload) of the records of WARC files, plain or gzipped.

    Offsets are those of plain data. A truncated or malformed stretch is one row of type broken with its bytes, after which
    reading goes on; so is what can't be unzipped. Types and URLs that a record lacks are null; an empty file gives no rows.
    A file is read whole by one task, so archives are best kept to some hundred MB, as is usual.
    """

    def begin() -> Callable[..., Iterator[tuple]]:
        def f(file: str, content: bytes) -> Iterator[tuple]:
            data, rest = inflated(content) if content.startswith(b"\x1f\x8b") else (content, b"")
            for found in records_of(data):
                yield file, *found
            if rest:
                yield file, len(data), len(data) + len(rest), "broken", None, rest

        return f

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{part-*,*.warc,*.warc.gz}").load(path)
    return map_rows(files, ["path", "content"], "file string, start bigint, stop bigint, type string, url string, payload binary", begin)
