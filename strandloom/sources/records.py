"""FASTQ and FASTA files as DataFrames, read as lines by Spark from any store and framed into records.

A compressed file is one task's, and is read once. Plain files split: a split frames the records that lie in it whole, and
the pieces at its ends, which are few, meet their other halves. Those pieces come from a second framing of the same files.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from strandloom.scratch import Scratch

_FRAME = "file string, block bigint, n bigint, kind int, header string, seq string, qual string, lines array<string>"
#: Kinds of framed rows: a record, lines that go on with what an earlier split began, lines after a split's last record.
RECORD, HEAD, TAIL = 0, 1, 2
#: Lines that a split's phase is told from.
LOOK = 64
#: Endings of files that are one split each, whatever their size.
WHOLE = (".gz", ".deflate", ".snappy", ".lz4", ".zst")


def lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """value, file and block (where the line's split starts) of all lines."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _fits(buffer: list[str], at: int) -> bool:
    """Whether records of four lines may start at a line: headers with @, separators with +, qualities as long as sequences.

    A quality line may start with @ too, so the lengths decide.
    """
    for k in range(at, len(buffer), 4):
        part = buffer[k : k + 4]
        if not part[0].startswith("@") or len(part) > 2 and not part[2].startswith("+") or len(part) == 4 and len(part[1]) != len(part[3]):
            return False
    return True


def _fastq(rows: Iterator[str], first: bool) -> Iterator[tuple]:
    buffer: list[str] = []
    for value in rows:
        buffer.append(value)
        if len(buffer) >= LOOK:
            break
    at = 0 if first else next((k for k in range(4) if _fits(buffer, k)), len(buffer))
    if at:
        yield HEAD, None, None, None, buffer[:at]
    part: list[str] = []
    sure = first

    def chained() -> Iterator[str]:
        yield from buffer[at:]
        yield from rows

    for value in chained():
        if value or part:
            part.append(value)
        if len(part) == 4:
            yield RECORD, part[0], part[1], part[3], None
            part, sure = [], True
    if part:
        # in a split without a whole record, lines that look like a record's start may be qualities
        yield TAIL if sure else HEAD, None, None, None, part


def _fasta(rows: Iterator[str], first: bool) -> Iterator[tuple]:
    header, parts, head = None, [], []
    for value in rows:
        if value.startswith(">"):
            if header is not None:
                yield RECORD, header, "".join(parts), None, None
            header, parts = value, []
        elif header is None:
            head.append(value)
        else:
            parts.append(value)
    if head:
        yield HEAD, None, None, None, head
    if header is not None:
        # the next split may go on with this record
        yield TAIL, None, None, None, [header, *parts]


def _framed(source: DataFrame, frame: Callable[[Iterator[str], bool], Iterator[tuple]], most: int | None = None) -> DataFrame:
    """Framed rows of lines(); of each split the first most, after which its lines go by unframed."""
    shape = _parse_datatype_string(_FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)

        def rows() -> Iterator[tuple[str, str, int]]:
            for b in batches:
                yield from zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(0).to_pylist(), strict=True)

        source_rows, ahead = rows(), []

        def of(file: str, block: int) -> Iterator[str]:
            while True:
                row = ahead.pop() if ahead else next(source_rows, None)
                if row is None:
                    return
                if row[:2] != (file, block):
                    ahead.append(row)
                    return
                yield row[2]

        out: list[tuple] = []
        while True:
            row = ahead.pop() if ahead else next(source_rows, None)
            if row is None:
                break
            file, block = row[:2]
            ahead.append(row)
            split = of(file, block)
            for n, found in enumerate(frame(split, block == 0)):
                if n == most:
                    # the rest of the split goes by unframed
                    for _ in split:
                        pass
                    break
                out.append((file, block, n, *found))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), into, strict=True)], schema=into)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), into, strict=True)], schema=into)

    return source.select("value", "file", "block").mapInArrow(run, shape)


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """FASTQ records of files that don't split, of lines and what tells their files apart (a number): their headers, sequences and qualities.

    Each comes with a batch whose first row is of its file. Lines are taken four at a time; where an empty line stands at a
    record's start, which is left out, they go one at a time. What a file ends with that is no whole record is left out.
    """
    of, left = None, pa.array([], pa.string())
    for b in batches:
        numbers = b.column(1).to_numpy()
        first = np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1))
        for at, stop in zip(first, np.append(first[1:], len(numbers)), strict=True):
            if numbers[at] != of:
                of, left = numbers[at], left[:0]
            values = b.column(0)[at:stop]
            values = pa.concat_arrays([left, values]) if len(left) else values
            whole = len(values) // 4 * 4
            if pc.min(pc.binary_length(values[::4])).as_py() == 0:
                lines, part = [], []
                for value in values.to_pylist():
                    if value or part:
                        part.append(value)
                    if len(part) == 4:
                        lines += part
                        part = []
                values, whole = pa.array(lines + part, pa.string()), len(lines)
            left = values[whole:]
            if whole:
                yield b.slice(at, 1), [values.take(pa.array(np.arange(k, whole, 4))) for k in (0, 1, 3)]


def header_names(headers: pa.Array) -> pa.Array:
    """FASTQ headers up to their first space."""
    return pc.replace_substring_regex(headers, " .*", "", max_replacements=1) if pc.any(pc.match_substring(headers, " ")).as_py() else headers


def marked(source: DataFrame) -> DataFrame:
    """lines() as whole_records() takes them: value, a number for the file, and file."""
    return source.select("value", F.xxhash64("file").alias("of"), "file")


def _whole_fastq(source: DataFrame) -> DataFrame:
    """file, block, n, header, seq, qual of FASTQ files that don't split."""
    shape = _parse_datatype_string("file string, block bigint, n bigint, header string, seq string, qual string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        file, n = None, 0
        for b, found in whole_records(batches):
            name = b.column(2)[0]
            file, n = name, n if name == file else 0
            size = len(found[0])
            names = pa.DictionaryArray.from_arrays(np.zeros(size, np.int32), [name.as_py()]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(size, np.int64)), pa.array(np.arange(n, n + size)), *found], schema=into)
            n += size

    return marked(source).mapInArrow(run, shape)


def _rejoined(groups: DataFrame) -> DataFrame:
    """Records of four lines out of groups of split ends; each is numbered as the end in which it starts."""
    shape = _parse_datatype_string("file string, block bigint, n bigint, header string, seq string, qual string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = to_arrow_schema(shape)
        for b in batches:
            out: list[tuple] = []
            for file, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part: list[str] = []
                for end in parts:
                    for value in end["lines"]:
                        if not part:
                            at = end["block"], end["n"]
                        if value or part:
                            part.append(value)
                        if len(part) == 4:
                            out.append((file, *at, part[0], part[1], part[3]))
                            part = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), into, strict=True)], schema=into)

    return groups.select("file", "parts").mapInArrow(run, shape)


_FRAMES = {"fastq": _fastq, "fasta": _fasta}
_COLUMNS = ["file", "block", "n", "header", "seq", "qual"]


def _last(framed: DataFrame) -> DataFrame:
    """FASTA records that end with their file, whose lines are a tail without a head after it."""
    lines = F.col("lines")
    return framed.where(F.col("kind").isin(RECORD, TAIL)).select("file", "block", "n", F.coalesce("header", F.element_at(lines, 1)).alias("header"), F.coalesce("seq", F.array_join(F.slice(lines, 2, F.size(lines)), "")).alias("seq"), "qual")


def frame(source: DataFrame, fmt: str, whole_files: bool = False) -> DataFrame:
    """file, block, n (order in the block), header, seq, qual of the records of lines(). whole_files: no file has two splits."""
    if whole_files and fmt == "fastq":
        return _whole_fastq(source)
    framed = _framed(source, _FRAMES[fmt])
    columns = _COLUMNS
    if whole_files:
        return _last(framed)
    whole = framed.where(F.col("kind") == RECORD).select(*columns)
    # ends of splits: a tail and the heads up to the next tail make a record, however many splits it spans
    ends = framed.where(F.col("kind") != RECORD)
    order = Window.partitionBy("file").orderBy("block", "n")
    ends = ends.withColumn("tails", F.sum((F.col("kind") == TAIL).cast("long")).over(order))
    groups = ends.groupBy("file", "tails").agg(F.sort_array(F.collect_list(F.struct("block", "n", "lines"))).alias("parts"))
    if fmt == "fastq":
        stitched = _rejoined(groups)
    else:
        both = groups.where("tails > 0").select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["n"].alias("n"), F.flatten("parts.lines").alias("all"))
        stitched = both.select("file", "block", "n", F.element_at("all", 1).alias("header"), F.array_join(F.slice("all", 2, F.size("all")), "").alias("seq"), F.lit(None).cast("string").alias("qual"))
    return whole.unionByName(stitched)


def read_records(spark: SparkSession, path: str | list[str], fmt: str = "fastq", full_id: bool = False, glob: str | None = None, start: int | None = None, stop: int | None = None, legacy_names: bool = False) -> DataFrame:
    """id, seq, qual (null for FASTA) and file of all records.

    FASTQ ids end at the first space and keep their @; full_id adds the whole header. FASTA ids are whole headers with >.
    start and stop pick records by number in their file, from 1, both inclusive. legacy_names: sequences are fastq_files,
    qualities qc. Empty files give no rows. Where all files are compressed, and so in one split each, they are read once.
    """
    source = lines(spark, path, glob)
    out = frame(source, fmt, all(f.endswith(WHOLE) for f in source.inputFiles()))
    if start is not None or stop is not None:
        out = _numbered(out, start or 1, stop)
    return _named(out, fmt, full_id, legacy_names)


def read_names(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """id of all FASTQ records, as read_records() has it. Where all files are compressed, nothing else leaves the tasks' Python."""
    source = lines(spark, path, glob)
    if not all(f.endswith(WHOLE) for f in source.inputFiles()):
        return read_records(spark, path, glob=glob).select("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (header, _, _) in whole_records(batches):
            yield pa.RecordBatch.from_arrays([header], names=["header"])

    return marked(source).select("value", "of").mapInArrow(run, "header string").select(F.substring_index("header", " ", 1).alias("id"))


def _numbered(records: DataFrame, start: int, stop: int | None) -> DataFrame:
    """The records of a file from one number to another: splits are counted, and records of those in the range numbered, a split a task."""
    counts = records.groupBy("file", "block").agg(F.count("*").alias("records"))
    # a file's splits, a row each
    before = F.coalesce(F.sum("records").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where(F.col("before") + F.col("records") >= start)
    if stop is not None:
        counts = counts.where(F.col("before") < stop)
    counts = counts.select(F.col("file").alias("of"), F.col("block").alias("at"), "before")
    # a row a split: records of other splits don't move
    near = records.join(F.broadcast(counts), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    if stop is not None:
        # n framed rows of its split come before a record, all but one of them records: later ones needn't be sorted
        near = near.where(F.col("n") <= stop - F.col("before"))
    near = near.withColumn("number", F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("n"))).where(F.col("number") >= start)
    return near if stop is None else near.where(F.col("number") <= stop)


def first_records(spark: SparkSession, path: str | list[str], reads: int, files: int = 20, fmt: str = "fastq", glob: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """As read_records(), the first so many records of the first so many files by name; all if there are no more.

    Other files aren't opened. Of each split as many records as asked for are framed and written, then those that come
    first are told by counts of splits, a row each.
    """
    found = sorted(lines(spark, path, glob).inputFiles())[:files]
    if not found:
        return read_records(spark, path, fmt, glob=glob)
    scratch = scratch or Scratch(spark, "sampled")
    source = lines(spark, found)
    if all(f.endswith(WHOLE) for f in found):
        out = _first_whole(spark, found, reads, fmt, scratch)
    else:
        out = scratch.keep(frame(source, fmt), "sampled")
    counts = out.groupBy("file", "block").agg(F.count("*").alias("records")).orderBy("file", "block")
    before = F.coalesce(F.sum("records").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).where(F.col("before") < reads).select(F.col("file").alias("of"), F.col("block").alias("at"), (reads - F.col("before")).alias("room"))
    # splits of files whose number is bounded
    near = out.join(F.broadcast(counts), (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("n"))
    return _named(near.withColumn("rank", rank).where("rank <= room"), fmt, False, False)


def _first_whole(spark: SparkSession, files: list[str], reads: int, fmt: str, scratch: Scratch) -> DataFrame:
    """Records of the first files that don't split, in order: more files are opened as long as there are too few.

    Of FASTQ as many lines are read as records take. Where empty lines between them made those too few, the file is read on.
    """
    parts, left, at, step = [], reads, 0, 1
    while at < len(files) and left > 0:
        some, name, seen = files[at : at + step], f"sampled-{at}", None
        source = lines(spark, some)
        if fmt == "fastq" and len(some) == 1:
            seen = Observation()
            source = source.limit(4 * left).observe(seen, F.count("*").alias("lines"))
        of = lambda d: _last(_framed(d, _fasta, left)) if fmt == "fasta" else _whole_fastq(d).where(F.col("n") < left)  # noqa: B023, E731
        out = scratch.keep(of(source), name)
        count = out.count()
        if seen is not None and count < left and seen.get.get("lines") == 4 * left:
            out = scratch.keep(of(lines(spark, some)), f"{name}-whole")
            count = out.count()
        parts.append(out)
        left, at, step = left - count, at + step, 2 * step
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(out: DataFrame, fmt: str, full_id: bool, legacy_names: bool) -> DataFrame:
    name = F.substring_index("header", " ", 1) if fmt == "fastq" else F.col("header")
    seq, qual = ("fastq_files", "qc") if legacy_names else ("seq", "qual")
    return out.select(name.alias("id"), F.col("seq").alias(seq), F.col("qual").alias(qual), *([F.col("header").alias("full_id")] if full_id else []), "file")
