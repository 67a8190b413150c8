"""Arrow plumbing of the operators that scan texts in Python."""

import ctypes
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Words of every contract: runs of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python, and of the rows that a task holds before it gives them back.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Seconds for which a worker without a task keeps what tasks share.
IDLE = 5.0


def bound_batches(spark: SparkSession) -> None:
    """Sets Spark's bound of an Arrow batch to BATCH_BYTES in the session, if it is Spark's default of 64 MB."""
    if spark.conf.get(_BATCH_SETTING) in ("64MB", f"{64 << 20}b", str(64 << 20)):
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def release() -> None:
    """Gives memory that a worker doesn't use back to the machine: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives memory back when a task is through."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return outer


class Shared:
    """Something that a worker's tasks share, made when first used and dropped when no task has used it for a while."""

    def __init__(self) -> None:
        self.lock, self.key, self.value, self.users, self.turn = threading.Lock(), None, None, 0, 0

    def take(self, key: object, make: Callable[[], object]) -> object:
        with self.lock:
            self.users, self.turn = self.users + 1, self.turn + 1
            if self.key != key:
                self.key, self.value = key, make()
            return self.value

    def leave(self) -> None:
        with self.lock:
            self.users -= 1
            timer = threading.Timer(IDLE, self._drop, (self.turn,))
        timer.daemon = True
        timer.start()

    def _drop(self, turn: int) -> None:
        with self.lock:
            if self.users == 0 and self.turn == turn:
                self.key = self.value = None
        release()


def map_rows(df: DataFrame, columns: list[str], schema: str | StructType, start: Callable[[], Callable[..., Iterator[tuple]]], end: Callable[[], None] | None = None) -> DataFrame:
    """For each row, the rows that a function of the values of columns yields. start() makes that function, once in a task.

    Only the columns named are read. Rows stream through in Arrow batches of 8 MB in, unless the session sets another size
    than Spark's default, and of 4096 rows or some MB out: so memory holds little whatever the table's size, and a row that
    is larger by itself. end() is called when a task is through.
    """
    bound_batches(df.sparkSession)
    shape = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, into = start(), to_arrow_schema(shape)
        try:
            for batch in batches:
                out: list[tuple] = []
                held = 0
                # a few rows at a time become Python's, so that a batch of long texts isn't there twice
                for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                    for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        out.extend(f(*row))
                    held += part.nbytes
                    if out and (len(out) >= 4096 or held >= BATCH_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), into, strict=True)], schema=into)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), into, strict=True)], schema=into)
        finally:
            if end:
                end()
            del f
            release()

    return df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, shape)
