"""Intermediate tables in the folder that the cluster shares, written once so that lineage ends there."""

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local: list[str] = []
#: What is left to delete when the driver ends: paths, and how their file system is reached.
_left: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="strandloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def _delete(path: object, conf: object) -> None:
    path.getFileSystem(conf).delete(path, True)


@atexit.register
def clean() -> None:
    """Deletes all tables that operators wrote and that results may still be read from. Runs when the driver ends, too."""
    for path, conf in _left.values():
        try:
            _delete(path, conf)
        except (Py4JError, OSError):  # the JVM is gone
            pass
    _left.clear()


class Scratch:
    """Tables of one run. keep() writes one and reads it back; drop() and only() remove what is no longer read.

    What a result is read from stays until the driver ends, or clean() is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/strandloom-{name}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        self.conf = spark._jsc.hadoopConfiguration()

    def folder(self, name: str) -> str:
        """The path of a folder that other writers fill."""
        _left.setdefault(self.base, (self._path(""), self.conf))
        self.names.append(name)
        return f"{self.base}/{name}"

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.folder(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def gone(self) -> bool:
        """Whether clean() has deleted its tables."""
        return self.base not in _left

    def drop(self, name: str) -> None:
        _delete(self._path(name), self.conf)
        self.names.remove(name)

    def close(self) -> None:
        """Drops all tables and their folder."""
        if not self.gone():
            _delete(*_left.pop(self.base))
        self.names.clear()

    def only(self, *prefixes: str) -> None:
        """Drops all tables but those whose names begin so."""
        for name in [n for n in self.names if not n.startswith(prefixes)]:
            self.drop(name)
