"""Jobs that run the library on files and tables: each has a function that takes a session, and a command line that makes one."""

import argparse
import json
import logging
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def config_of(job: str, path: str | None = None, spark: SparkSession | None = None) -> dict:
    """A job's settings: those in its file here, and over them those in a file that Spark reads."""
    out = json.loads((HERE / f"{job}.json").read_text())
    if path:
        out |= json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
    return out


def command(job: str, paths: list[str], run: Callable[..., dict]) -> None:
    """Runs a job with paths from the command line, which may be of any store that Spark reaches, in a session of its own."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{job}", description=run.__doc__)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help=f"a file of settings over those in {job}.json")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    root = str(HERE.parent)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        config = config_of(job, args.pop("config"), spark)
        run(spark, **args, config=config)
    finally:
        spark.stop()
