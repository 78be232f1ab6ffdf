"""What the jobs share: configuration, sessions of the command line, and logging."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path


def log(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def options(job: str, paths: list[str], argv: list[str] | None = None) -> tuple[dict[str, str], dict]:
    """The paths given on the command line, and the settings of the job's configuration file."""
    parser = argparse.ArgumentParser(prog=job)
    for p in paths:
        parser.add_argument(f"--{p}", required=True, help=f"path of {p}; may be remote")
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{job}.json")), help="JSON file of settings")
    told = vars(parser.parse_args(argv))
    settings = json.loads(Path(told.pop("config")).read_text())
    return told, settings


def main(job: str, paths: list[str], run) -> None:
    """Run a job from the command line: the only place where a session is made and stopped."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    told, settings = options(job, paths)
    from pyspark.sql import SparkSession

    from corpusloom.session import ship

    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        ship(spark)
        run(spark, **told, **settings)
    finally:
        spark.stop()
