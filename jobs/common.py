"""What the jobs share: config files and the command line around a function that takes a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

log = logging.getLogger("lociloom.jobs")


def config(kind: type, path: str | Path):
    """The settings of a JSON file as an object of that dataclass; unknown names are an error."""
    given = json.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return kind(**given)


def command(name: str, about: str, paths: dict[str, str], kind: type, work: Callable, argv: list[str] | None = None) -> int:
    """Reads the paths (name: help) and --config from the command line, and calls work(session, config, **paths) in a session of its own."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, told in paths.items():
        p.add_argument(f"--{path}", required=True, help=told)
    p.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="settings (JSON)")
    given = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    settings = config(kind, given.pop("config"))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, settings, **given)
    finally:
        spark.stop()
    return 0
