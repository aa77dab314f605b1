"""python -m heddle [REPOSITORY] [--path P] [--threshold KB] [--developer EMAIL] [--simple]: a report on a working tree."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import storage
from .functions.constants import THRESHOLD_KB
from .plans import report
from .plans.engine import Engine


def repository(arguments: argparse.Namespace) -> Path:
    """The positional path before --path before the current folder; ~ is the home folder."""
    return Path(arguments.repository or arguments.path or ".").expanduser().resolve()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="heddle", description=__doc__)
    parser.add_argument("repository", nargs="?")
    parser.add_argument("--path")
    parser.add_argument("--threshold", type=float, default=THRESHOLD_KB, help="KB above which files are left out")
    parser.add_argument("--developer", metavar="EMAIL")
    parser.add_argument("--simple", action="store_true")
    arguments = parser.parse_args(argv)
    root = repository(arguments)
    if not (root / ".git").exists():
        print(f"{root} is no git working tree", file=sys.stderr)
        return 1
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("heddle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine.of_git(spark, str(root), threshold_kb=arguments.threshold)
    try:
        print(report.developer(engine, arguments.developer) if arguments.developer else report.simple(engine) if arguments.simple else report.extended(engine))
    finally:
        if own:
            storage.remove(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
