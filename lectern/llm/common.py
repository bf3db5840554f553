"""Pieces that the training-data operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.graph import components  # noqa: F401
from lectern.shared import batches, materialize, remove, scratch, shared_dir  # noqa: F401

#: The white space that separates words in every contract: space, tab, LF, VT, FF, CR.
WORD_RE = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """For frames that are returned unplanned: lowers the session's limits of Arrow batches to so many rows and MB, as texts
    may be very long. It never raises them; what is written on the way takes its limits from materialize."""
    for key, most in batches(rows, mb).items():
        now = re.match(r"(\d+)", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= int(most):
            spark.conf.set(key, most)


def lower_ascii(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
