"""Helpers that several training-data operators share.

Intermediate tables go to the shared folder (``cairn.sources.shared``).  Python
functions of this package are pickled by value, so executors need no copy of the
repository on their path.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import written  # noqa: F401  for the operators

cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Word separators of the white-space word rule, as a Java/RE2/Python class.
SPACE = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"

#: Arrow batches are kept to this many rows, as one text may have megabytes.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small; long texts would make large ones otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: str) -> "F.Column":
    """Number of white-space words of a column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NON_SPACE)), F.lit(0)).cast("long")


POWER_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(POWER_BASE, size, 2**64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(POWER_BASE, -size, 2**64))))
        return self.up[:n], self.down[:n]
