"""Measures of runs: time, rows and rows a second by version, counted in the pass that does the work."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .metrics import ratio


@dataclass
class RunLog:
    """Runs measured so far: version, seconds and what was observed."""

    runs: list[tuple[str, float, int]] = field(default_factory=list)
    observed: list[dict] = field(default_factory=list)

    def measure(self, version: str, rows: DataFrame, action: Callable[[DataFrame], object], **more: Column) -> object:
        """Do ``action`` on the rows and note its wall time and its number of rows, with further aggregates in ``more``.

        The aggregates are observed in the action's own pass, so there is no
        second job. An action that makes no pass over all rows (``limit``, an
        empty plan that is optimised away) observes what it read. A run that
        fails is not noted. Returns what the action returns.
        """
        seen = Observation()
        watched = rows.observe(seen, F.count("*").alias("records"), *[c.alias(n) for n, c in more.items()])
        start = time.perf_counter()
        result = action(watched)
        seconds = time.perf_counter() - start
        found = seen.get
        self.runs.append((version, seconds, found["records"]))
        self.observed.append(found)
        return result

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, seconds, records), a row for each run."""
        return spark.createDataFrame(self.runs, "version string, seconds double, records long")


def run_measures(runs: DataFrame, *by: str) -> DataFrame:
    """Runs, and the mean, median, least and most seconds, records and records a second, by version (or ``by``); NULL a second without time."""
    keys = by or ("version",)
    s = F.col("seconds")
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.mean(s).alias("mean_seconds"), F.median(s).alias("median_seconds"), F.min(s).alias("least_seconds"), F.max(s).alias("most_seconds"),
        F.sum("records").alias("records"), ratio(F.sum("records"), F.sum(s)).alias("records_per_second"),
    )
