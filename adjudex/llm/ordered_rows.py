"""Places and running totals inside groups of any size, without a task for a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a group that one window takes for a running total; a second window takes the blocks' totals.
BLOCK = 1024


def numbered(rows: DataFrame, key: str, ranges: list[Column], order: list[Column], to: str) -> DataFrame:
    """Add ``to``: each row's place, from 0, in its ``key``'s rows by ``order``.

    Rows are ranged by ``key`` and ``ranges``, short columns that ``order``
    begins with, so a group may lie in many partitions. Each counts its own
    rows; only a partition's first group can go on from the one before, so the
    offsets are at most a row for each partition, and broadcast.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(n, key, *ranges).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "__part", before.alias("__before")).filter("__before > 0")
    local = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)) - 1
    joined = ranged.withColumn("__local", local).join(F.broadcast(offsets), [key, "__part"], "left")
    return joined.withColumn(to, F.col("__local") + F.coalesce("__before", F.lit(0))).drop("__part", "__local", "__before")


def running(rows: DataFrame, key: str, place: str, totals: dict[str, Callable[[str], Column]], joined: Callable[[Column, Column], Column], backward: bool = False) -> DataFrame:
    """Replace each column of ``totals`` by its running total over ``key``'s rows by ``place``, from the end if ``backward``.

    ``totals`` has an aggregate for each column; ``joined`` adds two of them.
    A window takes ``BLOCK`` places, and a second one a row for each block.
    """
    block = F.floor(F.col(place) / BLOCK)
    marked = rows.withColumn("__block", block)
    way = (lambda c: F.col(c).desc()) if backward else F.col
    inside = Window.partitionBy(key, "__block").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy(way("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(key, "__block").agg(*[f(c).alias(f"__sum_{c}") for c, f in totals.items()])
    before = sums.select(key, "__block", F.lag("__block").over(Window.partitionBy(key).orderBy(way("__block"))).alias("__last"), *[f(f"__sum_{c}").over(earlier).alias(f"__of_{c}") for c, f in totals.items()])
    both = marked.withColumns({c: f(c).over(inside) for c, f in totals.items()}).join(before.filter("__last is not null").drop("__last"), [key, "__block"], "left")
    return both.withColumns({c: F.when(F.col(f"__of_{c}").isNull(), F.col(c)).otherwise(joined(F.col(c), F.col(f"__of_{c}"))) for c in totals}).drop("__block", *[f"__of_{c}" for c in totals])
