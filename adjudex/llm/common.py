"""Shared storage and small column helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return.
WHITESPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set if everything runs
    in one process, as in tests; on a cluster that raises ``RuntimeError``.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: lost executors cost the tasks that read the table, not
    the jobs that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Like ``stored``, as a table in buckets of ``keys``, so that joins and groups by these move no row of it again.

    The files are in the shared folder, whatever the warehouse is; the
    catalogue's entry goes at once, the files stay for lazy results.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).format("parquet").option("path", place).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with their groups (one row a key), where some keys may hold a large share of all rows.

    Groups of more than a thousandth of ``n_rows`` (and of 1,000 rows), of which
    there can be 1,000 at most, are broadcast, so their rows do not shuffle.
    ``groups`` should be a stored table, for it is read three times.
    """
    hot = groups.filter(F.col(size) > max(1000, n_rows // 1000))
    large = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return large.unionByName(others.join(groups.filter(F.col(size) <= max(1000, n_rows // 1000)), keys))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Texts may be long, so that fewer rows than usual are read, handed to Python or held back by a Parquet writer at once;
#: and an operator has many jobs, whose plans the driver keeps as text.
_SMALL = {"spark.sql.maxPlanStringLength": 10_000, "spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.parquet.columnarReaderBatchSize": 512, "parquet.block.size": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes to what executors of little memory can take; smaller ones stay."""
    for name, most in _SMALL.items():
        if not 0 < int(spark.conf.get(name, "0")) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
