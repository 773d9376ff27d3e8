"""Joins of moments with intervals, and with what came latest before, with or without an equal key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: A bucket with more moments is dealt to several tasks.
SPLIT = 100_000
#: Hot buckets in a table that is broadcast.
BROADCAST_BUCKETS = 100_000
#: Buckets of a level are eight times as wide as those of the level below; the narrowest are of a second.
_NARROWEST, _RATIO = 1_000_000, 8
_WIDTHS = [_NARROWEST * _RATIO**i for i in range(15)]


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def _bucket(moment: Column, width: Column) -> Column:
    """``moment`` divided by ``width``, down, in whole numbers."""
    return ((moment - F.pmod(moment, width)) / width).cast("long")


def _level(length: Column) -> Column:
    """A level has lengths of up to eight widths: wider buckets would compare more in vain, narrower ones copy more intervals."""
    return F.coalesce(*[F.when(length <= w * _RATIO, F.lit(i)) for i, w in enumerate(_WIDTHS[:-1])], F.lit(len(_WIDTHS) - 1))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), split: int = SPLIT) -> DataFrame:
    """Inner join: each point with every interval that holds it, ends included, and with equal ``keys`` if any.

    An interval has a level by its length, which is at most eight times that
    level's width, so that it touches at most nine buckets however long it is
    and is compared with little more than the points that it holds; a point
    looks in one bucket of each level in use. That is an equal join on level and bucket, of
    which the ends are then checked, so nothing is compared outside a bucket. A
    bucket that holds more than ``split`` points is dealt to several tasks, to
    which its intervals are copied.

    Rows with a null moment, end or key match nothing, nor does an interval that
    ends before it starts; repeated rows each match. Columns of both sides are
    kept (keys once), so their other names should differ.
    """
    keys = list(keys)
    low, high = _micros(F.col(start)), _micros(F.col(end))
    held = intervals.withColumns({"__low": low, "__high": high}).filter("__low <= __high")
    held = held.withColumn("__level", _level(F.col("__high") - F.col("__low")))
    used = sorted(r[0] for r in held.select("__level").distinct().collect())
    by_level = F.array(*[F.lit(w) for w in _WIDTHS])
    width = F.element_at(by_level, F.col("__level") + 1)
    own = F.sequence(_bucket(F.col("__low"), width), _bucket(F.col("__high"), width))
    held = held.withColumn("__bucket", F.explode(own))

    moment = _micros(F.col(at))
    places = [F.struct(F.lit(i).alias("level"), _bucket(F.col("__at"), F.lit(_WIDTHS[i])).alias("bucket")) for i in used]
    places = F.array(*places) if places else F.array().cast("array<struct<level:int,bucket:bigint>>")
    asked = points.withColumn("__at", moment).filter("__at is not null").withColumn("__place", F.explode(places))
    asked = asked.withColumns({"__level": F.col("__place.level"), "__bucket": F.col("__place.bucket")}).drop("__place")

    place = [*keys, "__level", "__bucket"]
    hot = cut(asked.groupBy(place).agg(F.ceil(F.count("*") / split).cast("int").alias("__parts")).filter("__parts > 1"))
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n <= BROADCAST_BUCKETS else hot
        parts = F.coalesce("__parts", F.lit(1))
        asked = asked.join(hot, place, "left").withColumn("__part", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("__parts")
        held = held.join(hot, place, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        place = [*place, "__part"]
    met = asked.join(held, place).filter("__at between __low and __high")
    return met.select(*points.columns, *[c for c in intervals.columns if c not in keys])


def latest_before(rows: DataFrame, history: DataFrame, at: str, moment: str, keys: Sequence[str] = (), width: str = "1 day", name: str = "found") -> DataFrame:
    """Each row with the latest ``history`` row at or before its moment, with equal ``keys`` if any, as the struct ``name``.

    Both sides are ordered inside buckets of ``width``; what a bucket inherits
    is found from one row for each bucket. So a key that most rows have, or no
    key at all, is still many tasks; only the buckets of a key, whose number
    grows with the time covered and not with the rows, are ordered at once.

    Of history rows at the same moment the one with the greatest other columns,
    in their order, counts (so these must be orderable, and their names are
    kept). A row without moment or with a null key finds NULL; history rows
    without these count for nothing.
    """
    keys = list(keys)
    ok = reduce(lambda a, c: a & F.col(c).isNotNull(), keys, F.lit(True))
    micros = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {width}"))
    seen = F.struct(_micros(F.col(moment)).alias("__m"), *[c for c in history.columns if c not in keys])
    left = rows.select(*keys, _micros(F.col(at)).alias("__t"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), ok.alias("__ok"))
    right = history.filter(ok).select(*keys, _micros(F.col(moment)).alias("__t"), F.lit(0).alias("__side"), seen.alias("__seen")).filter("__t is not null")
    able = left.filter("__t is not null and __ok").drop("__ok")
    both = able.unionByName(right, allowMissingColumns=True).withColumn("__bucket", _bucket(F.col("__t"), micros))

    each = both.groupBy(*keys, "__bucket").agg(F.max("__seen").alias("__own"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(*keys, "__bucket", F.last("__own", ignorenulls=True).over(earlier).alias("__before"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__side", "__seen").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__seen", ignorenulls=True).over(inside)).filter("__side = 1")
    found = found.join(before, [*keys, "__bucket"], "left").select("__row", F.coalesce("__last", "__before").dropFields("__m").alias(name))
    unable = left.filter("__t is null or not __ok").select("__row", F.lit(None).cast(found.schema[name].dataType).alias(name))
    return found.unionByName(unable).select("__row.*", name)
