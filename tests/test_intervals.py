import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from adjudex.functions import canonical
from adjudex.operators import intervals, runs

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_interval_join_against_all_pairs(spark):
    r = random.Random(4)
    points = [(i, r.choice([1, 2, None]), at(r.randrange(-5000, 10**6)) if r.random() < 0.95 else None) for i in range(120)]
    held = []
    for i in range(80):
        a, n = r.randrange(-10**5, 10**6), r.choice([0, 1, 7, 500, 10**5, 10**8, -5])
        held.append((i, r.choice([1, 2, None]), at(a), at(a + n) if r.random() < 0.95 else None))
    points += points[:3]
    p, h = spark.createDataFrame(points, "p int, k int, t timestamp"), spark.createDataFrame(held, "h int, k int, a timestamp, b timestamp")
    fits = [(x, y) for x in points for y in held if None not in (x[2], y[3]) and y[2] <= x[2] <= y[3]]
    for split in (100_000, 3):
        found = intervals.interval_join(p, h.drop("k"), "t", "a", "b", split=split)
        assert found.columns == ["p", "k", "t", "h", "a", "b"]
        assert sorted((x.p, x.h) for x in found.collect()) == sorted((x[0], y[0]) for x, y in fits)
        found = intervals.interval_join(p, h, "t", "a", "b", ["k"], split=split)
        assert sorted((x.p, x.h) for x in found.collect()) == sorted((x[0], y[0]) for x, y in fits if x[1] is not None and x[1] == y[1])
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert intervals.interval_join(p, h.drop("k").limit(0), "t", "a", "b").count() == 0
    assert intervals.interval_join(p.limit(0), h.drop("k"), "t", "a", "b").count() == 0


def test_buckets_are_not_wider_than_their_intervals(spark):
    # Intervals used to be met in buckets of up to eight times their length.
    lengths = [8_000_001, 9_000_000, 64_000_001, 700 * 60_000_000, 14_400 * 60_000_000, 10**15, 10**18]
    found = spark.createDataFrame([(x,) for x in lengths], "n bigint").select("n", intervals._level(F.col("n")).alias("level")).collect()
    assert len(found) == 7 and all(intervals._WIDTHS[x.level] <= x.n <= 8 * intervals._WIDTHS[x.level] for x in found)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("width", ["1 hour", "30 days"])
def test_latest_before_against_all_pairs(spark, keys, width):
    r = random.Random(9)
    rows = [(i, r.choice([1, 2, None]), at(r.randrange(0, 300_000)) if r.random() < 0.9 else None) for i in range(100)]
    past = [(r.choice([1, 2, None]), at(r.randrange(20_000, 300_000) // 3000 * 3000), i) for i in range(60)] + [(1, None, 99)]
    left = spark.createDataFrame([*rows, rows[0]], "i int, k int, t timestamp")
    right = spark.createDataFrame(past, "k int, m timestamp, n int")
    found = intervals.latest_before(left, right if keys else right.drop("k"), "t", "m", keys, width)
    got = sorted((x.i, x.found and (x.found.m, x.found.n)) for x in found.collect())

    def want(x):
        ok = [(m, n) for k, m, n in past if m is not None and x[2] is not None and m <= x[2] and (not keys or k is not None and k == x[1])]
        return max(ok) if ok else None

    assert got == sorted((x[0], want(x)) for x in [*rows, rows[0]])


def test_canonical_json_equals_sorted_keys(spark):
    texts = ["", "plain", 'a "quote" \\ back', "line\nfeed\ttab\r\b\f", "é ß 漢 😀", "\x00\x1f\x7f", None]
    numbers = [0.0, -0.0, 1.5, 1e-5, 1.25e-4, 123456789.0, 1.5e15, 1e16, 1.2345e22, -2.5e-7, 9.99e7, 1e100, None]
    rows = [Row(b=t, a=Row(z=[n, 1.0], y=bool(i % 2), x={"é": t, "a": None}), c=i, d=[t, "x"]) for i, (t, n) in enumerate((t, n) for t in texts for n in numbers)]
    schema = "b string, a struct<z:array<double>,y:boolean,x:map<string,string>>, c bigint, d array<string>"
    df = spark.createDataFrame(rows, schema)
    got = [x[0] for x in df.select(canonical.row_json(df)).collect()]
    assert got == [json.dumps(x.asDict(True), sort_keys=True, ensure_ascii=True, separators=(",", ":")) for x in rows]
    with pytest.raises(TypeError):
        canonical.row_json(df.select(F.expr("INTERVAL 1 DAY").alias("i")))


def test_fingerprint_has_no_order_but_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, t string")
    print_of = lambda x: canonical.fingerprint(x).collect()
    assert print_of(df) == print_of(df.orderBy(F.desc("i")).select("t", "i").repartition(3))
    assert len({print_of(x)[0].fingerprint for x in (df, df.distinct(), df.limit(0), df.withColumn("i", F.lit(2)))}) == 4
    assert canonical.fingerprint(df, "i").count() == 2


def test_runs_are_counted_in_their_own_pass(spark, tmp_path):
    log, tracker = runs.RunLog(), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("measured", "runs")
    for i, version in enumerate(("V1", "V1", "V2")):
        log.measure(version, spark.range(100 * (i + 1)), lambda df, i=i: df.write.parquet(f"{tmp_path}/{i}"), most=F.max("id"))
    assert len(tracker.getJobIdsForGroup("measured")) == 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    found = {x.version: x for x in runs.run_measures(log.table(spark)).collect()}
    assert (found["V1"].runs, found["V1"].records, found["V2"].records) == (2, 300, 300) and [x["most"] for x in log.observed] == [99, 199, 299]
    assert found["V1"].least_seconds <= found["V1"].median_seconds <= found["V1"].most_seconds and found["V2"].records_per_second > 0
