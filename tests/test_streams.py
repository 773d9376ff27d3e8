import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from adjudex.operators import sessions
from adjudex.streaming import evaluation as V

START = datetime(2024, 5, 1, 9)
SCHEMA = "session_id long, ts timestamp, type string, content string, score double"


@pytest.fixture(scope="module")
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, old)


def interview(n_sessions=6, seed=3):
    r, rows = random.Random(seed), []
    texts = ["Candidate switched tabs", "exited full-screen", "no face detected", "hello", "Fatal strike 3"]
    for s in range(n_sessions):
        at = START + timedelta(seconds=r.randrange(600))
        for _ in range(r.randrange(3, 14)):
            at += timedelta(seconds=r.choice([5, 60, 300, 4000]), microseconds=r.randrange(10**6))
            kind = r.choice(["event", "answer", "answer", "competency", "integrity", "disconnect", "note"])
            content = {"event": r.choice(texts[: 4 + s % 2]), "competency": r.choice(["communication", "Technical", "problem_solving"])}.get(kind)
            score = {"answer": r.choice([3.5, 7.25, 10.0, None]), "competency": float(r.randrange(101)), "integrity": float(r.randrange(50, 101))}.get(kind)
            rows.append((s, at, kind, content, score))
    return rows


def stream_of(spark, batches, folder):
    """A file for each batch, read one a trigger, in the order given."""
    import os
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    os.makedirs(folder)
    types = [pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.float64()]
    now = time.time()
    for i, rows in enumerate(batches):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        pq.write_table(pa.table(columns, names), f"{folder}/{i:04}.parquet")
        os.utime(f"{folder}/{i:04}.parquet", (now + i - 1000, now + i - 1000))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode, place):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(place)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def plain(df):
    return sorted(map(str, df.drop("episode").collect()))


def test_session_stream_equals_batch(stateful, tmp_path):
    rows = interview()
    rows.sort(key=lambda x: x[1])
    # Neighbours in time are swapped across batches, within the delay.
    r = random.Random(5)
    shuffled = sorted(rows, key=lambda x: x[1] + timedelta(seconds=r.randrange(500)))
    batches = [shuffled[i : i + 9] for i in range(0, len(shuffled), 9)]
    far = [(99, rows[-1][1] + timedelta(days=i), "note", None, None) for i in (1, 2)]
    stream = stream_of(stateful, [*batches, *[[x] for x in far]], tmp_path / "in")
    got = run(V.evaluate_session_stream(stream), "ended", "append", tmp_path / "cp").filter("session <> 99")
    want = V.evaluate_sessions(stateful.createDataFrame(rows, SCHEMA))
    assert plain(got) == plain(want)
    assert want.filter("ended_by = 'disconnect'").count() > 2 and want.filter("ended_by = 'idle'").count() > 2


def test_session_stream_drops_late_messages(stateful, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, at(0), "answer", None, 8.0)], [(2, at(120), "note", None, None)], [(1, at(1), "answer", None, 0.0)], [(2, at(121), "note", None, None)]]
    got = run(V.evaluate_session_stream(stream_of(stateful, batches, tmp_path / "in")), "late", "append", tmp_path / "cp").filter("session = 1").collect()
    assert [(x.qa_score, x.answers, x.ended_by) for x in got] == [(80.0, 1, "idle")]


def test_session_results_by_hand(spark):
    at = lambda m: START + timedelta(minutes=m)
    rows = [
        (1, at(0), "answer", None, 8.0), (1, at(1), "answer", None, 6.0), (1, at(2), "event", "Switched tabs", None), (1, at(3), "competency", "communication", 99.0),
        (1, at(4), "competency", "technical", 50.0), (1, at(5), "integrity", None, 90.0), (1, at(6), "disconnect", None, None), (1, at(7), "event", "Fatal Strike 3", None), (None, at(1), "answer", None, 1.0),
    ]
    first, second = V.evaluate_sessions(spark.createDataFrame(rows, SCHEMA)).orderBy("started").collect()
    assert (first.qa_score, first.integrity, first.proctoring_status, first.ended_by) == (70.0, 85, "Warning/Violations Detected", "disconnect")
    assert (first.communication, first.technical, first.problem_solving, first.suitability, first.outcome) == (85.0, 50.0, 70.0, 74.5, "Recommend Hire")
    assert (second.qa_score, second.integrity, second.proctoring_status, second.outcome, second.ended_by) == (0.0, 0, "Terminated", "Do Not Hire", "idle")
    assert V.evaluate_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_context_stream_equals_window(stateful, tmp_path):
    r = random.Random(8)
    turns = [(s, START + timedelta(seconds=i), "system" if i == 0 else r.choice(["user", "assistant"]), f"turn {i} of {s}", None) for s in range(4) for i in range(3 + 5 * s)]
    r.shuffle(turns)
    batches = [turns[i : i + 7] for i in range(0, len(turns), 7)]
    stream = stream_of(stateful, batches, tmp_path / "in").withColumn("at", F.unix_seconds("ts"))
    found = V.context_stream(stream, "session_id", "ts", "at", "type", "content", 6)
    seen = {}

    def keep(batch, _):
        latest = {}
        for x in batch.collect():
            latest.setdefault(x.session, []).append((x["at"], x.role, x.text))
        seen.update(latest)

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    whole = stateful.createDataFrame(turns, SCHEMA).withColumn("at", F.unix_seconds("ts"))
    want = {}
    for x in sessions.with_first(whole, "session_id", ["at"], 6).orderBy("at").collect():
        want.setdefault(x.session_id, []).append((x["at"], x.type, x.content))
    assert {k: sorted(v) for k, v in seen.items()} == want
    assert max(map(len, want.values())) == 7


def test_log_takes_a_batch_once(spark, tmp_path):
    path, batch = str(tmp_path / "log"), spark.range(5).withColumn("note", F.lit("a"))
    assert V.read_log(spark, path) is None
    assert V.append_batch(batch, 0, path, "one") and not V.append_batch(batch, 0, path, "one")
    assert V.append_batch(batch.limit(2), 0, path, "two")
    # An attempt that was lost before it entered the ledger is not seen, and the next one replaces it.
    batch.write.parquet(f"{path}/rows/stream=one/batch=1")
    assert V.read_log(spark, path).count() == 7
    assert V.append_batch(batch.filter("id = 3"), 1, path, "one")
    assert V.read_log(spark, path).groupBy("stream", "batch").count().count() == 3 and V.read_log(spark, path).count() == 8


def test_append_log_drops_repeated_events(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), "event", f"e{i}", None) for i in range(10)]
    stream = stream_of(spark, [rows[:6], rows[3:], rows], tmp_path / "in")
    V.append_log(stream, str(tmp_path / "log"), str(tmp_path / "cp"), "events", ["session_id"]).awaitTermination()
    assert sorted(x.session_id for x in V.read_log(spark, str(tmp_path / "log")).collect()) == list(range(10))
