"""Interview sessions evaluated at their end, recent chat context, and a log that a batch enters once.

Streams with state need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from adjudex.operators import sessions as H

#: What a session's messages add up to: sums, and the last score of each competency as (moment, score).
_SUMS = "events long, lost long, fatal long, answers long, answer_sum long, external long"
# Competencies and how far each may exceed the answers' score.
ROOM = {"communication": 15, "technical": 10, "problem_solving": 10}
#: Scores are added up as whole numbers of this many parts, so that the order of messages doesn't matter.
_PARTS = 1_000_000
_MOMENTS = "start_us long, end_us long, ended_by string"
_EPISODE = f"{_MOMENTS}, {_SUMS}, " + ", ".join(f"{c} double" for c in ROOM)
_MESSAGE = "us long, closes boolean, n_event long, lost long, fatal long, n_answer long, parts long, external long, competency string, score double"
_TURN = "us long, at long, role string, text string"
_NAMES = [x.split()[0] for x in _MESSAGE.split(", ")]


def messages(rows: DataFrame, session: str, moment: str, kind: str, content: str, score: str) -> DataFrame:
    """(session, moment, what the message adds): messages in the form that the batch and the stream both add up.

    Kinds: ``event`` (``content`` describes it), ``answer`` (``score`` out of
    10), ``competency`` (``content`` names it), ``integrity`` (an outside score)
    and ``disconnect``. Other kinds only keep a session open.
    """
    is_event, is_answer = F.col(kind) == "event", F.col(kind) == "answer"
    lost = F.when(is_event, H.penalty(F.col(content))).otherwise(0)
    fatal = F.coalesce(is_event & H.is_fatal(F.col(content)), F.lit(False))
    scored = is_answer & F.col(score).isNotNull()
    parts = {
        "us": F.unix_micros(F.col(moment).cast("timestamp")), "closes": F.coalesce(F.col(kind) == "disconnect", F.lit(False)), "n_event": F.coalesce(is_event, F.lit(False)).cast("long"),
        "lost": lost.cast("long"), "fatal": fatal.cast("long"), "n_answer": F.coalesce(scored, F.lit(False)).cast("long"),
        "parts": F.when(scored, F.round(F.col(score) * _PARTS).cast("long")).otherwise(0), "external": F.when(F.col(kind) == "integrity", F.col(score).cast("long")),
        "competency": F.when((F.col(kind) == "competency") & F.col(score).isNotNull(), F.lower(content)), "score": F.col(score).cast("double"),
    }
    return rows.select(F.col(session).alias("session"), F.col(moment).cast("timestamp").alias("moment"), *[c.alias(n) for n, c in parts.items()])


def results(episodes: DataFrame) -> DataFrame:
    """Scores of episodes: penalties, integrity, status, answers' score, clamped competencies, suitability and outcome."""
    qa = F.coalesce(H.python_round(F.try_divide(F.col("answer_sum") / _PARTS * 10.0, F.col("answers")), F.lit(1)), F.lit(0.0))
    ended = F.col("fatal") > 0
    base = F.when(ended, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.col("lost")))).cast("int")
    status = F.when(ended, "Terminated").when(F.col("base") < 100, "Warning/Violations Detected").otherwise("Clean")
    rows = episodes.withColumns({"base": base, "qa_score": qa}).withColumn("integrity", F.least("base", F.coalesce("external", F.lit(100)).cast("int")))
    rows = rows.withColumn("suitability", H.suitability(F.col("qa_score"), F.col("integrity")))
    return rows.select(
        "session", F.timestamp_micros("start_us").alias("started"), F.timestamp_micros("end_us").alias("ended"), "ended_by", "events", "answers", "qa_score", "integrity", status.alias("proctoring_status"),
        *[H.competency(F.col(c), F.col("qa_score"), room).alias(c) for c, room in ROOM.items()], "suitability", H.hire_bucket(F.col("suitability")).alias("outcome"),
    )


def evaluate_sessions(rows: DataFrame, session: str = "session_id", moment: str = "ts", kind: str = "type", content: str = "content", score: str = "score", idle: str = "30 minutes") -> DataFrame:
    """A row for each episode of a session, in a batch: it ends at a disconnect, or after ``idle`` without a message.

    At one moment a disconnect comes last. Rows without a session or moment
    take no part.
    """
    gap = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"INTERVAL {idle}"))
    own = Window.partitionBy("session").orderBy("us", "closes")
    fresh = F.coalesce((F.col("us") - F.lag("us").over(own) > gap) | F.lag("closes").over(own), F.lit(True))
    parts = messages(rows, session, moment, kind, content, score).filter("session is not null and us is not null")
    parts = parts.withColumn("__fresh", fresh.cast("int")).withColumn("episode", F.sum("__fresh").over(own))
    last = [F.max(F.when(F.col("competency") == c, F.struct("us", "score")))["score"].alias(c) for c in ROOM]
    ended = F.when(F.bool_or("closes"), "disconnect").otherwise("idle")
    return results(
        parts.groupBy("session", "episode").agg(
            F.min("us").alias("start_us"), F.max("us").alias("end_us"), ended.alias("ended_by"), F.sum("n_event").alias("events"), F.sum("lost").alias("lost"), F.sum("fatal").alias("fatal"),
            F.sum("n_answer").alias("answers"), F.sum("parts").alias("answer_sum"), F.min("external").alias("external"), *last,
        )
    )


class _Episodes(StatefulProcessor):
    """Messages wait until the watermark has passed them, then are added to the open episode in order."""

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _MESSAGE)
        self.open = handle.getValueState("open", _EPISODE)
        self.scores = handle.getMapState("scores", "competency string", "us long, score double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        new = []
        for frame in rows:
            for x in frame[_NAMES].astype(object).where(frame[_NAMES].notna(), None).itertuples(index=False, name=None):
                # What the watermark has passed is late: its place in the order is gone.
                if x[0] > watermark:
                    new.append((int(x[0]), bool(x[1]), *(None if v is None else int(v) for v in x[2:8]), x[8], None if x[9] is None else float(x[9])))
        if new:
            self.waiting.appendList(new)
            # A timer for the first one is enough: each timer sets the next.
            self.handle.registerTimer(min(x[0] for x in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        kept = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((x for x in kept if x[0] <= watermark), key=lambda x: (x[0], x[1]))
        later = [tuple(x) for x in kept if x[0] > watermark]
        out = []
        for x in due:
            if self.open.exists() and x[0] - self.open.get()[1] > self.idle_us:
                out.append(self._close("idle"))
            self._add(x)
            if x[1]:
                out.append(self._close("disconnect"))
        if self.open.exists() and watermark - self.open.get()[1] > self.idle_us:
            out.append(self._close("idle"))
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        following = [min(x[0] for x in later) // 1000 + 1] if later else []
        if self.open.exists():
            following.append((self.open.get()[1] + self.idle_us) // 1000 + 1)
        if following:
            self.handle.registerTimer(max(min(following), timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["session", *[c.split()[0] for c in _EPISODE.split(", ")]])

    def _add(self, x: tuple) -> None:
        e = list(self.open.get()) if self.open.exists() else [x[0], x[0], "", 0, 0, 0, 0, 0, None, *[None] * len(ROOM)]
        e[1] = x[0]
        for i, v in zip((3, 4, 5, 6, 7), x[2:7]):
            e[i] += v
        if x[7] is not None:
            e[8] = x[7] if e[8] is None else min(e[8], x[7])
        self.open.update(tuple(e))
        if x[8] in ROOM:
            known = self.scores.getValue((x[8],)) if self.scores.containsKey((x[8],)) else None
            self.scores.updateValue((x[8],), max((x[0], x[9]), tuple(known)) if known else (x[0], x[9]))

    def _close(self, why: str) -> tuple:
        e = list(self.open.get())
        e[2] = why
        for i, c in enumerate(ROOM):
            e[9 + i] = self.scores.getValue((c,))[1] if self.scores.containsKey((c,)) else None
        self.open.clear()
        self.scores.clear()
        return tuple(e)


def evaluate_session_stream(
    rows: DataFrame, session: str = "session_id", moment: str = "ts", kind: str = "type", content: str = "content", score: str = "score", idle: str = "30 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """``evaluate_sessions`` of a stream: each episode is given once, when the watermark has passed its disconnect or its ``idle`` time.

    Messages up to ``delay`` late take their place in the order of time, later
    ones are dropped. State of a session is its messages of the last ``delay``,
    sums of the open episode and the last score of each competency; with the end
    of the episode it is gone.
    """
    gap = rows.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {idle})").first()[0]
    parts = messages(rows, session, moment, kind, content, score).filter("session is not null and us is not null").withWatermark("moment", delay)
    kind_of = dict(parts.dtypes)["session"]
    found = parts.groupBy("session").transformWithStateInPandas(_Episodes(gap), f"session {kind_of}, {_EPISODE}", "append", "eventtime")
    return results(found)


class _Context(StatefulProcessor):
    """A ring of the last messages, and the first one; a timer drops both."""

    def __init__(self, n: int, idle_ms: int) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", _TURN)
        self.ring = handle.getListState("ring", _TURN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = tuple(self.first.get()) if self.first.exists() else None
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        for frame in rows:
            new = [(int(u), int(a), r, t) for u, a, r, t in zip(frame["us"], frame["at"], frame["role"], frame["text"])]
            lowest = min(new, key=lambda x: x[:2])
            first = lowest if first is None or lowest[:2] < first[:2] else first
            ring = sorted(ring + new, key=lambda x: x[:2])[-self.n :]
        self.first.update(first)
        self.ring.put(ring)
        self.handle.registerTimer(self._expiry(ring))
        shown = ring if ring[0][:2] <= first[:2] else [first, *ring]
        yield pd.DataFrame([(key[0], *x[1:]) for x in shown], columns=["session", "at", "role", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Of a session that went on, an earlier message's timer does nothing.
        if self.ring.exists() and self._expiry([tuple(x) for x in self.ring.get()]) <= timerValues.getCurrentWatermarkInMs():
            self.first.clear()
            self.ring.clear()
        return iter(())

    def _expiry(self, ring: list[tuple]) -> int:
        return ring[-1][0] // 1000 + self.idle_ms


def context_stream(rows: DataFrame, session: str, moment: str, order: str, role: str, text: str, n: int = 6, idle_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """(session, at, role, text): after each batch, for each session with new messages, its first message and its last ``n``, as ``with_first`` gives them.

    Messages are in the order of ``moment``, then ``order`` (a whole number, given
    as ``at``). State is ``n`` + 1 messages a session, whatever its length; it is
    dropped when the watermark is ``idle_minutes`` past its last message, and a
    session that goes on after that begins anew. Texts and roles should not be null.
    """
    kind_of = dict(rows.dtypes)[session]
    parts = rows.select(
        F.col(session).alias("session"), F.col(moment).cast("timestamp").alias("moment"), F.unix_micros(F.col(moment).cast("timestamp")).alias("us"), F.col(order).cast("long").alias("at"),
        F.col(role).alias("role"), F.col(text).alias("text"),
    ).filter("session is not null and moment is not null and at is not null")
    timed = parts.withWatermark("moment", delay).groupBy("session")
    return timed.transformWithStateInPandas(_Context(n, idle_minutes * 60_000), f"session {kind_of}, at long, role string, text string", "update", "eventtime")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_batch(batch: DataFrame, batch_id: int, path: str, stream: str) -> bool:
    """Append a batch of the named stream to the log at ``path`` if its ledger doesn't have it; whether it was written.

    Rows go to a folder of their own, which a second attempt overwrites; only
    then the batch enters the ledger. So a batch given twice, or one whose first
    attempt was lost half way, is in the log once.
    """
    spark = batch.sparkSession
    ledger = _read(spark, f"{path}/ledger")
    if ledger is not None and not ledger.filter((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
        return False
    batch.write.mode("overwrite").parquet(f"{path}/rows/stream={stream}/batch={batch_id}")
    spark.range(1).select(F.current_timestamp().alias("written")).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/stream={stream}/batch={batch_id}")
    return True


def append_log(rows: DataFrame, path: str, checkpoint: str, stream: str, keys: list[str], moment: str = "ts", delay: str = "10 minutes", **trigger):
    """Start a stream that appends ``rows`` to the log at ``path``, each event (by ``keys``) once within ``delay``; returns the query.

    ``stream`` names the run of batch numbers, so it must change with the checkpoint.
    """
    once = rows.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.foreachBatch(lambda batch, i: append_batch(batch, i, path, stream)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all batches in the ledger, with ``stream`` and ``batch``; None if there is none yet."""
    ledger = _read(spark, f"{path}/ledger")
    if ledger is None:
        return None
    return spark.read.parquet(f"{path}/rows").join(ledger.select("stream", "batch").distinct(), ["stream", "batch"], "left_semi")
