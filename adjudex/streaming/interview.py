"""Interview events and event-time windows as Structured Streaming plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def by_type(messages: DataFrame, kind: str, type_col: str = "type") -> DataFrame:
    """The messages of one type; batch and stream alike."""
    return messages.filter(F.col(type_col) == kind)


def strikes(events: DataFrame, session: str = "session_id", moment: str = "ts", description: str = "content", gap_ms: int = 2000, fatal: int = 3, delay: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """Number each session's accepted events; the ``fatal``-th ends it.

    State is a session's last accepted time, its strikes and whether it has
    ended; it is dropped after ``idle`` of event time. An event less than
    ``gap_ms`` after the last accepted one is dropped, and so is every event
    after the end.
    """
    minutes = int(idle.split()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, count, ended = state.get if state.exists else (None, 0, False)
        out = []
        rows = pd.concat(list(batches)).sort_values([moment, description])
        for at, what in zip(rows[moment], rows[description]):
            ms = int(at.value // 1_000_000)
            if ended or (last is not None and ms - last < gap_ms):
                continue
            last, count = ms, count + 1
            ended = count >= fatal
            out.append((key[0], at, what, count, ended))
        state.update((last, count, ended))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), last or 0) + minutes * 60_000)
        yield pd.DataFrame(out, columns=[session, moment, description, "strike", "terminated"])

    kinds = dict(events.dtypes)
    schema = f"{session} {kinds[session]}, {moment} timestamp, {description} string, strike int, terminated boolean"
    timed = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)
    return timed.groupBy(session).applyInPandasWithState(step, schema, "last long, strikes int, ended boolean", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, moment: str, width: str, *keys: str, slide: str | None = None, delay: str = "10 minutes", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window; late rows beyond ``delay`` are dropped in a stream."""
    timed = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)
    w = F.window(moment, width, slide) if slide else F.window(moment, width)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_windows(events: DataFrame, moment: str, gap: str, *keys: str, delay: str = "10 minutes", value: str = "value") -> DataFrame:
    """Sessions: events of a key with gaps under ``gap``."""
    timed = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, delay)
    return timed.groupBy(F.session_window(moment, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
