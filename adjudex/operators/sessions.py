"""Chat sessions and interview scoring as window and grouping plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adjudex.functions.stats import python_round


def last_n(messages: DataFrame, session: str, order: list[str], n: int = 12) -> DataFrame:
    """The ``n`` most recent messages of each session, to be read in ascending order of ``order``."""
    newest = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= n).drop("__r")


def with_first(messages: DataFrame, session: str, order: list[str], n: int = 6) -> DataFrame:
    """The first message of each session and its last ``n``."""
    up, down = (Window.partitionBy(session).orderBy(*[f(c) for c in order]) for f in (F.asc, F.desc))
    ranked = messages.withColumn("__a", F.row_number().over(up)).withColumn("__d", F.row_number().over(down))
    return ranked.filter((F.col("__a") == 1) | (F.col("__d") <= n)).drop("__a", "__d")


def merge_roles(messages: DataFrame, session: str, order: str, role: str, text: str, joint: str = "\n\n") -> DataFrame:
    """(session, block, role, text, n): consecutive messages of one role joined in order."""
    by = Window.partitionBy(session).orderBy(order)
    change = F.coalesce((F.lag(role).over(by) != F.col(role)).cast("int"), F.lit(1))
    blocks = messages.withColumn("__c", change).withColumn("block", F.sum("__c").over(by))
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return blocks.groupBy(session, "block", role).agg(F.array_join(F.transform(parts, lambda x: x[text]), joint).alias(text), F.count("*").alias("n"))


def transcript(messages: DataFrame, session: str, order: str, role: str, text: str, skip: str = "system") -> DataFrame:
    """A line ``ROLE: text`` for each turn but the skipped role's, in order."""
    line = F.concat(F.upper(role), F.lit(": "), F.col(text))
    parts = F.array_sort(F.collect_list(F.struct(order, line.alias("line"))))
    return messages.filter(F.col(role) != skip).groupBy(session).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("transcript"))


def first_by_key(rows: DataFrame, key: str, order: list[Column], limit: int = 4) -> DataFrame:
    """The first row of each key, then the first ``limit`` of them."""
    by = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r").orderBy(*order).limit(limit)


def sessions_listed(sessions: DataFrame) -> DataFrame:
    """Pinned first, then the most recent."""
    return sessions.orderBy(F.desc("is_pinned"), F.desc("updated_at"), "id")


def without_messages(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    return sessions.join(messages.select(F.col("session_id").alias("id")), "id", "left_anti")


def session_title(prompt: Column, limit: int = 30) -> Column:
    text = F.trim(prompt)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def round_robin(rows: DataFrame, order: str, n: int, name: str = "turn_of") -> DataFrame:
    """Adds each row's place in the order, modulo ``n``: numbers inside range partitions, and the partitions' offsets, a row each."""
    dealt = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    # One row for each partition.
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.pmod(F.col("__at") + F.col("__before"), F.lit(n)).cast("int")).drop("__part", "__at", "__before")


def without_marker(messages: DataFrame, text: str, marker: str) -> DataFrame:
    """Messages that don't begin with a marker; ``last_n`` then gives the recent ones."""
    return messages.filter(~F.coalesce(F.startswith(F.col(text), F.lit(marker)), F.lit(False)))


def newest_first(rows: DataFrame, moment: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(moment), "id")


def ranked_by_suitability(candidates: DataFrame, score: str, *groups: str) -> DataFrame:
    """Adds ``place`` from 1 by falling score inside each group; equal scores share one."""
    return candidates.withColumn("place", F.rank().over(Window.partitionBy(*groups).orderBy(F.desc_nulls_last(score))))


# Phrases of warnings, points, and labels of outcomes.
def is_fatal(event: Column) -> Column:
    e = F.lower(event)
    return F.contains(e, F.lit("fatal strike 3")) | F.contains(e, F.lit("auto-terminated"))


def penalty(event: Column) -> Column:
    """Points lost by an event: the first kind that fits."""
    e = F.lower(event)

    def has(*words: str) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(e, F.lit(w))
        return test

    return (
        F.when(has("exited full-screen"), 10)
        .when(has("switched tabs", "lost focus"), 15)
        .when(has("multiple") & has("faces"), 20)
        .when(has("no face detected", "left camera"), 20)
        .when(has("clipboard", "context menu"), 25)
        .otherwise(0)
    )


def integrity(events: DataFrame, session: str, order: str, description: str) -> DataFrame:
    """(session, integrity, proctoring_status, is_terminated): 100 less the penalties, from 0 to 100; a fatal event gives 0 and ends it."""
    fatal, e = is_fatal(F.col(description)), F.col(description)
    lost = F.sum(penalty(e))
    ended = F.count_if(fatal) > 0
    score = F.when(ended, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)))
    out = events.groupBy(session).agg(score.cast("int").alias("integrity"), ended.alias("is_terminated"))
    status = F.when(F.col("is_terminated"), "Terminated").when(F.col("integrity") < 100, "Warning/Violations Detected").otherwise("Clean")
    return out.select(session, "integrity", status.alias("proctoring_status"), "is_terminated")


def strikes(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Events numbered in each session, with ``strike`` from 1 and ``fatal`` from the third on."""
    by = Window.partitionBy(session).orderBy(*order)
    return events.withColumn("strike", F.row_number().over(by)).withColumn("fatal", F.col("strike") >= 3)


def debounce(events: DataFrame, session: str, moment: str, event_id: str, gap_ms: int = 2000) -> DataFrame:
    """(session, event_id) of the events accepted: those ``gap_ms`` or more after the last accepted one.

    What counts is the accepted event before, so this is a fold over ordered
    events, not a lag. An event ``gap_ms`` or more after the one before it is
    always accepted, though, so the fold needs no more than the run from there on.
    """
    order = Window.partitionBy("s").orderBy("t", "id")
    timed = events.select(F.col(session).alias("s"), F.unix_millis(F.col(moment).cast("timestamp")).alias("t"), F.col(event_id).alias("id"))
    fresh = F.coalesce(F.col("t") - F.lag("t").over(order) >= gap_ms, F.lit(True))
    runs = timed.withColumn("fresh", fresh.cast("long")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct("t", "id")
    start = F.struct(F.lit(None).cast("long").alias("t"), F.array().cast("array<long>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["t"].isNull() | (x["t"] - acc["t"] >= gap_ms)
        return F.when(ok, F.struct(x["t"].alias("t"), F.array_append(acc["ids"], x["id"].cast("long")).alias("ids"))).otherwise(acc)

    folded = runs.groupBy("s", "run").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda a: a["ids"]).alias("ids"))
    return folded.select(F.col("s").alias(session), F.explode("ids").alias(event_id))


def qa_score(scores: Column) -> Column:
    """Sum of scores out of 10 as a percentage of the most there could be, to one digit; 0 without any. An aggregate."""
    return F.coalesce(python_round(F.try_divide(F.sum(scores) * 10.0, F.count(scores)), F.lit(1)), F.lit(0.0))


def competency(score: Column, qa: Column, room: int) -> Column:
    """A competency can't exceed the answers' score by more than ``room``; NULL counts as the answers' score."""
    return F.least(F.coalesce(score, qa), qa + room)


def merged_integrity(base: Column, external: Column) -> Column:
    return F.least(base, F.coalesce(external, F.lit(100.0)).cast("int"))


def suitability(qa: Column, integrity_score: Column) -> Column:
    return python_round(qa * 0.70 + integrity_score * 0.30, F.lit(1))


def hire_bucket(score: Column) -> Column:
    return F.when(score < 50.0, "Do Not Hire").when(score < 70.0, "Consider with Reservations").otherwise("Recommend Hire")


def event_line(moment: Column, category: Column, description: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(moment, "HH:mm:ss"), F.lit("] "), category, F.lit(": "), description)


def enrol(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates with their job's title and text; ``Unknown`` and an empty text where there is no such job."""
    own = jobs.select(F.col("id").alias("jd_id"), F.col("title").alias("job_role"), "jd_text")
    return candidates.join(own, "jd_id", "left").withColumns({"job_role": F.coalesce("job_role", F.lit("Unknown")), "jd_text": F.coalesce("jd_text", F.lit(""))})


def text_or(extracted: Column, pasted: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(extracted), F.lit("")), F.trim(pasted))
