"""Repair of conversation structure: the cheapest edits that make the roles alternate."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, stored
from .ordered_rows import numbered

#: Costs of the edits; a truncated row that is not deleted costs more.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: Turns of a lattice that one search takes; longer conversations are searched in such segments, then across them.
SEGMENT = 512
#: Grammar states of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; by state, the next state of each role initial.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
#: Adjacent role initials that are in order.
_PAIRS = {"su", "ua", "au"}
_SEARCHED = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def damaged(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """Damage rows by the CRC-32 of ``conv_id:turn``: 0 drops one, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it the user's.

    Adds ``key``, the conv_id as text, and ``copy``; a null in any column is one space.
    """
    space = F.lit(" ")
    key, turn = F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    rows = conversations.select("conv_id", key.alias("key"), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.concat(key, F.lit(":"), turn).cast("binary")) % modulus).alias("k"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    return rows.filter("k <> 0").select("conv_id", "key", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))


def row_codes(rows: DataFrame) -> DataFrame:
    """(key, place, code): two letters, for the row's role initial and its first fault.

    s, u, a, or o for any other role, an empty one too; then b, d, t or - for
    blank, duplicate, truncated or none.
    """
    # Rows with role and text seen earlier: all but the first of each repeated digest.
    said = rows.select("key", "place", F.sha2(F.concat_ws("\u0000", F.length("role").cast("string"), "role", "text"), 256).alias("said"))
    repeated = stored(said.groupBy("key", "said").agg(F.min("place").alias("seen"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeated")
    later = said.join(repeated, ["key", "said"]).filter("place > seen").select("key", "place", F.lit(True).alias("is_duplicate"))
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){WHITESPACE}*\z", 1)
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(last == "", "b").when(F.col("is_duplicate"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    return rows.join(later, ["key", "place"], "left").select("key", "place", F.concat(role, fault).alias("code"))


def _edits(code: str, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, next state, rows used) of every edit before or at a row; ``code`` is empty after the last."""
    for initial, after in _NEXT[state].items():
        if initial != "s":
            yield INSERT, "I", after, 0
    if not code:
        return
    yield DELETE, "D", state, 1
    role, fault = code
    if fault in "bd":
        return
    more = TRUNCATED if fault == "t" else 0
    if role in _NEXT[state]:
        yield KEEP + more, "K", _NEXT[state][role], 1
    for initial, after in _NEXT[state].items():
        if initial != "s":
            yield REROLE + more, "R", after, 1


@lru_cache(maxsize=50_000)
def cheapest(codes: str, start: int, ends: tuple[int, ...], all_ends: bool) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)}: Dijkstra over the nodes (turn index, grammar state) from (0, ``start``).

    Nodes exist only as they are reached. The queue's key is (cost, audit), so
    equal costs go by the least letters; at one node equal costs never have an
    audit that begins another, hence the order lasts under extension. It ends
    at the first popped end node that is in ``ends``, or once all are.
    """
    n, done, found = len(codes) // 2, set(), {}
    queue = [(0, "", 0, start)]
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not all_ends or len(found) == len(ends):
                break
        for more, letter, after, used in _edits(codes[2 * i : 2 * i + 2], state):
            if (i + used, after) not in done:
                heapq.heappush(queue, (cost + more, audit + letter, i + used, after))
    return found


def across(segments: list[str]) -> tuple[int, str]:
    """The cheapest (cost, audit) of a whole conversation, given its codes in segments.

    A path through a segment is the cheapest between its two grammar states, so
    of each state only the best way to it goes on. One segment is one search.
    """
    if len(segments) == 1:
        return next(iter(cheapest(segments[0], 0, ACCEPTING, False).values()))
    best = {0: (0, "")}
    for codes in segments:
        ways: dict[int, list[tuple[int, str]]] = {}
        for state, (cost, audit) in best.items():
            for end, (more, part) in cheapest(codes, state, (0, 1, 2, 3), True).items():
                ways.setdefault(end, []).append((cost + more, audit + part))
        best = {end: min(found) for end, found in ways.items()}
    return min(best[end] for end in ACCEPTING if end in best)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, segments in zip(batch["key"].to_pylist(), batch["segments"].to_pylist(), strict=True):
            codes = "".join(segments)
            roles, faults = codes[::2], codes[1::2]
            illegal = sum(a + b not in _PAIRS for a, b in zip(roles, roles[1:], strict=False))
            out.append((key, faults.count("b"), faults.count("d"), faults.count("t"), illegal, *across(segments)))
        columns = zip(*out, strict=True) if out else [()] * len(_SEARCHED)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SEARCHED, strict=True)], schema=_SEARCHED)


def search(codes: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(key, blank, duplicate, truncated, illegal, cost, audit) of each conversation with rows: two letters a row come together, no text."""
    item = F.array_sort(F.collect_list(F.struct("place", "code")))
    parts = codes.groupBy("key", F.floor(F.col("place") / segment).alias("s")).agg(F.array_join(F.transform(item, lambda x: x["code"]), "").alias("codes"))
    whole = parts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "codes"))), lambda x: x["codes"]).alias("segments"))
    schema = ", ".join(f"{f.name} {'long' if pa.types.is_int64(f.type) else 'string'}" for f in _SEARCHED)
    return whole.mapInArrow(_searched, schema)


def edited(rows: DataFrame, searched: DataFrame) -> DataFrame:
    """Rows with ``edits``, the letters of the audit up to each row's own and, at the last row, those after it too."""
    letters = searched.select("key", F.posexplode(F.regexp_extract_all("audit", F.lit(r"I*[KRD](?:I+\z)?"), F.lit(0))).alias("place", "edits"))
    return rows.join(letters.withColumn("place", F.col("place").cast("long")), ["key", "place"])


def repaired_turns(role: str, text: str, edits: str, last: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns that ``edits`` make of one row, after a turn whose role initial is ``last`` (empty: none)."""
    for letter in edits:
        if letter == "D":
            continue
        turn = (role, text) if letter == "K" else ("assistant" if last == "u" else "user", text if letter == "R" else "")
        last = turn[0][:1]
        yield turn


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash each conversation's repaired turns while they stream by in order; only the running digest is held."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    key, digest, last = None, None, ""
    for batch in batches:
        out: list[tuple] = []
        for now, role, text, edits in zip(*[batch[c].to_pylist() for c in ("key", "role", "text", "edits")], strict=True):
            if now != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, last = now, hashlib.sha256(), ""
            for turn in repaired_turns(role, text, edits, last):
                digest.update(f"{chr(10) if last else ''}{turn[0]}:{turn[1]}".encode())
                last = turn[0][:1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], schema=schema)


def in_order(rows: DataFrame) -> DataFrame:
    """Add ``place``: by turn, null first; equal turns by role, then text; copies stay together."""
    turn = F.col("turn").asc_nulls_first()
    return numbered(rows, "key", [turn, F.substring("role", 1, 64)], [turn, F.col("role"), F.col("text"), F.col("copy")], "place")


def structure_report(conversations: DataFrame, modulus: int = 20) -> DataFrame:
    """A row for each conv_id of ``conversations``: its faults after damage, and its cheapest repair.

    A null conv_id is a conversation too. Texts may be of any length and enter
    the search as two letters only. What a conversation's row holds whole is
    its audit, by contract; turns are never gathered, and the digest is of a
    stream. Conversations that lost all rows have zeros, an empty audit and the
    digest of nothing. No rows give no rows; other columns are ignored.
    """
    rows = stored(in_order(damaged(conversations, modulus)), "damaged")
    searched = stored(search(row_codes(rows)), "searched")
    spans = rows.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = edited(rows, searched).select("key", "place", "role", "text", "edits").repartition(n, "key").sortWithinPartitions("key", "place")
    digests = turns.mapInArrow(_digests, "key string, repaired_sha256 string")
    every = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = every.join(searched, "key", "left").join(spans, "key", "left").join(digests, "key", "left")

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0).cast("long")).alias(name)

    return found.select(
        "conv_id",
        *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
