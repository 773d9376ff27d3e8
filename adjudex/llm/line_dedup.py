"""Removal of passages that documents repeat, by content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import textscan as ts
from .common import join_groups, stored

#: A run of repeated lines is removed if it has more words than this.
MIN_WORDS = 50
#: One line in so many (a power of 2) ends a chunk.
CHUNK_LINES = 4
#: Removals that one copy of a first occurrence's bytes is compared with.
SPLIT = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def text_lines(column: pa.Array) -> dict[str, np.ndarray]:
    """The lines of a slice of texts: text, number in the text, byte range (without the line feed), key and words."""
    raw, bounds = ts.text_bytes(column)
    n = len(bounds) - 1
    feeds = np.flatnonzero(raw == 0x0A)
    last = np.repeat(True, n)
    ends = np.sort(np.concatenate([feeds, bounds[1:]]), kind="stable")
    text = np.concatenate([np.searchsorted(bounds, feeds, "right") - 1, np.arange(n)[last]])
    # A text's own end comes after its line feeds and before the next text's first.
    order = np.lexsort((np.concatenate([np.zeros(len(feeds), bool), np.ones(n, bool)]), np.concatenate([feeds, bounds[1:]]), text))
    text = text[order]
    ends = np.concatenate([feeds, bounds[1:]])[order]
    new_text = np.ones(len(text), bool)
    new_text[1:] = text[1:] != text[:-1]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[new_text] = bounds[:-1]

    hashes = ts.range_hashes(raw, starts, ends, ts.EXACT)
    word_starts, _, _ = ts.scan(raw, bounds)
    words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
    at = np.flatnonzero(new_text)
    number = np.arange(len(text)) - np.repeat(at, np.diff(np.append(at, len(text))))
    return {"text": text, "number": number, "start": starts, "end": ends, "key": hashes, "words": words}


def line_chunks(column: pa.Array, lines: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The chunks of a slice of texts: text, number in the text, byte range (without the last line feed), key, words and range of lines.

    A hash that rolls over two line hashes ends a chunk after one line in
    ``CHUNK_LINES``, so that chunks come out alike wherever the same lines
    follow each other, whatever is before. The key is a hash of the chunk's line
    hashes.
    """
    lines = lines or text_lines(column)
    text, starts, ends, hashes, words = (lines[x] for x in ("text", "start", "end", "key", "words"))
    new_text = lines["number"] == 0
    before = np.roll(hashes, 1)
    before[new_text] = 0
    closes = (ts.mix(hashes * _ODD + before) & np.uint64(CHUNK_LINES - 1)) == 0
    opens = new_text.copy()
    opens[1:] |= closes[:-1]
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(text)))
    place = np.arange(len(text)) - np.repeat(first, size)
    key = ts.mix(np.add.reduceat(ts.mix(hashes + place.astype(np.uint64) * _ODD), first) + size.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    chunk_text = text[first]
    at = np.flatnonzero(new_text[first])
    number = np.arange(len(first)) - np.repeat(at, np.diff(np.append(at, len(first))))
    return {"text": chunk_text, "number": number, "start": starts[first], "end": ends[first + size - 1], "key": key, "words": np.add.reduceat(words, first) if len(first) else words, "first": first, "next": first + size}


def _worded(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of pieces in order, those with words: index, place among them in the text, a key of it, the next one and what is between, whether it is the text's last."""
    at = np.flatnonzero(c["words"] > 0)
    text, key = c["text"][at], c["key"][at]
    total = np.append(np.zeros(1, np.uint64), np.cumsum(ts.mix(c["key"].copy()), dtype=np.uint64))
    between = total[np.roll(at, -1)] - total[at + 1]
    pair = ts.mix(ts.mix(key * _ODD + between) * _ODD + np.roll(key, -1))
    new = np.flatnonzero(np.append(True, text[1:] != text[:-1])[: len(text)])
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    return {"at": at, "place": np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))), "pair": pair, "last": last}


_INTS = ("number", "last", "low", "high", "words")


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk with words of (id, text) rows: id, key, numbers of its first and last line with words, their places among the text's lines with words, words."""
    names = ["id", "key", *_INTS]
    schema = T.StructType([docs.schema["id"], T.StructField("key", T.LongType()), *[T.StructField(n, T.IntegerType()) for n in _INTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                lines = text_lines(texts)
                c, w = line_chunks(texts, lines), _worded(lines)
                low, high = np.searchsorted(w["at"], c["first"]), np.searchsorted(w["at"], c["next"]) - 1
                at = np.flatnonzero(low <= high)
                low, high = low[at], high[at]
                ints = (lines["number"][w["at"][low]], lines["number"][w["at"][high]], w["place"][low], w["place"][high], c["words"][at])
                ids = batch.column("id").slice(a, b - a).take(pa.array(c["text"][at]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(c["key"][at].view(np.int64)), *[pa.array(x.astype(np.int32)) for x in ints]], names)
        ts.release()

    return docs.mapInArrow(run, schema)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line with words of (id, text, ranges) rows that lies in no (low, high) of the ranges of places, or is the last of one: id, number, place, key (null in a range), the key of its succession by the next (null at the end), words."""
    ints = ("number", "place", "words")
    names = ["id", *ints, "key", "pair"]
    schema = T.StructType([docs.schema["id"], *[T.StructField(n, T.IntegerType()) for n in ints], T.StructField("key", T.LongType()), T.StructField("pair", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column("text")):
                lines = text_lines(batch.column("text").slice(a, b - a))
                w = _worded(lines)
                n = len(w["at"])
                first = np.searchsorted(lines["text"][w["at"]], np.arange(b - a))
                edges, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, bool)
                for i, ranges in enumerate(batch.column("ranges").slice(a, b - a).to_pylist()):
                    for x in ranges or ():
                        edges[first[i] + x["low"]] += 1
                        edges[first[i] + x["high"] + 1] -= 1
                        last[first[i] + x["high"]] = True
                inside = np.cumsum(edges)[:n] > 0
                keep = ~inside | last[:n]
                at, inside = w["at"][keep], inside[keep]
                ids = batch.column("id").slice(a, b - a).take(pa.array(lines["text"][at]))
                numbers = (lines["number"][at], w["place"][keep], lines["words"][at])
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x.astype(np.int32)) for x in numbers], pa.array(lines["key"][at].view(np.int64), mask=inside), pa.array(w["pair"][keep].view(np.int64), mask=w["last"][keep])], names)
        ts.release()

    return docs.mapInArrow(run, schema)


def _texts_of(wanted: DataFrame) -> DataFrame:
    """(key, bytes) of the runs of lines, from ``number`` to ``last``, that each (text, units: array of (number, last, key)) row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                raw, _ = ts.text_bytes(texts)
                c = text_lines(texts)
                first = np.searchsorted(c["text"], np.arange(b - a))
                keys, parts = [], []
                for i, named in enumerate(batch.column("units").slice(a, b - a).to_pylist()):
                    for x in named:
                        keys.append(x["key"])
                        parts.append(raw[c["start"][first[i] + x["number"]] : c["end"][first[i] + x["last"]]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["key", "bytes"])
        ts.release()

    return wanted.mapInArrow(run, "key long, bytes binary")


def _without(docs: DataFrame, schema: T.StructType, text_col: str) -> DataFrame:
    """Drop the lines that each row's ``__named`` (array of (number, last, run, bytes)) names, if their bytes are those given, and those without words inside a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column(text_col)):
                part = batch.slice(a, b - a)
                texts = part.column(text_col)
                raw, _ = ts.text_bytes(texts)
                c = text_lines(texts)
                first = np.append(np.searchsorted(c["text"], np.arange(b - a)), len(c["text"]))
                out = []
                for i, named in enumerate(part.column("__named")):
                    if not named.is_valid:
                        out.append(texts[i].as_py())
                        continue
                    start, end, words = (c[x][first[i] : first[i + 1]] for x in ("start", "end", "words"))
                    gone = sorted((x["number"], x["last"], x["run"]) for x in named.as_py() if raw[start[x["number"]] : end[x["last"]]].tobytes() == x["bytes"])
                    drop = {j for low, high, _ in gone for j in range(low, high + 1)}
                    for (_, j, run_), (k, _, other) in zip(gone, gone[1:]):
                        if run_ == other and not words[j + 1 : k].any():
                            drop.update(range(j + 1, k))
                    out.append(b"\n".join(raw[x:y].tobytes() for j, (x, y) in enumerate(zip(start, end)) if j not in drop).decode("utf-8"))
                columns = [pa.array(out, pa.string()) if f.name == text_col else part.column(f.name) for f in schema.fields]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        ts.release()

    return docs.mapInArrow(run, schema)


def _later(occurrences: DataFrame, key: str) -> DataFrame:
    """Occurrences that are not the first of their key, with the first one's id and number.

    Firsts are pre-aggregated; a Bloom filter keeps keys that occur once from
    being shuffled for the join, and the largest groups' firsts are broadcast.
    """
    first = stored(occurrences.groupBy(key).agg(F.count("*").alias("c"), F.min(F.struct("id", "number")).alias("first")).filter("c > 1"), "line-firsts")
    total = first.agg(F.count("*").alias("keys"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    again, _ = bloom.split_by_keys(occurrences, key, first, total["keys"])
    return join_groups(again, first, [key], "c", total["rows"]).drop("c").filter(F.struct("id", "number") != F.col("first"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, number, last, run, key, first_id, first_number) of the lines to remove from (id, text) rows.

    Two steps find what has an earlier occurrence (smaller id, then place).
    First, chunks of several lines: most of a repeated passage lies in them.
    Then single lines, for what chunks leave at its ends or of a passage too
    short to hold a chunk; lines of chunks found before need not be looked at
    again, for their first occurrence is still there. Neighbouring pieces belong
    to one run where their succession, too, has an earlier occurrence; lines
    without words carry a run on and are part of the succession. Runs of more
    than ``min_words`` words go, their first occurrences and shorter runs stay.
    """
    chunks = stored(_chunks(docs), "line-chunks")
    whole = stored(_later(chunks, "key"), "line-later-chunks")
    n = whole.count()
    ranges = whole.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    holding, others = bloom.split_by_keys(docs, "id", whole.select("id").distinct(), n)
    marked = holding.join(ranges, "id", "left").select("id", "text", "ranges")
    lines = stored(_lines(marked.unionByName(others.withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)))), "line-lines")

    single = _later(lines.filter("key is not null").select("id", "number", "place", "words", "key"), "key")
    single = single.select("id", "key", "number", F.col("number").alias("last"), F.col("place").alias("low"), F.col("place").alias("high"), "words", "first")
    linked = _later(lines.filter("pair is not null").select("id", "number", "pair"), "pair").select("id", F.col("number").alias("last"), F.lit(True).alias("linked"))
    pieces = whole.select(*single.columns).unionByName(single).dropDuplicates(["id", "low"]).join(linked.distinct(), ["id", "last"], "left")
    in_text = Window.partitionBy("id").orderBy("low")
    fresh = F.coalesce((F.lag("high").over(in_text) != F.col("low") - 1) | F.lag("linked").over(in_text).isNull(), F.lit(True))
    runs = pieces.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(in_text))
    total = F.sum("words").over(Window.partitionBy("id", "run"))
    return runs.withColumn("total", total).filter(F.col("total") > min_words).select("id", "number", "last", "run", "key", F.col("first.id").alias("first_id"), F.col("first.number").alias("first_number"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Remove passages of more than ``min_words`` words that an earlier document or place has.

    Texts are cut at line feeds into content-defined chunks of several lines
    (``line_chunks``); chunks, then lines, that have an earlier occurrence make
    the runs to remove (``repeated_lines``), and go where their bytes equal those
    of the first occurrence. Only documents with such runs are shuffled, told
    apart by a Bloom filter; the others pass straight through. A passage that a
    third of all documents have is pre-aggregated, and its bytes are dealt to
    parts of ``SPLIT`` removals.

    Returns every input row with all its columns, ``text_col`` without the
    removed lines (empty if all went). Null texts and rows with a null id stay
    as they are. Rows repeating an id and its text count as one document; with
    unlike texts they are documents of their own, in the order of a hash of the
    text. An empty table gives an empty result. Columns may have any names.
    """
    columns = docs.columns
    id_col, text_col = (f"c{columns.index(c)}" for c in (id_col, text_col))
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    # What a document is known by: its id and a hash of its text.
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    keyed = docs.withColumn("__id", F.when(F.col(id_col).isNotNull() & F.col(text_col).isNotNull(), own))
    texts = keyed.filter("__id is not null").select(F.col("__id").alias("id"), F.col(text_col).alias("text"))
    remove = stored(repeated_lines(texts, min_words), "line-removals")
    n = remove.count()

    sources = remove.select(F.col("first_id").alias("id"), F.col("first_number").alias("number"), (F.col("first_number") + F.col("last") - F.col("number")).alias("last"), "key").distinct()
    named = sources.groupBy("id").agg(F.collect_list(F.struct("number", "last", "key")).alias("units"))
    holding, _ = bloom.split_by_keys(texts, "id", sources.select("id").distinct(), n)
    first_texts = _texts_of(holding.join(named, "id").dropDuplicates(["id"]).select("text", "units"))

    parts = F.ceil(F.col("c") / SPLIT)
    counts = stored(remove.groupBy("key").agg(F.count("*").alias("c")), "line-removal-counts")
    dealt = join_groups(remove.select("id", "number", "last", "run", "key"), counts, ["key"], "c", n).withColumn("part", F.pmod(F.xxhash64("id"), parts))
    copies = first_texts.join(counts, "key").select("key", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    compared = dealt.join(copies, ["key", "part"])
    gone = compared.groupBy("id").agg(F.collect_list(F.struct("number", "last", "run", "bytes")).alias("__named")).withColumnRenamed("id", "__id")

    touched, untouched = bloom.split_by_keys(keyed, "__id", remove.select(F.col("id").alias("__id")).distinct(), n)
    cleaned = _without(touched.join(gone, "__id", "left"), docs.schema, text_col)
    return untouched.drop("__id").unionByName(cleaned).toDF(*columns)
