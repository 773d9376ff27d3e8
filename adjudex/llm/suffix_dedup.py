"""Removal of long byte strings that occur more than once, by buckets of suffixes that are refined level by level.

Every string of ``length`` bytes has one q-gram with the least hash, its first
if several have it, and equal strings have it at the same place. So only the
suffixes at such places (anchors, about one in ``span / 2`` bytes) are sorted
into initial q-gram buckets; the ``span`` strings around an anchor are told
apart by how many bytes they begin before it. One bucket record stands for a
cell of such strings, all of which contain the record's sorted core:

* a bucket with one member settles its whole cell: none of it is repeated;
* members with equal unions of their cell's strings settle too: all of it is;
* every other cell is halved, and each half's bucket is refined by the
  identifier of the bytes at the offset that the half has more in common, next
  to the right or to the left. The refined identifiers are used again for the
  next, halved offset, down to single strings.

A settled class of members leaves one representative behind, so a bucket of
many copies shrinks at once, and no pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .common import bucketed, join_groups, stored

#: Bytes of a string that is removed where it is repeated.
LENGTH = 200
_ID = ["u1", "u2"]
_ANCHOR = pa.schema([(c, pa.int64()) for c in ("u1", "u2", "pos", "gram", "hull")])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_KEPT_SQL = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
#: Classes of a bucket that is refined inside a task; larger buckets are halved by Spark first.
TASK_CLASSES = 10_000
#: Records that a task refines at once, more only for the sake of a whole bucket.
TASK_RECORDS = 4096
#: Bits for a span's width, under its start, in a packed long.
_WIDTH = 24


def cells(length: int) -> int:
    """How many strings an anchor stands for, a power of two: q-grams have ``length - cells + 1`` bytes, over a third of all."""
    return 1 << max(0, (length * 2 // 3).bit_length() - 1)


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """(text, place, q-gram, hull) of the anchors of all strings that begin in ``raw[first:last]`` and lie in one text.

    Texts lie one behind the other at ``starts`` to ``ends``, which may reach
    beyond ``raw`` for a piece of a long text; places are from ``starts``. A
    hull digests the union of an anchor's strings and where it is cut short.
    """
    span = cells(length)
    q, n = length - span + 1, len(raw)
    last = min(last, n - length + 1)
    if last <= first:
        return (np.zeros(0, np.int64),) * 4
    up, down = ts._powers(1 << max(12, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ts.EXACT[raw] * up[:n], out=total[1:])
    grams = ts.mix((total[q:] - total[:-q]) * down[: n - q + 1])

    # The least of each run of ``span`` grams: the lesser of two blocks' running minima.
    bits = np.uint64((1 << n.bit_length()) - 1)
    packed = np.full(-(-len(grams) // span) * span, ~np.uint64(0))
    packed[: len(grams)] = (grams & ~bits) | np.arange(len(grams), dtype=np.uint64)
    blocks = packed.reshape(-1, span)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[first:last], forward[first + span - 1 : last + span - 1])

    fits = np.zeros(last - first + 1, np.int64)
    whole = (ends - starts >= length) & (starts < last) & (ends - length >= first)
    np.add.at(fits, np.maximum(starts[whole], first) - first, 1)
    np.add.at(fits, np.minimum(ends[whole] - length + 1, last) - first, -1)
    owner = (least[np.cumsum(fits[:-1]) > 0] & bits).astype(np.int64)
    at = owner[np.flatnonzero(np.diff(owner, prepend=-1))]
    text = np.searchsorted(starts, at, "right") - 1
    low, high = at - (span - 1), at + length
    a, b = np.maximum(low, starts[text]), np.minimum(high, ends[text])
    clipped = (a - low).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (high - b).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
    hull = ts.mix((total[b] - total[a]) * down[a] + clipped)
    return text, at - starts[text], grams[at].view(np.int64), hull.view(np.int64)


def _texts(raw: np.ndarray, bounds: np.ndarray, length: int, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchors of a batch, some ``size`` bytes at a time; a longer text is taken in overlapping pieces."""
    a, n = 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        low, high = int(bounds[a]), int(bounds[b])
        if b == a + 1 and high - low > 2 * size:
            parts = []
            for begin in range(low, high, size):
                x, y = max(low, begin - length), min(high, begin + size + 2 * length)
                parts.append(anchors(raw[x:y], np.array([low - x]), np.array([high - x]), length, begin - x, begin + size - x))
            place = np.concatenate([p[1] for p in parts])
            # A string at a piece's end and the next piece's first may have the same anchor.
            _, once = np.unique(place, return_index=True)
            yield (np.full(len(once), a), *[np.concatenate([p[k] for p in parts])[once] for k in (1, 2, 3)])
        else:
            text, *rest = anchors(raw[low:high], bounds[a:b] - low, bounds[a + 1 : b + 1] - low, length, 0, high - low)
            yield (text + a, *rest)
        a = b


def _scan(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u1, u2 = (batch[c].to_numpy() for c in _ID)
            for text, *columns in _texts(*ts.text_bytes(batch["body"]), length, size):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (u1[text], u2[text], *columns)], schema=_ANCHOR)
        ts.release()

    return run


def bodies(docs: DataFrame) -> DataFrame:
    """(u1, u2, doc_id, body) of each row: 128 bits that stand for id and text, the id, and the text in UTF-8."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    return rows.select(F.xxhash64("doc_id", "body").alias("u1"), F.xxhash64(F.lit(1), "body", "doc_id").alias("u2"), "doc_id", "body")


def _of_texts(texts: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(texts whose ids may be among ``wanted``, the others), told apart by a Bloom filter, so that only the first need shuffle."""
    keyed = texts.withColumn("uid", F.struct(*_ID))
    some, others = bloom.split_by_keys(keyed, "uid", wanted.select(F.struct(*_ID).alias("uid")).distinct(), n)
    return some.drop("uid"), others.drop("uid")


def _span(start: Column, end: Column) -> Column:
    """A span from ``start``, or 0, to ``end`` as one long."""
    low = F.greatest(start, F.lit(0).cast("long"))
    return (F.shiftleft(low, _WIDTH) + (end - low)).alias("span")


def _contexts(texts: DataFrame, records: DataFrame, length: int) -> DataFrame:
    """(u1, u2, pos, size, context): the bytes of all strings of each record's anchor; only texts that have one are shuffled."""
    span = cells(length)
    asked = records.groupBy(*_ID).agg(F.collect_list("pos").alias("places"))
    low = lambda p: F.greatest(p - (span - 1), F.lit(0))
    cut = F.transform("places", lambda p: F.struct(p.alias("pos"), F.substring(F.col("body"), (low(p) + 1).cast("int"), (p + length - low(p)).cast("int")).alias("context")))
    some, _ = _of_texts(texts.select(*_ID, "body"), records, records.count())
    found = some.join(asked, _ID).select(*_ID, F.octet_length("body").cast("long").alias("size"), F.explode(cut).alias("x"))
    return bucketed(found.select(*_ID, "x.pos", "size", "x.context").dropDuplicates([*_ID, "pos"]), [*_ID, "pos"], "suffix-contexts")


def _halves(records: DataFrame, contexts: DataFrame, length: int, half: int) -> DataFrame:
    """Both halves, of ``half`` strings each, of every record's cell, with refined buckets; halves without a string inside the text go.

    A cell at ``l`` has the strings that begin ``l`` to ``l + 2 * half - 1`` bytes before the anchor.
    """
    span = cells(length)
    p, l, n = F.col("pos"), F.col("l"), F.col("size")
    base = F.greatest(p - (span - 1), F.lit(0))

    def piece(start: Column, end: Column) -> Column:
        return F.substring(F.col("context"), (start - base + 1).cast("int"), (end - start).cast("int"))

    def cell(side: int) -> Column:
        near = l + side * half
        far = near + half - 1
        # What these strings have more in common than the whole cell's: bytes after its core or before it.
        later = piece(p - l - half, p - l) if side else piece(p - l - 2 * half + 1 + length, p - l - half + 1 + length)
        bucket = F.xxhash64("bucket", F.lit(side), later)
        low, high = F.greatest(p - far, F.lit(0)), F.least(p - near + length, n)
        hull = F.xxhash64(bucket, piece(low, high), low - (p - far), (p - near + length) - high)
        inside = F.greatest(near, p + length - n) <= F.least(far, p)
        return F.when(inside, F.struct(near.alias("l"), bucket.alias("bucket"), hull.alias("hull"), low.alias("low"), high.alias("high")))

    both = records.join(contexts, [*_ID, "pos"]).select(*_ID, "pos", "live", F.explode(F.array(cell(0), cell(1))).alias("c"))
    return both.filter("c is not null").select(*_ID, "pos", "live", "c.*")


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Equal rows' common number, by sorting: bucket pointers."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def refined(raw: np.ndarray, at: np.ndarray, pos: np.ndarray, size: np.ndarray, cell: np.ndarray, bucket: np.ndarray, live: np.ndarray, length: int, half: int) -> tuple[np.ndarray, ...]:
    """(record, start, end) of what is repeated of whole buckets' records, whose cells of ``2 * half`` strings begin at ``cell``.

    Record i's context is in ``raw`` from ``at[i]``. As in ``_halves``, with all
    of a level's buckets refined by one sort on (bucket, later identifier), and
    the ranks as the identifiers of the next.
    """
    span = cells(length)
    base = np.maximum(pos - (span - 1), 0)
    up, down = ts._powers(1 << max(12, (len(raw) + 1).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(ts.EXACT[raw] * up[: len(raw)], out=total[1:])

    def identifier(i: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = at[i] + start - base[i], at[i] + end - base[i]
        return ts.mix((total[b] - total[a]) * down[a])

    out: list[tuple[np.ndarray, ...]] = []
    i, l, b, alive = np.arange(len(pos)), cell, bucket, live  # noqa: E741
    while half and len(i):
        i, b, alive = np.tile(i, 2), np.tile(b, 2), np.tile(alive, 2)
        side = np.repeat([0, 1], len(l))
        near = np.concatenate([l, l + half])
        p, n = pos[i], size[i]
        keep = np.maximum(near, p + length - n) <= np.minimum(near + half - 1, p)
        i, b, alive, side, near, p, n = (x[keep] for x in (i, b, alive, side, near, p, n))
        start = np.where(side == 0, p - near - 2 * half + 1 + length, p - near)
        b = _ranks(b, side, identifier(i, start, start + half))
        low, high = np.maximum(p - near - half + 1, 0), np.minimum(p - near + length, n)
        clipped = (low - (p - near - half + 1)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + (p - near + length - high).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        hull = _ranks(b, ts.mix(identifier(i, low, high) + clipped))
        members = np.bincount(hull)[hull] if len(hull) else hull
        found = alive & (members > 1)
        out.append((i[found], low[found], high[found]))
        alone = alive & (members == 1)
        _, first = np.unique(hull, return_index=True)
        classes = np.bincount(b[first], minlength=int(b.max(initial=-1)) + 1)
        some = np.zeros(len(classes), bool)
        some[b[alone]] = True
        first = first[(classes[b[first]] > 1) & some[b[first]]]
        i, l, b, alive = i[first], near[first], b[first], alone[first]  # noqa: E741
        half //= 2
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _refine(length: int, half: int):
    """Refine the buckets of a stream of records in the order of their buckets; emits packed spans."""
    schema = pa.schema([(c, pa.int64()) for c in (*_ID, "span")])

    def spans(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, bounds = ts.text_bytes(part["context"])
        u1, u2, *rest = (part[c].to_numpy() for c in (*_ID, "pos", "size", "l", "bucket"))
        i, low, high = refined(raw, bounds[:-1], *rest, part["live"].to_numpy(zero_copy_only=False), length, half)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u1[i], u2[i], (low << _WIDTH) + (high - low))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) < TASK_RECORDS:
                continue
            whole = pa.concat_batches(held)
            buckets = whole["bucket"].to_numpy()
            # The last bucket may go on in the next batch.
            end = int(np.flatnonzero(np.append(True, buckets != buckets[-1]))[-1])
            if end:
                yield spans(whole.slice(0, end))
            held = [whole.slice(end)]
        if held:
            yield spans(pa.concat_batches(held))
        ts.release()

    return run


def _classes(records: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(records with their class's size ``n``, records that go on) of one level.

    A class is what a bucket's members of one hull are. Buckets go on if they
    have two classes or more, one of them a live record of its own; there, each
    larger class leaves a record that lives no more.
    """
    classes = stored(records.groupBy("bucket", "hull").agg(F.count("*").alias("n"), F.bool_or("live").alias("live")), "suffix-classes")
    sized = stored(join_groups(records, classes.select("bucket", "hull", "n"), ["bucket", "hull"], "n", n_rows), "suffix-sized")
    alone = F.col("live") & (F.col("n") == 1)
    buckets = stored(classes.groupBy("bucket").agg(F.count("*").alias("m"), F.bool_or(alone).alias("any")).filter("m > 1 and any").drop("any"), "suffix-open")
    some, _ = bloom.split_by_keys(sized, "bucket", buckets, buckets.count())
    reps = some.groupBy("bucket", "hull").agg(F.min(F.struct(*_ID, "pos", "l")).alias("one"), F.bool_or(alone).alias("live"))
    return sized, stored(join_groups(reps, buckets, ["bucket"], "m", n_rows).select("one.*", "bucket", "live", "m"), "suffix-records")


def repeated_spans(texts: DataFrame, length: int = LENGTH, size: int = ts.SLICE_BYTES) -> DataFrame:
    """(u1, u2, span): packed spans, some overlapping, of all bytes of ``bodies`` in a string that also begins anywhere else.

    Buckets are 64-bit digests that are refined inside the bucket above, so
    only strings that share a q-gram could ever be taken for each other.
    """
    span = cells(length)
    scan = ", ".join(f"{c} long" for c in _ANCHOR.names)
    every = stored(texts.select(*_ID, "body").mapInArrow(_scan(length, size), scan), "suffix-anchors").withColumnRenamed("gram", "bucket")
    # Initial q-gram buckets; those of one member are settled.
    repeated = stored(every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "suffix-grams")
    n_anchors = every.count()
    members, _ = bloom.split_by_keys(every, "bucket", repeated, repeated.count())
    records = members.select(*_ID, "pos", F.lit(0).cast("long").alias("l"), "bucket", "hull", F.lit(True).alias("live"))
    sized, records = _classes(records, n_anchors)
    spans = sized.filter("n > 1").select(*_ID, _span(F.col("pos") - (span - 1), F.col("pos") + length))

    contexts = _contexts(texts, records, length)
    half = span // 2
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while half and not records.isEmpty():
        small = records.filter(F.col("m") <= TASK_CLASSES).drop("m").join(contexts, [*_ID, "pos"])
        dealt = small.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_refine(length, half), "u1 long, u2 long, span long")
        spans = spans.unionByName(stored(dealt, "suffix-refined"))
        large = records.filter(F.col("m") > TASK_CLASSES).drop("m")
        if large.isEmpty():
            break
        sized, records = _classes(stored(_halves(large, contexts, length, half), "suffix-halves"), n_anchors)
        spans = spans.unionByName(sized.filter("live and n > 1").select(*_ID, _span(F.col("low"), F.col("high"))))
        half //= 2
    return spans


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        packed = batch["packed"]
        values, bounds = packed.values.to_numpy(zero_copy_only=False), packed.offsets.to_numpy()
        for i, body in enumerate(batch["body"]):
            text = body.as_py()
            own = np.sort(values[bounds[i] : bounds[i + 1]])
            if not len(own):
                spans.append([])
                kept.append(text)
                continue
            start = own >> _WIDTH
            end = np.minimum(start + (own & ((1 << _WIDTH) - 1)), len(text))
            reach = np.maximum.accumulate(end)
            new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
            a, b = start[new], reach[np.concatenate([new[1:] - 1, [len(own) - 1]])]
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
        sizes = pa.compute.binary_length(batch["body"]).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, pa.array(spans, _KEPT.field("spans").type), pa.array(kept, pa.binary())], schema=_KEPT)
    ts.release()


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal runs of removed bytes, and the bytes that are left, in order.

    A byte goes if any string of ``length`` bytes that covers it also begins
    anywhere else, in any row, the same one included; strings overlap, and all
    are judged on the input. No string crosses rows. Texts count as UTF-8, a
    null one as empty; shorter ones than ``length`` stay whole, very long ones
    are scanned in overlapping pieces. Rows that repeat, with equal or null
    ids, are texts of their own, so each is a repetition of the other. Other
    columns are ignored. An empty table gives an empty result.
    """
    texts = bodies(docs)
    spans = repeated_spans(texts, length)
    marked, whole = _of_texts(texts, spans, texts.count())
    named = marked.join(spans.groupBy(*_ID).agg(F.collect_list("span").alias("packed")), _ID, "left").select("doc_id", "body", "packed")
    every = named.unionByName(whole.select("doc_id", "body", F.lit(None).cast("array<long>").alias("packed")))
    return every.withColumn("packed", F.coalesce("packed", F.array().cast("array<long>"))).mapInArrow(_remove, _KEPT_SQL)
