"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import textscan as ts
from .common import join_groups, stored
from .components import components

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint32(0xFFFFFFFF)
#: Buckets of up to so many members are compared pair by pair, larger ones by pivots, then in tiles.
_SMALL = 48
#: A block of a tile has so many members at most, and about so many shingles.
_BLOCK, _BLOCK_SHINGLES = 256, 1 << 20
#: Times that large buckets are compared with one more pivot each before tiles are made.
_PIVOTS = 1


def distinct_shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's set of ``k``-word shingles in ascending order of hash, text i's at bounds[i]:bounds[i + 1]."""
    words, first = ts.words_of(column)
    h, text = ts.shingle_hashes(words, first, k)
    order = np.argsort((text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(column) + 1))


def super_minhash(h: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, a row of ``m`` values for each set.

    Every element has a pseudorandom permutation of the m places (a Fisher-Yates
    shuffle, drawn step by step) and puts rank j plus a random fraction at its
    j-th place; a place keeps the least value put there. All elements take step
    j together. Values of step j exceed those of earlier steps, so a set whose
    places are all filled has its final signature and its elements stop early.
    """
    n = len(bounds) - 1
    sig = np.full(n * m, _EMPTY, np.uint32)
    text = np.repeat(np.arange(n), np.diff(bounds))
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(h):
            break
        v = ts.mix(h + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        k = (((v & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int16) + np.int16(j)
        place = k.copy()
        for i in range(j - 1, -1, -1):
            # What the earlier swap of i and swaps[i] left at this place.
            other = swaps[i]
            place = np.where(place == other, np.int16(i), np.where(place == i, other, place))
        swaps.append(k)
        value = (v >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
        np.minimum.at(sig, text * m + place, value)
        open_set = (sig.reshape(n, m) == _EMPTY).any(axis=1)
        alive = open_set[text]
        if not alive.all():
            h, text = h[alive], text[alive]
            swaps = [s[alive] for s in swaps]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` places, unlike for unlike bands."""
    n, m = sig.shape
    out = np.zeros((n, m // rows), np.uint64)
    with np.errstate(over="ignore"):
        out += np.arange(1, m // rows + 1, dtype=np.uint64) * _STEP
        for r in range(rows):
            out = ts.mix(out + sig[:, r::rows][:, : m // rows].astype(np.uint64))
    return out


def _prints(h: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set's mixed hashes: a 128-bit hash of the set."""
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(ts.mix(h + np.uint64(s)), dtype=np.uint64)]) for s in (11, 23)]
    return [pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64)) for s in sums]


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, fp1, fp2, bands) of (id, text) rows: set size, a 128-bit hash of the set, and its band keys."""
    names = ["id", "n", "fp1", "fp2", "bands"]
    schema = T.StructType([docs.schema["id"], *[T.StructField(x, T.LongType()) for x in names[1:4]], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in ts.slices(texts):
                h, bounds = distinct_shingles(texts.slice(a, b - a), k)
                keys = band_keys(super_minhash(h, bounds, bands * rows), rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), *_prints(h, bounds), lists], names)
        ts.release()

    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, fp1, fp2, set) with the sorted shingle hashes of (id, text) rows."""
    names = ["id", "n", "fp1", "fp2", "set"]
    schema = T.StructType([docs.schema["id"], *[T.StructField(x, T.LongType()) for x in names[1:4]], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in ts.slices(texts):
                h, bounds = distinct_shingles(texts.slice(a, b - a), k)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)), *_prints(h, bounds), lists], names)
        ts.release()

    return docs.mapInArrow(run, schema)


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Sets whose sizes differ too much can't reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets have ``100 * common >= percent * united``."""
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b")


def _tile_links(percent: int):
    """For the rows of a tile: a spanning forest of the links that join different components."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels = table.column("cls").to_numpy(), table.column("label").to_numpy()
        lists = table.column("set").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = lists.offsets.to_numpy()
        flat, size = lists.values.to_numpy(), np.diff(lists.offsets.to_numpy())
        n = len(ids)
        row = np.repeat(np.arange(n), size)
        _, column = np.unique(flat[bounds[0] : bounds[-1]], return_inverse=True)
        common = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = max(1, (16 << 20) // (4 * max(n, 1)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((n, width), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            common += part @ part.T
        united = size[:, None] + size[None, :] - common
        x, y = np.nonzero(np.triu((common * 100 >= united * percent) & (labels[:, None] != labels[None, :]), 1))
        top = {int(v): int(v) for v in labels}

        def find(v: int) -> int:
            while top[v] != v:
                top[v] = top[top[v]]
                v = top[v]
            return v

        out = []
        for i, j in zip(x.tolist(), y.tolist()):
            p, q = find(int(labels[i])), find(int(labels[j]))
            if p != q:
                top[p] = q
                out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return run


def _tiles(members: DataFrame, percent: int, n_rows: int) -> DataFrame:
    """(key, tile, cls, label): each large bucket's members in pairs of blocks whose sets may be alike in size.

    Members are classed by the logarithm of their size, so that sets that can
    be linked lie in one class or in neighbours. Classes are cut into blocks of
    bounded shingles, and a tile has two blocks of one class or of neighbours.
    """
    base = 100.0 / percent
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(base)) + 1e-9).cast("int")
    classed = members.select("key", "cls", "label", size.alias("size"))
    per_block = F.greatest(F.lit(2.0), F.least(F.lit(float(_BLOCK)), F.floor(_BLOCK_SHINGLES / F.pow(F.lit(base), F.col("size") + 1))))
    counted = classed.groupBy("key", "size").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / per_block).cast("int"))
    sizes = stored(counted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("blocks"), F.sum("c").alias("members")), "tile-sizes")
    dealt = join_groups(classed, sizes, ["key"], "members", n_rows)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.element_at("blocks", F.col("size")).cast("long")).cast("int"))
    here, own = F.col("size"), F.col("own")

    def with_blocks(at: Column, tile) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.coalesce(F.element_at("blocks", at), F.lit(0)) - 1, F.lit(0))), lambda o: o < F.coalesce(F.element_at("blocks", at), F.lit(0))), tile)

    def tile(low: Column, high: Column, i: Column, j: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))

    same = with_blocks(here, lambda o: tile(here, here, F.least(own, o), F.greatest(own, o)))
    above = with_blocks(here + 1, lambda o: tile(here, here + 1, own, o))
    below = with_blocks(here - 1, lambda o: tile(here - 1, here, o, own))
    return dealt.select("key", "cls", "label", F.explode(F.concat(same, above, below)).alias("tile"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their word-shingle sets.

    Two documents are linked where ``100 * |A & B| >= percent * |A | B|`` on the
    sets of distinct ``k``-word shingles (A-Z as a-z; a text with fewer words is
    one shingle). Candidates share a band of a SuperMinHash signature; a pair of
    similarity s has none with probability ``(1 - s**rows) ** bands`` (defaults:
    5e-8 at 0.8). Links are confirmed on full sets, of 64-bit hashes of the
    shingles. Documents with equal sets (by a 128-bit hash and the size) form a
    class, so that copies are compared once.

    A bucket is first compared with its smallest member only. If its members
    are then in one component, it is done. In other buckets, members of
    different components are compared: pair by pair in small buckets; in large
    ones with some more pivots, then in tiles of blocks of like size, by
    products of incidence matrices. So no group's pairs are all listed, and none
    that could join components is left out.

    Returns one row per input row: id, ``n_shingles``, ``component_id`` (smallest
    id reachable) and ``kept`` (whether that is the row's own). Empty, blank or
    null texts have the empty set and are linked with nothing: such a row is its
    own component. Null ids take no part in links and are their own (null)
    component, kept. Rows repeating an id are one document: the classes of its
    texts are tied together. Ids must be integers; other columns are ignored. An
    empty table gives an empty result.
    """
    same = ["fp1", "fp2", "n"]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(texts, k, bands, rows), "signatures")
    n_rows = signed.count()
    usable = signed.filter("n > 0 and id is not null").select("id", *same, "bands")
    classes = usable.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()

    ends = [x for c in same for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    several = usable.groupBy("id").agg(*ends).filter(" or ".join(f"lo_{c} < hi_{c}" for c in same)).select("id")
    held = stored(usable.select("id", *same).join(several, "id").distinct().join(classes.select(*same, "cls"), same).select("id", "cls"), "shared-ids")
    star = stored(held.groupBy("id").agg(F.min("cls").alias("a"), F.count("*").alias("c")), "shared-id-firsts")
    ties = join_groups(held, star, ["id"], "c", n_rows).filter("cls <> a").select("a", F.col("cls").alias("b"))

    placed = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = stored(placed.groupBy("key").agg(F.count("*").alias("c"), F.min_by(F.struct("cls", "n"), "cls").alias("first")).filter("c > 1"), "shared-bands")
    buckets = stored(join_groups(placed, shared, ["key"], "c", n_classes * bands).select("key", "cls", "n", "c", F.col("first.cls").alias("first"), F.col("first.n").alias("first_n")), "buckets")

    # Sets of one document for each class that has company; texts are not shuffled for them.
    wanted = stored(classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("id"), *same, "cls"), "wanted-sets")
    holding, _ = bloom.split_by_keys(texts, "id", wanted.select("id").distinct(), wanted.count())
    every_set = shingle_sets(holding, k).dropDuplicates(["id", *same])
    sets = stored(every_set.join(wanted, ["id", *same]).select("cls", "set"), "sets")

    stars = buckets.filter("cls <> first").filter(_sizes_fit(F.col("n"), F.col("first_n"), percent)).select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    links = stored(ties.unionByName(_verified(stars, sets, percent)), "star-links")

    def still_open(known: DataFrame, held_by: DataFrame) -> DataFrame:
        """Rows of buckets whose members are in more than one component, with their labels."""
        labels = components(known).withColumnRenamed("id", "cls")
        labelled = held_by.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "cls").alias("of_first"), F.count("*").alias("members")).filter("lo < hi"), "mixed-buckets")
        return stored(join_groups(labelled, mixed.select("key", "of_first", "members"), ["key"], "members", n_classes * bands), "open-buckets")

    open_buckets = still_open(links, buckets.filter("c > 2").select("key", "cls", "n", "c"))
    small = open_buckets.filter(F.col("c") <= _SMALL)
    one, two = small.alias("one"), small.alias("two")
    cross = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.cls") < F.col("two.cls")) & (F.col("one.label") != F.col("two.label")) & _sizes_fit(F.col("one.n"), F.col("two.n"), percent))
    pairs = cross.select(F.col("one.cls").alias("a"), F.col("two.cls").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    links = stored(links.unionByName(_verified(pairs, sets, percent)), "pair-links")

    large = open_buckets.filter(F.col("c") > _SMALL)
    for _ in range(_PIVOTS):
        if large.isEmpty():
            break
        # One more pivot: the smallest member that isn't in the first one's component.
        pivots = large.filter("label <> of_first").groupBy("key").agg(F.min_by(F.struct("cls", "n", "label"), "cls").alias("p"), F.max("members").alias("members"))
        asked = join_groups(large.drop("members", "of_first"), stored(pivots, "pivots"), ["key"], "members", n_classes * bands)
        asked = asked.filter("label <> p.label").filter(_sizes_fit(F.col("n"), F.col("p.n"), percent))
        pairs = asked.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()
        links = stored(links.unionByName(_verified(pairs, sets, percent)), "pivot-links")
        large = still_open(links, large.select("key", "cls", "n", "c"))
    if not large.isEmpty():
        tiled = _tiles(large, percent, n_classes * bands).join(sets, "cls").groupBy("key", "tile").applyInArrow(_tile_links(percent), "a long, b long")
        links = stored(links.unionByName(tiled), "tile-links")

    linked = classes.select(*same, "copies", "rep", "cls").join(components(links).withColumnRenamed("id", "cls"), "cls", "left")
    linked = stored(linked.withColumn("label", F.coalesce("label", "cls")), "labelled-classes")
    firsts = stored(linked.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("c")), "component-firsts")
    named = stored(join_groups(linked, firsts, ["label"], "c", n_classes).select(*same, "copies", "component_id"), "named-classes")
    grouped = join_groups(usable.select("id", *same), named, same, "copies", n_rows).select("id", "n", "component_id")
    alone = signed.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return grouped.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
