"""Exact top-k inner products by MaxScore over the partitions of a vector table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Queries handed to every task at once, about; more are worked through in turns.
QUERY_BLOCK = 16384
#: Vectors that are scored at once.
BLOCK = 4096


def integer_components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, x as double; null for vectors that are null or hold null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row for each list, filled up with 0 or cut to ``width``."""
    bounds = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(bounds)
    if len(size) and (size == width).all():
        return flat[bounds[0] : bounds[-1]].reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(bounds[-1] - bounds[0]) - np.repeat(bounds[:-1] - bounds[0], size)
    inside = place < width
    out[row[inside], place[inside]] = flat[bounds[0] : bounds[-1]][inside]
    return out


def _distinct(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k different pairs by falling score, then id."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (scores[1:] != scores[:-1]) | (ids[1:] != ids[:-1])
    return scores[new][:k], ids[new][:k]


class Shard:
    """The best k of the vectors seen so far, for each query of a block."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score a block of vectors by MaxScore.

        A term is a dimension in which the query isn't 0; its postings are the
        block's components there, its bound the most that they can add to a
        score. Terms are sorted by the range of what they can add. The last
        ones, whose bounds cannot lift a vector over the threshold (the k-th
        best score so far) unless the first ones bring it near, are not
        essential; they are as many as have bounds of a smaller sum than it. The essential postings are traversed for all vectors, and
        the others are probed, term by term, only for vectors that are still
        competitive. Equal scores stay competitive, for their ids decide.
        """
        if not len(ids):
            return
        postings = np.ascontiguousarray(vectors.T)
        high, low = postings.max(axis=1), postings.min(axis=1)
        widest = float(np.abs(postings).max(initial=0)) * float(np.abs(self.queries).max(initial=0)) * max(1, postings.shape[0])
        # Sums of this size are exact as doubles, which multiply faster.
        exact = postings.astype(np.float64) if widest < 2**53 else postings
        for i, (own, q) in enumerate(zip(self.query_ids, self.queries)):
            scores, found = self.best[i]
            terms = np.flatnonzero(q)
            bound = np.maximum(q[terms] * high[terms], q[terms] * low[terms])
            spread = np.abs(q[terms] * (high[terms] - low[terms]))
            order = np.argsort(-spread, kind="stable")
            terms, bound = terms[order], bound[order]
            rest = np.append(np.cumsum(bound[::-1])[::-1], 0)
            threshold = scores[-1] if len(scores) == self.k else None
            essential = len(terms)
            if threshold is not None:
                if rest[0] < threshold:
                    continue
                below = np.flatnonzero(rest < threshold)
                essential = int(below[0]) if len(below) else len(terms)
            weights = q[terms].astype(exact.dtype)
            part = weights[:essential] @ exact[terms[:essential]] if essential else np.zeros(len(ids), exact.dtype)
            rows = np.arange(len(ids)) if threshold is None else np.flatnonzero(part + rest[essential] >= threshold)
            part = part[rows]
            for j in range(essential, len(terms)):
                if not len(rows):
                    break
                part = part + weights[j] * exact[terms[j], rows]
                near = part + rest[j + 1] >= threshold
                rows, part = rows[near], part[near]
            other = ids[rows] != own
            rows, part = rows[other], part[other]
            if len(rows):
                scores = np.concatenate([scores, part.astype(np.int64)])
                found = np.concatenate([found, ids[rows]])
                best = None
                if len(scores) > 4 * self.k:
                    near = scores >= np.partition(scores, -self.k)[-self.k]
                    best = _distinct(scores[near], found[near], self.k)
                # Repeated rows may leave fewer than k of the nearest.
                if best is None or len(best[0]) < self.k:
                    best = _distinct(scores, found, self.k)
                self.best[i] = best

    def results(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.query_ids, sizes)), pa.array(np.concatenate([f for _, f in self.best])), pa.array(np.concatenate([s for s, _ in self.best]))],
            ["query_id", "vec_id", "score"],
        )


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` rows of the largest integer inner products with each query row.

    ``is_query`` picks the queries among the rows of ``vectors``. Queries go to
    every task in blocks of about ``query_block`` (by a hash of the id), a bound
    on what is broadcast however many there are; each task runs MaxScore over
    its partition's vectors, and the partitions' best are merged. Vectors are
    not shuffled.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, and there are fewer rows where there are fewer candidates. Vectors
    that are null or hold null or non-finite components, and rows with a null
    id, take no part. A row with the query's id is never its candidate.
    Components that a shorter vector lacks count as 0. Rows repeating an id and
    its vector count once; of a query id with several vectors, the least is
    asked for. Other columns are ignored.
    """
    parts = vectors.select(F.col(id_col).cast("long").alias("id"), integer_components(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    ready = stored(parts, "vectors")
    queries = stored(ready.filter("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    spark = vectors.sparkSession

    def shard_of(block: int) -> DataFrame:
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")) == block).orderBy("id").toArrow()
        ids = own.column("id").to_numpy()
        lists = own.column("v").combine_chunks()
        width = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
        asked = spark.sparkContext.broadcast((ids, _matrix(lists, width), width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, width = asked.value
            shard = Shard(ids, matrix, k)
            held_ids, held, n = [], [], 0
            for batch in batches:
                held_ids.append(batch.column("id").to_numpy())
                held.append(_matrix(batch.column("v"), width))
                n += len(batch)
                if n >= BLOCK:
                    shard.add(np.concatenate(held_ids), np.concatenate(held))
                    held_ids, held, n = [], [], 0
            if n:
                shard.add(np.concatenate(held_ids), np.concatenate(held))
            if len(ids):
                yield shard.results()

        found = ready.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        return found if blocks == 1 else stored(found, "top-k")

    every = reduce(DataFrame.unionByName, [shard_of(b) for b in range(blocks)]).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
