"""Classifier chain over hashed words: one linear model a category, each fed by the ones before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts

#: Labelled documents that a chain is fitted on, at most.
SAMPLE_ROWS = 8000
#: Words that a category's model may use.
FEATURES = 1024
FOLDS = 5


@dataclass
class Chain:
    """Fitted models. ``words`` are sorted word hashes; model i has a weight for each, then one for the log-odds of each earlier category, then a constant."""

    categories: tuple[str, ...]
    words: np.ndarray
    weights: list[np.ndarray]
    thresholds: list[float]


def _distinct_words(docs: DataFrame) -> DataFrame:
    """(id, words) with the distinct word hashes of (id, text, ...) rows, and the further columns."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words, first = ts.words_of(part.column("text"))
                lists = [np.unique(words[first[i] : first[i + 1]]).view(np.int64) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(lists, pa.list_(pa.int64()))], [*(f.name for f in rest), "words"])
        ts.release()

    return docs.mapInArrow(run, schema)


def _chosen_words(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(..., words) rows with the places of their words among the sorted ``chosen`` hashes instead, without the others."""
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            at = np.searchsorted(chosen, flat)
            hit = at < len(chosen)
            hit[hit] = chosen[at[hit]] == flat[hit]
            before = np.append(0, np.cumsum(hit))[bounds]
            places = pa.ListArray.from_arrays(pa.array((before - before[0]).astype(np.int32)), pa.array(at[bounds[0] : bounds[-1]][hit[bounds[0] : bounds[-1]]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], places], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Ones:
    """A matrix of ones at (row, column) and of some full columns after these, as models of words need it; the ones are by row."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, width: int):
        self.row, self.column, self.n, self.width = row.astype(np.int32), column.astype(np.int32), n, width
        self.full: list[np.ndarray] = []

    @property
    def columns(self) -> int:
        return self.width + len(self.full)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The matrix by a column."""
        z = np.bincount(self.row, weights=w[self.column], minlength=self.n)
        for c, v in zip(self.full, w[self.width :]):
            z += v * c
        return z

    def sums(self, g: np.ndarray) -> np.ndarray:
        """A row by the matrix."""
        return np.append(np.bincount(self.column, weights=g[self.row], minlength=self.width), [c @ g for c in self.full])


def fit_logistic(x: Ones, y: np.ndarray, counts: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (the constant last) of ridge logistic regression, by limited-memory quasi-Newton steps with backtracking.

    Only rows where ``counts`` is true count; so a fold needs no copy of ``x``, of which only the ones are held.
    """
    held = np.ones(len(y)) if counts is None else counts.astype(np.float64)
    penalty = np.full(x.columns + 1, ridge)
    penalty[-1] = 1e-3

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:-1]) + w[-1]
        value = (held * np.logaddexp(0, z)).sum() - (held * z)[y > 0].sum() + 0.5 * (penalty * w * w).sum()
        gap = held * (_sigmoid(z) - y)
        return float(value), np.append(x.sums(gap), gap.sum()) + penalty * w

    w = np.zeros(x.columns + 1)
    value, slope = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d = -slope
        kept = []
        for s, g in reversed(past):
            a = (s @ d) / (s @ g)
            d = d - a * g
            kept.append(a)
        if past:
            s, g = past[-1]
            d = d * (s @ g) / (g @ g)
        else:
            d = d / max(1.0, np.abs(slope).sum())
        for (s, g), a in zip(past, reversed(kept)):
            d = d + (a - (g @ d) / (s @ g)) * s
        size = 1.0
        while size > 1e-6:
            tried, new_slope = loss(w + size * d)
            if tried <= value + 1e-4 * size * (slope @ d):
                break
            size /= 2
        else:
            break
        s, g = size * d, new_slope - slope
        done = value - tried < 1e-7 * max(1.0, abs(value))
        w, value, slope = w + s, tried, new_slope
        if s @ g > 1e-12:
            past = [*past, (s, g)][-8:]
        if done:
            break
    return w


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F-score on out-of-fold probabilities, precision counting twice, in the middle of its gap; 1 where nothing is positive."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    score = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * y.sum())
    score[:-1][p[order][:-1] == p[order][1:]] = -1
    at = int(np.argmax(score))
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Chain:
    """Fit a chain on at most ``sample_rows`` labelled documents, taken in the order of a hash of their ids.

    ``labels`` has the id and a 0/1 column for each category; rows with a null
    are left out, and of an id with several rows a category holds if any says so.
    Of a document id with several rows the text of the least hash is taken.
    A category's words are the ``features`` of the largest
    chi-square among those in five documents or more, counted in Spark. Earlier
    categories enter a model as log-odds: out-of-fold ones in training (folds by
    the hash of the id), the final models' in use. Without labelled documents
    every probability is one half and nothing exceeds the thresholds.
    """
    named = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(categories)]).dropna()
    named = named.groupBy("id").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(len(categories))])
    spread = named.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most sample_rows short rows: a bounded broadcast.
    one = texts.join(F.broadcast(spread), "id").groupBy("id", *[f"c{i}" for i in range(len(categories))]).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # The sample is bounded, so that more tasks than one for 250 rows are more for the driver to keep than they save.
    seen = _distinct_words(one.coalesce(max(1, sample_rows // 250))).cache()
    total = seen.agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(categories))]).first()
    n = total["n"]
    chosen: set[int] = set()
    counts = seen.select(*[f"c{i}" for i in range(len(categories))], F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("d"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(categories))]).filter("d >= 5").cache()
    for i in range(len(categories)):
        pos = total[f"c{i}"] or 0
        if not n or not 0 < pos < n:
            continue
        gap = F.col(f"c{i}") * float(n) - F.col("d") * float(pos)
        chi2 = gap * gap / (F.col("d").cast("double") * (F.lit(float(n)) - F.col("d") + 1) * float(pos) * float(n - pos))
        chosen |= {r["word"] for r in counts.select("word", chi2.alias("x")).orderBy(F.desc("x"), "word").limit(features).collect()}
    words = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS).cast("long"))
    rows = _chosen_words(seen.select(*[f"c{i}" for i in range(len(categories))], fold.alias("fold"), F.xxhash64("id").alias("h"), "id", "words"), words).toArrow()
    counts.unpersist()
    seen.unpersist()

    # In the order of the hash, whatever partitions came first.
    rows = rows.sort_by([("h", "ascending"), ("id", "ascending")])
    lists = rows.column("words").combine_chunks()
    bounds = lists.offsets.to_numpy()
    # One matrix for all models: the words, then the earlier categories' log-odds as they are made.
    x = Ones(np.repeat(np.arange(len(rows)), np.diff(bounds)), lists.values.to_numpy()[bounds[0] : bounds[-1]], len(rows), len(words))
    fold = rows.column("fold").to_numpy()
    weights, thresholds = [], []
    for i in range(len(categories)):
        y = rows.column(f"c{i}").to_numpy().astype(np.float64)
        if not 0 < y.sum() < len(y):
            weights.append(np.zeros(x.columns + 1))
            thresholds.append(1.0)
            x.full.append(np.zeros(len(y)))
            continue
        out = np.full(len(y), y.mean())
        for k in range(FOLDS):
            inside = fold == k
            if inside.any() and 0 < y[~inside].sum() < (~inside).sum():
                w = fit_logistic(x, y, ~inside)
                out[inside] = _sigmoid(x.times(w[:-1])[inside] + w[-1])
        weights.append(fit_logistic(x, y))
        thresholds.append(_best_threshold(out, y))
        x.full.append(_log_odds(out))
    del rows, lists, x
    ts.release()
    return Chain(tuple(categories), words, weights, thresholds)


def chain_probabilities(chain: Chain, texts: pa.Array) -> np.ndarray:
    """A row of probabilities for each text."""
    hashes, first = ts.words_of(texts)
    n, w = len(texts), len(chain.words)
    text = np.repeat(np.arange(n), np.diff(first))
    if w:
        slots = np.zeros(1 << 16, bool)
        slots[(chain.words >> np.uint64(48)).astype(np.int64)] = True
        maybe = slots[(hashes >> np.uint64(48)).astype(np.int64)]
        hashes, text = hashes[maybe], text[maybe]
        at = np.minimum(np.searchsorted(chain.words, hashes), w - 1)
        hit = chain.words[at] == hashes
        pairs = np.unique(text[hit] * w + at[hit])
        text, at = pairs // w, pairs % w
    else:
        text = at = np.zeros(0, np.int64)
    out = np.zeros((n, len(chain.categories)))
    for i, weight in enumerate(chain.weights):
        z = np.bincount(text, weights=weight[at], minlength=n)[:n] + weight[-1]
        for j in range(i):
            z = z + weight[w + j] * _log_odds(out[:, j])
        out[:, i] = _sigmoid(z)
    return out


def score_chain(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """Add the probability ``p_<category>`` and the verdict ``is_<category>`` (above the fitted threshold) of each whole text.

    Null text counts as empty. A column of such a name is replaced.
    """
    names = [n for c in chain.categories for n in (prefix + c, f"is_{c}")]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T.DoubleType() if n.startswith(prefix) else T.BooleanType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ts.slices(batch.column(text_col)):
                part = batch.slice(a, b - a)
                p = chain_probabilities(chain, part.column(text_col))
                columns = [c for i, t in enumerate(chain.thresholds) for c in (pa.array(p[:, i]), pa.array(p[:, i] > t))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *names])
        ts.release()

    return kept.mapInArrow(run, schema)


def corpus_chain(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain of the ``labels`` table: low quality first, then toxic."""
    return fit_chain(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ("low_quality", "toxic"))
