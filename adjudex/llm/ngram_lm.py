"""N-gram language model in sharded Elias-Fano tries, built and queried in Spark.

Texts are tokenised once into chunks that stay where they are. For each level,
a chunk asks for its distinct n-grams: they go to shards by their context, a
hot context's by word too, with their training counts. A shard adds the counts
up, writes its trie level, and answers each chunk from it. What is shuffled are
distinct n-grams of chunks, never token streams, and no n-gram is in more than
one row a chunk, however frequent.

Probabilities are smoothed with a Dirichlet prior: p(w | h) = (c(hw) + m p(w |
h')) / (c(h) + m), where h' is h without its first word and p(w) = (c + 0.5) /
(N + 0.5 (V + 1)). A word not seen after h has the back-off weight m / (c(h) +
m) times p(w | h'), which the trie holds for each context. Both are quantised on
a logarithmic scale. All contexts seen in training count; ``least`` may be
raised to leave out rare ones, which then back off fully.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .common import shared_dir, stored
from .elias_fano import TrieLevel, pack, pack_sorted, unpack, unpack_sorted

#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
#: Least log10 of a quantised probability.
FLOOR = -16.0


@dataclass(frozen=True)
class Settings:
    """``mass`` and ``least`` are for levels 2, 3, ...: m of the prior, and the training count that a context needs."""

    order: int = 3
    mass: tuple[float, ...] = (12.0, 4.0)
    least: tuple[int, ...] = (1, 1)
    bits: int = 12
    chunk_words: int = 1 << 20
    shard_tokens: int = 1 << 21
    hot_context: int = 1 << 21
    held_out_of: int = 5
    held_out_is: int = 1


def _quantise(log10: np.ndarray, bits: int) -> np.ndarray:
    top = (1 << bits) - 1
    return np.clip(np.rint(log10 / FLOOR * top), 0, top).astype(np.int64)


def _dequantise(codes: np.ndarray, bits: int) -> np.ndarray:
    return codes * (FLOOR / ((1 << bits) - 1))


def tokenised(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """(chunk, n, train, data): about ``chunk_words`` tokens of whole texts a row, as numbers into the chunk's own vocabulary, the most frequent first."""
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def row(number: int, ids: list, words: list, counts: list) -> pa.RecordBatch:
        hashes, size = np.concatenate(words), np.concatenate(counts)
        vocabulary, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % s.held_out_of == s.held_out_is for i in ids], bool)
        data = {
            "id": np.array([i or 0 for i in ids], np.int64).tobytes(),
            "no_id": pack(np.array([i is None for i in ids])),
            "held": pack(held),
            "size": pack(size),
            "word": vocabulary[order].tobytes(),
            "token": pack(rank[place]),
        }
        chunk = TaskContext.get().partitionId() << 24 | number
        return pa.RecordBatch.from_pylist([{"chunk": chunk, "n": len(hashes), "train": int(size[~held].sum()), **data}], _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, words, counts = 0, 0, [], [], []
        for batch in batches:
            for a, b in ts.slices(batch.column("text")):
                hashes, first = ts.words_of(batch.column("text").slice(a, b - a))
                size = np.diff(first) + 1
                tokens = np.full(len(hashes) + b - a, END, np.uint64)
                tokens[np.arange(len(hashes)) + np.repeat(np.arange(b - a), size - 1)] = hashes
                ids += batch.column("id").slice(a, b - a).to_pylist()
                words.append(tokens)
                counts.append(size)
                held += len(tokens)
                if held >= s.chunk_words:
                    yield row(number, ids, words, counts)
                    number, held, ids, words, counts = number + 1, 0, [], [], []
        if ids:
            yield row(number, ids, words, counts)
        ts.release()

    return kept.mapInArrow(run, _spark(_CHUNK))


_CHUNK = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("train", pa.int64()), ("id", pa.binary()), ("no_id", pa.binary()), ("held", pa.binary()), ("size", pa.binary()), ("word", pa.binary()), ("token", pa.binary())])
_ASK = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("data", pa.list_(pa.binary()))])
#: kind 0: an answer to a chunk; kind 1: a shard's level and its number of n-grams.
_ANSWER = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("known", pa.int64()), ("data", pa.list_(pa.binary()))])


_MODEL = pa.schema([("level", pa.int32()), ("shard", pa.int64()), ("known", pa.int64()), ("data", pa.list_(pa.binary()))])


def _spark(schema: pa.Schema) -> T.StructType:
    kinds = {pa.int64(): T.LongType(), pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType(), pa.list_(pa.binary()): T.ArrayType(T.BinaryType()), pa.float64(): T.DoubleType(), pa.bool_(): T.BooleanType()}
    return T.StructType([T.StructField(f.name, kinds[f.type]) for f in schema])


def _words_asked(chunk: dict, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of a chunk's words, by shard."""
    word = np.frombuffer(chunk["word"], np.uint64)
    of = (word % np.uint64(shards)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(shards + 1))
    for shard in range(shards):
        if cuts[shard] < cuts[shard + 1]:
            yield shard, order[cuts[shard] : cuts[shard + 1]]


class _State:
    """What a chunk knows of its tokens after the levels answered so far."""

    def __init__(self, chunk: dict, answers: dict[int, dict[int, list[bytes]]], shards: int, train_tokens: int, known_words: int, s: Settings):
        self.s, self.shards = s, shards
        self.chunk = chunk
        self.size = unpack(chunk["size"])
        self.token = unpack(chunk["token"])
        self.trained = np.repeat(unpack(chunk["held"]) == 0, self.size)
        place = np.arange(len(self.token)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.place = place
        n_words = len(chunk["word"]) // 8
        count, number = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
        for shard, places in _words_asked(chunk, shards):
            got = answers[1][shard]
            count[places] = unpack(got[0])
            rank = unpack(got[1])
            number[places] = np.where(rank > 0, (rank - 1) * shards + shard + 1, 0)
        self.word_count = count
        # Words in the order of their numbers; those that training doesn't have are one word, numbered 0.
        known = np.flatnonzero(number)
        known = known[np.argsort(number[known])]
        self.word_rank, self.numbers = np.zeros(n_words, np.int64), np.append(0, number[known])
        self.word_rank[known] = np.arange(1, len(known) + 1)
        base = np.log10((count + 0.5) / (train_tokens + 0.5 * (known_words + 1)))
        self.base = base[self.token]
        self.score = self.base.copy()
        #: For each token, the number (from 1; 0: none) and count of the n-gram that ends with it.
        self.gram, self.gram_count = number[self.token], count[self.token]

    def grams(self, level: int) -> tuple[np.ndarray, ...]:
        """The distinct n-grams of a level: (a row of ``valid``, context, word, context's count) of each, by context and word, and where shards begin in ``order``."""
        s = self.s
        before = np.zeros_like(self.gram)
        seen = np.zeros_like(self.gram)
        before[1:], seen[1:] = self.gram[:-1], self.gram_count[:-1]
        self.valid = np.flatnonzero((self.place >= level - 1) & (before > 0) & (seen >= s.least[level - 2]))
        rows = self.valid
        context, _, local = _distinct(before[rows])
        gram, first, self.inverse = _distinct(local * len(self.numbers) + self.word_rank[self.token[rows]])
        own, word = context[gram // len(self.numbers)], self.numbers[gram % len(self.numbers)]
        n_own = seen[rows][first]
        pieces = 1 + n_own // s.hot_context
        shard = (ts.mix(own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (word % pieces).astype(np.uint64)) % np.uint64(self.shards)).astype(np.uint16 if self.shards <= 1 << 16 else np.int64)
        self.order = np.argsort(shard, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=self.shards)))
        return first, own, word, n_own, cuts

    def asked(self, level: int) -> Iterator[tuple[int, dict]]:
        """The distinct n-grams of a level by shard."""
        first, own, word, n_own, cuts = self.grams(level)
        trained = np.bincount(self.inverse, weights=self.trained[self.valid], minlength=len(own)).astype(np.int64)
        prior = _quantise(self.score[self.valid][first], self.s.bits)
        for k in range(self.shards):
            part = self.order[cuts[k] : cuts[k + 1]]
            if len(part):
                yield k, {"context": own[part], "word": word[part], "count": n_own[part], "trained": trained[part], "prior": prior[part]}

    def take(self, level: int, answers: dict[int, list[bytes]]) -> None:
        """Raise the level of all tokens by the answers of its shards."""
        s = self.s
        *_, cuts = self.grams(level)
        n = len(self.order)
        code, number, count = (np.zeros(n, np.int64) for _ in range(3))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            got = answers[k]
            part = self.order[cuts[k] : cuts[k + 1]]
            code[part] = unpack(got[0])
            place, counts = unpack(got[1]), unpack(got[2])
            more = place > 0
            number[part] = np.where(more, (place - 1) * self.shards + k + 1, 0)
            count[part[more]] = counts
        found = code[self.inverse]
        # An even code is the context's back-off weight, an odd one the n-gram's probability.
        self.score[self.valid] = _dequantise(found >> 1, s.bits) + np.where(found & 1, 0.0, self.score[self.valid])
        gram, gram_count = np.zeros_like(self.gram), np.zeros_like(self.gram_count)
        rows = self.valid
        gram[rows], gram_count[rows] = number[self.inverse], count[self.inverse]
        self.gram, self.gram_count = gram, gram_count


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                trained = np.repeat(unpack(chunk["held"]) == 0, unpack(chunk["size"]))
                word = np.frombuffer(chunk["word"], np.uint64)
                count = np.bincount(unpack(chunk["token"])[trained], minlength=len(word))
                rows = [{"shard": k, "chunk": chunk["chunk"], "data": [word[p].tobytes(), pack(count[p])]} for k, p in _words_asked(chunk, shards)]
                yield pa.RecordBatch.from_pylist(rows, _ASK)

    return run


def _answer_words(s: Settings, keep: bool):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = table.select(["chunk", "data"]).to_pylist()
        words = [np.frombuffer(r["data"][0], np.uint64) for r in rows]
        every, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([unpack(r["data"][1]) for r in rows])).astype(np.int64)
        known = np.flatnonzero(total)
        # The more frequent a word is, the smaller is its number.
        order = known[np.lexsort((every[known], -total[known]))]
        rank = np.zeros(len(every), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        out, at = [], 0
        for r, w in zip(rows, words):
            own = inverse[at : at + len(w)]
            at += len(w)
            out.append({"kind": 0, "level": 1, "shard": shard, "chunk": r["chunk"], "known": 0, "data": [pack(total[own]), pack(rank[own])]})
        level = [every[known].tobytes(), pack(rank[known]), pack(total[known])]
        out.append({"kind": 1, "level": 1, "shard": shard, "chunk": -1 - shard, "known": len(known), "data": level if keep else []})
        return pa.Table.from_pylist(out, _ANSWER)

    return run


def _read_state(chunks: pa.Table, answers: pa.Table, upto: int, shards: int, train_tokens: int, known_words: int, s: Settings) -> _State:
    by_level: dict[int, dict[int, list[bytes]]] = {n: {} for n in range(1, upto + 1)}
    for r in answers.select(["level", "shard", "data"]).to_pylist():
        by_level[r["level"]][r["shard"]] = r["data"]
    state = _State(chunks.to_pylist()[0], by_level, shards, train_tokens, known_words, s)
    for n in range(2, upto + 1):
        state.take(n, by_level[n])
    return state


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, which of them each value is); numbers from 0, sorted with their places where both fit into one."""
    n = len(values)
    shift = n.bit_length()
    if int(values.max(initial=0)).bit_length() + shift < 63:
        packed = np.sort((values << shift) | np.arange(n))
        order, ordered = packed & ((1 << shift) - 1), packed >> shift
    else:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def _pair_order(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The order by context, then word; as one number where they fit into it."""
    shift = int(word.max(initial=0)).bit_length()
    if int(context.max(initial=0)).bit_length() + shift < 63:
        return np.argsort((context << shift) | word)
    return np.lexsort((word, context))


def _ask_grams(level: int, shards: int, train_tokens: int, known_words: int, s: Settings):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunks):
            return _ASK.empty_table()
        state = _read_state(chunks, answers, level - 1, shards, train_tokens, known_words, s)
        chunk = chunks.column("chunk")[0].as_py()
        out = []
        for k, x in state.asked(level):
            first = np.flatnonzero(np.diff(x["context"], prepend=-1))
            data = [pack_sorted(x["context"][first]), pack(x["count"][first]), pack(np.diff(np.append(first, len(x["context"])))), pack(x["word"]), pack(x["trained"]), pack(x["prior"])]
            out.append({"shard": k, "chunk": chunk, "data": data})
        return pa.Table.from_pylist(out, _ASK)

    return run


def _answer_grams(level: int, s: Settings, keep: bool):
    least = s.least[level - 1] if level < s.order else 0
    mass = s.mass[level - 2]

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = table.select(["chunk", "data"]).to_pylist()
        sizes, parts = [], []
        for r in rows:
            d = r.pop("data")
            run_length = unpack(d[2])
            own = (np.repeat(unpack_sorted(d[0]), run_length), unpack(d[3]), np.repeat(unpack(d[1]), run_length), unpack(d[4]).astype(np.int32), unpack(d[5]).astype(np.int16))
            sizes.append(len(own[1]))
            parts.append(own)
        context, word, count, train, prior = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = _pair_order(context, word)
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]
        total = np.bincount(group, weights=train, minlength=len(one)).astype(np.int64)
        asked_context, asked_word = context[one], word[one]
        seen = np.flatnonzero(total)
        c, w, n, known = asked_context[seen], asked_word[seen], count[one[seen]], total[seen]
        p = np.log10((known + mass * 10 ** _dequantise(prior[one[seen]], s.bits)) / (n + mass))
        edge = np.flatnonzero(np.diff(asked_context, prepend=-1))
        weight = _quantise(np.log10(mass / (count[one[edge]] + mass)), s.bits)
        data = TrieLevel.write(c, w, _quantise(p, s.bits), weight, s.bits, asked_context[edge])
        del context, word, count, train, prior, order
        # All chunks' n-grams, each once and in order, meet the trie in one pass over its blocks.
        trie = TrieLevel.mapped(data)
        place, number = trie.find(asked_context, asked_word)
        hit = place >= 0
        code = trie.backoff(number) * 2
        code[hit] = trie.code(place[hit]) * 2 + 1
        onward = hit & (total >= least) if least else np.zeros(len(place), bool)
        number = np.where(onward, place + 1, 0)
        out, at = [], 0
        for r, size in zip(rows, sizes):
            g = group[at : at + size]
            at += size
            out.append({"kind": 0, "level": level, "shard": shard, "chunk": r["chunk"], "known": 0, "data": [pack(code[g]), pack(number[g]), pack(total[g[onward[g]]])]})
        out.append({"kind": 1, "level": level, "shard": shard, "chunk": -1 - shard, "known": len(known), "data": [data] if keep else []})
        return pa.Table.from_pylist(out, _ANSWER)

    return run


_SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(level: int, shards: int, train_tokens: int, known_words: int, s: Settings):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(chunks):
            return _SCORED.empty_table()
        state = _read_state(chunks, answers, level, shards, train_tokens, known_words, s)
        first = np.cumsum(state.size) - state.size
        known = (state.word_count > 0)[state.token].astype(np.int64)
        return pa.table(
            {
                "id": pa.array(np.frombuffer(state.chunk["id"], np.int64), mask=unpack(state.chunk["no_id"]) > 0),
                "held_out": pa.array(unpack(state.chunk["held"]) > 0),
                "n_tokens": pa.array(state.size),
                "n_known": pa.array(np.add.reduceat(known, first)),
                "base_score": pa.array(np.add.reduceat(state.base, first)),
                "score": pa.array(np.add.reduceat(state.score, first)),
            },
            _SCORED,
        )

    return run


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings(), keep_model: bool = True) -> tuple[DataFrame, DataFrame]:
    """Train on the documents that aren't held out and score all of them.

    Returns the scores and the model, both stored. Scores: id, ``held_out``
    (crc32 of the id as text, modulo ``held_out_of``, is ``held_out_is``),
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``,
    the sums of log10 probabilities by single words and by the model. Model:
    (level, shard, known, data) of the trie shards; level 1 holds word hashes,
    numbers and quantised probabilities. Without ``keep_model`` a shard's trie
    goes once it has answered, and ``data`` is empty. The bucketed tables of
    chunks and answers are dropped at the end.

    A text's tokens are its words (A-Z as a-z) and one end. Null and empty
    texts have only the end. Rows with a null id are trained on; rows that
    repeat are scored, and counted, each; very long texts make long chunks. With no training tokens every word is
    unknown. An empty table gives empty results. Other columns are ignored.
    """
    s = settings
    spark = docs.sparkSession
    # Chunks and answers are bucketed alike: chunks never move again, answers move once. Their database is in the shared folder.
    database = f"lm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{shared_dir(spark).rstrip('/')}/{database}'")
    try:
        return _score_corpus(docs, id_col, text_col, s, keep_model, f"{database}.chunks", f"{database}.answers")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def _score_corpus(docs: DataFrame, id_col: str, text_col: str, s: Settings, keep_model: bool, chunk_table: str, answer_table: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.bucketBy(buckets, "chunk").sortBy("chunk").format("parquet").mode("append").saveAsTable(name)
        return spark.table(name)

    chunks = save(tokenised(docs, id_col, text_col, s), chunk_table)
    sums = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    shards = max(8, -(-sums["n"] // s.shard_tokens))
    train = sums["train"]

    def answered(asked: DataFrame, function) -> DataFrame:
        return save(asked.groupBy("shard").applyInArrow(function, _spark(_ANSWER)).repartition(buckets, "chunk"), answer_table)

    def with_answers(function, schema: pa.Schema) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(answers.filter("kind = 0").groupBy("chunk")).applyInArrow(function, _spark(schema))

    answers = answered(chunks.mapInArrow(_ask_words(shards), _spark(_ASK)), _answer_words(s, keep_model))
    known = answers.filter("kind = 1 and level = 1").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    for level in range(2, s.order + 1):
        answers = answered(with_answers(_ask_grams(level, shards, train, known, s), _ASK), _answer_grams(level, s, keep_model))
    scores = with_answers(_score(s.order, shards, train, known, s), _SCORED)
    scores = scores.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
    scores = stored(scores, "lm-scores")

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["level"] == 1 and r["data"]:
                    codes = _quantise(np.log10((unpack(r["data"][2]) + 0.5) / (train + 0.5 * (known + 1))), s.bits)
                    r["data"][2] = pack(codes)
                yield pa.RecordBatch.from_pylist([r], _MODEL)

    return scores, stored(answers.filter("kind = 1").select(*_MODEL.names).mapInArrow(probabilities, _spark(_MODEL)), "lm-model")
