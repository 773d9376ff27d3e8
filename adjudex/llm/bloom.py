"""Blocked Bloom filters made of built-in SQL functions only.

A key has one 64-bit word and a pattern of up to four bits in it, so a probe
reads one word. Two shapes are used:

* a *table* of (block, words) rows, 512 words (4 KB) a block, which is joined by
  block and may have up to ``MAX_BLOCKS`` rows (128 MB);
* an *array* of words in one row, four consecutive words a block and one bit per
  word, for tests of many candidates inside a row (at most 8 MB).
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 512
MAX_BLOCKS = 32768
MAX_WORDS = 1 << 20
_PER_KEY = 4


def blocks_for(n_keys: int, bits_per_key: int = 16, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, ceil(n_keys * bits_per_key / (64 * BLOCK_WORDS))))


def place_of(key: Column, n_blocks: int) -> tuple[Column, Column]:
    """(word, pattern): the number of a key's word and its bits in it."""
    one, h = F.lit(1).cast("long"), F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(_PER_KEY)]
    return F.pmod(F.xxhash64(key), F.lit(n_blocks * BLOCK_WORDS).cast("long")), reduce(Column.bitwiseOR, bits)


def block_of(word: Column) -> Column:
    return F.shiftright(word, 9)


def filter_table(places: DataFrame) -> DataFrame:
    """(block, words) of the patterns of (word, pattern) rows; blocks without any bit are left out."""
    by_word = places.groupBy("word").agg(F.bit_or("pattern").alias("bits"))
    inside = F.col("word").bitwiseAND(F.lit(BLOCK_WORDS - 1).cast("long")).cast("int")
    made = by_word.groupBy(block_of(F.col("word")).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(inside, "bits"))).alias("set"))
    every = F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1))
    return made.select("block", F.transform(every, lambda i: F.coalesce(F.element_at("set", i), F.lit(0).cast("long"))).alias("words"))


def places(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    word, pattern = place_of(F.col(key), n_blocks)
    return keys.select(word.alias("word"), pattern.alias("pattern"))


def repeated_places(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(word, pattern) that more than one row has: those of every key that occurs twice, and few others.

    A row gives 16 bytes here, pre-aggregated before they are shuffled.
    """
    return places(keys, key, n_blocks).groupBy("word", "pattern").agg(F.count("*").alias("n")).filter("n > 1").select("word", "pattern")


def may_contain(words: Column, word: Column, pattern: Column) -> Column:
    """Whether all bits of a key are set in its block's ``words`` (null: none set)."""
    own = F.get(words, word.bitwiseAND(F.lit(BLOCK_WORDS - 1).cast("long")).cast("int"))
    return F.coalesce(own.bitwiseAND(pattern) == pattern, F.lit(False))


def marked(df: DataFrame, key: str, made: DataFrame, n_blocks: int, mark: str) -> DataFrame:
    """``df`` with a column that tells whether the filter table ``made`` may hold its ``key``; nothing of ``df`` is shuffled."""
    word, pattern = place_of(F.col(key), n_blocks)
    own = made.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    probed = df.withColumns({"__word": word, "__pattern": pattern}).withColumn("__block", block_of(F.col("__word"))).join(F.broadcast(own), "__block", "left")
    found = F.col(key).isNotNull() & may_contain(F.col("__words"), F.col("__word"), F.col("__pattern"))
    return probed.withColumn(mark, found).drop("__block", "__words", "__word", "__pattern")


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among ``keys``, rows whose ``key`` is not), told apart without a shuffle of ``df``.

    ``keys`` has a column of that name. Null keys are in the second part.
    """
    n_blocks = blocks_for(n_keys)
    told = marked(df, key, filter_table(places(keys, key, n_blocks)), n_blocks, "__maybe")
    return told.filter("__maybe").drop("__maybe"), told.filter("not __maybe").drop("__maybe")


def words_for(n_keys: int, bits_per_key: int = 16, max_words: int = MAX_WORDS) -> int:
    return max(4, min(max_words, 4 * ceil(n_keys * bits_per_key / 256)))


def _word_and_bit(key: Column, n_words: int, i: int) -> tuple[Column, Column]:
    block = F.pmod(F.xxhash64(key), F.lit(n_words // 4).cast("long"))
    bit = F.shiftright(F.xxhash64(key, F.lit(1)), 6 * i).bitwiseAND(F.lit(63).cast("long"))
    return (block * 4 + i).cast("int"), bit.cast("int")


def filter_words(keys: DataFrame, key: str, n_words: int) -> DataFrame:
    """One row, one array of ``n_words`` 64-bit words."""
    one = F.lit(1).cast("long")
    places = F.array(*[F.struct(w.alias("word"), F.call_function("shiftleft", one, b).alias("bits")) for w, b in (_word_and_bit(F.col(key), n_words, i) for i in range(4))])
    made = keys.select(F.explode(places).alias("p")).groupBy("p.word").agg(F.bit_or("p.bits").alias("bits"))
    every = keys.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(made, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def words_may_contain(words: Column, key: Column, n_words: int) -> Column:
    tests = []
    for i in range(4):
        word, bit = _word_and_bit(key, n_words, i)
        tests.append(F.call_function("shiftright", F.get(words, word), bit).bitwiseAND(F.lit(1).cast("long")) == 1)
    return tests[0] & tests[1] & tests[2] & tests[3]
