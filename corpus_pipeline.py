"""From raw documents to tokens: the corpus pipeline.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudex.llm.byte_bpe import encode_and_decode
from adjudex.llm.common import small_batches, stored, table
from adjudex.llm.line_dedup import line_dedup
from adjudex.llm.mixing import mix_documents
from adjudex.llm.near_dedup import near_duplicates
from adjudex.llm.toxicity import corpus_chain, score_chain

#: No stage is plain SQL: the chain is fitted, groups are components and tokens are merges.
ORACLE_SQL = None


def aside(docs: DataFrame, *own: str) -> dict[str, str]:
    """Other names for all columns but a stage's ``own``, longer than any, so that none is taken for one that the stage adds."""
    return {c: f"{max(docs.columns, key=len)}_{i}" for i, c in enumerate(docs.columns) if c not in own}


def back(out: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the ``labels`` of ``docs``, doesn't find toxic.

    Null, empty and very long texts are judged as they are; rows that repeat
    are judged each; columns named as the chain's own are kept as they were.
    """
    small_batches(spark)
    chain = corpus_chain(docs, table(spark, sf_dir, "labels"))
    names = aside(docs, "text")
    return back(score_chain(docs.withColumnsRenamed(names), chain).filter("not is_toxic"), docs, names)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents that had words and have none left go."""
    small_batches(spark)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    mark = max(docs.columns, key=len) + "_"  # no column's name, being longer than each
    left = line_dedup(docs.withColumn(mark, has_words)).filter(~F.col(mark) | has_words)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group; rows with a null id stay."""
    small_batches(spark)
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, in the target weights, each document once at most.

    A null text has no tokens; rows that repeat count each.
    """
    small_batches(spark)
    names = aside(docs, "doc_id", "text", "lang", "source")
    return back(mix_documents(docs.withColumnsRenamed(names), 0.9, 1), docs, names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text; a null text counts as empty, other columns go."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Executors hold what earlier stages left, so the tables are smaller than the operator's own and don't outlast a task.
    texts = docs.select("doc_id", "lang", "source", "text")
    both = encode_and_decode(texts, path, public_tokenizers.PATTERN, max_states=80_000, max_pieces=100_000, forget=True)
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", repeated_lines),
    ("near-duplicate groups", near_duplicate_groups),
    ("mixture", mixture),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the ``documents`` table; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
