"""Exact deduplication behind a two-pass Bloom filter, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import WHITESPACE, join_groups, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """Find rows whose texts are equal once all white space is deleted.

    Each text is read once and reduced to a digest row (id, SHA-256 of the
    normalised text, code points of the original), which is stored. A blocked
    Bloom filter gives each digest a word and a pattern of bits; pass one counts
    these, pre-aggregated, and sets in the filter only what occurs twice. Pass
    two probes it. Only rows that it passes are shuffled by digest, the others
    go straight through as groups of one. Hot groups are pre-aggregated before
    the shuffle, and the largest (1,000 at most) are broadcast to their rows.

    The broadcast filter has at most ``max_blocks`` blocks of 4 KB. As it holds
    repeated patterns only, that suits ten and more times as many rows as its
    bits would; beyond, more of the 48-byte digest rows shuffle, and the result
    stays the same.

    Returns one row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``. The row with the longest original text stays, then the
    smallest id, a null id last. Null text counts as empty. Rows that repeat
    the staying row's id and text length are all ``kept``, since the id names
    them. An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = stored(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.regexp_replace(text, f"{WHITESPACE}+", ""), 256)).alias("sha"), F.length(text).alias("n")),
        "dedup-digest",
    )
    n_rows = digest.count()
    n_blocks = bloom.blocks_for(n_rows, bits_per_row, max_blocks)
    made = bloom.filter_table(bloom.repeated_places(digest, "sha", n_blocks))
    probed = bloom.marked(digest, "sha", made, n_blocks, "maybe")

    alone = probed.filter(~F.col("maybe")).select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    some = probed.filter("maybe").select("id", "sha", "n")
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    groups = stored(some.groupBy("sha").agg(F.count("*").alias("group_size"), first["id"].alias("keep_id")), "dedup-groups")
    shared = join_groups(some.select("id", "sha"), groups, ["sha"], "group_size", n_rows).select("id", "sha", "keep_id", "group_size")
    return alone.unionByName(shared).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
