"""The trie of conversation prefixes: every distinct sequence of first turns is a node."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, join_groups, stored
from .ordered_rows import numbered, running

#: Turns that a conversation takes from the one its hundred begins with: less than this many.
SHARED = 6
_EMPTY = hashlib.sha256(b"").hexdigest()
#: A node: its depth and 128 bits of digest.
_NODE = ["depth", "p1", "p2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text), places from 0 by turn, null first.

    Null role or text becomes empty. Equal turns are ordered by role, then
    text. Rows with a null conv_id belong to no conversation.
    """
    empty = F.lit("")
    own = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turn = F.col("turn").asc_nulls_first()
    return numbered(own, "conv_id", [turn, F.substring("role", 1, 64)], [turn, F.col("role"), F.col("text")], "place").select("conv_id", "place", "role", "text")


def share_openings(turns: DataFrame, shared: int = SHARED, group: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c: the first h turns of c - c % ``group``, then its own after its first h.

    h is the unsigned CRC-32 of c as decimal text, modulo ``shared``. Returns
    the rebuilt turns (conv_id, depth from 1, role, text) and the conversations
    (conv_id, length), turnless ones included.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = own.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("head"))
    heads = own.select(F.col("conv_id").alias("head"), F.col("n").alias("__has"))
    taken = F.least("h", F.coalesce("__has", F.lit(0)))
    convs = stored(convs.join(heads, "head", "left").select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    # A head gives fewer than ``shared`` turns to fewer than 2 * ``group`` conversations.
    opening = turns.filter(F.col("place") < shared).withColumnRenamed("conv_id", "head").join(convs.select("conv_id", "head", "h"), "head").filter("place < h")
    rest = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place >= h")
    rebuilt = opening.select("conv_id", (F.col("place") + 1).alias("depth"), "role", "text").unionByName(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "role", "text"))
    return rebuilt, convs.select("conv_id", "length")


def prefix_digests(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, chars) of every prefix, the textless one of depth 0 included.

    A digest is the exclusive or of two 64-bit hashes of each (depth, role,
    text), so that a long conversation's can be added up in blocks; ``chars``
    are the code points of the prefix's last text.
    """
    item = turns.select("conv_id", "depth", F.xxhash64("depth", "role", "text").alias("p1"), F.xxhash64(F.lit("again"), "text", "role", "depth").alias("p2"), F.length("text").cast("long").alias("chars"))
    whole = running(item, "conv_id", "depth", {"p1": F.bit_xor, "p2": F.bit_xor}, lambda a, b: a.bitwiseXOR(b))
    zero = F.lit(0).cast("long")
    return whole.unionByName(convs.select("conv_id", *[zero.alias(c) for c in (*_NODE, "chars")]))


def first_owned(prefixes: DataFrame, nodes: DataFrame, convs: DataFrame, n_prefixes: int) -> DataFrame:
    """(conv_id, length, first): the least depth whose node has the conversation as its smallest member, length + 1 if none.

    A member that is smallest of a node is smallest of all nodes below it on
    its own way, so a binary search finds the depth: each round joins one
    prefix of each open conversation with the minima of its digest. The few
    nodes with over a thousandth of all ``n_prefixes`` are broadcast.
    """
    minima = nodes.select(*_NODE, "owner", "n_convs")
    opened, settled = convs.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("hi")), None
    most = convs.agg(F.max("length")).first()[0]
    for _ in range(0 if most is None else int(most + 1).bit_length()):
        asked = opened.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(prefixes.drop("chars"), ["conv_id", "depth"])
        found = join_groups(asked, minima, _NODE, "n_convs", n_prefixes).withColumn("owned", F.col("owner") == F.col("conv_id"))
        hi = F.when(F.col("owned"), F.col("depth")).otherwise(F.col("hi"))
        lo = F.when(F.col("owned"), F.col("lo")).otherwise(F.col("depth") + 1)
        state = stored(found.select("conv_id", "length", lo.alias("lo"), hi.alias("hi")), "owned")
        done = state.filter("lo = hi")
        settled = done if settled is None else settled.unionByName(done)
        opened = state.filter("lo < hi")
    settled = opened if settled is None else settled.unionByName(opened)
    return settled.select("conv_id", "length", F.col("lo").alias("first"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the ids of each node while they stream by in order; only the running digest is held."""
    node, digest, count = None, None, 0
    schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def row(out: list) -> list:
        return [] if node is None else [*out, (*node, digest.hexdigest())]

    for batch in batches:
        out: list = []
        for *key, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != node:
                out = row(out) or out
                node, digest, count = key, hashlib.sha256(), 0
            digest.update(f"{',' if count else ''}{conv}".encode())
            count += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if last := row([]):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*last, strict=True), schema, strict=True)], schema=schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of ``turns`` (conv_id, depth from 1, role, text).

    A node's ``conv_id`` is its smallest member, and nodes with the same one
    are a chain, which hangs below a node of another chain (``parent_conv_id``).
    ``n_leaves`` and ``saved_tokens`` are added up along each chain from its
    end, and a chain's total is added to every node above it that it runs
    through. ``ends_sha256`` digests the members that end at the node.
    Conversations without turns are members of the root only. No conversation,
    no rows. Repeated conversations, of any number, share nodes.
    """
    prefixes = bucketed(prefix_digests(turns, convs), ["conv_id", "depth"], "prefixes")
    members = prefixes.groupBy(*_NODE).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = bucketed(members, _NODE, "nodes")
    n_prefixes = prefixes.count()
    first = stored(first_owned(prefixes, nodes, convs, n_prefixes), "first")

    # Chains hang below the node before their first own one.
    tops = first.filter("first between 1 and length").select("conv_id", F.col("first").alias("top"), (F.col("first") - 1).alias("depth"))
    tops = join_groups(tops.join(prefixes.drop("chars"), ["conv_id", "depth"]), nodes.select(*_NODE, "owner", "n_convs"), _NODE, "n_convs", n_prefixes)
    tops = stored(tops.select("conv_id", "top", F.col("owner").alias("parent"), "depth"), "tops")
    hanging = tops.groupBy(F.col("parent").alias("conv_id"), "depth").agg(F.count("*").alias("n_hanging"))
    parents = tops.select("conv_id", F.col("top").alias("depth"), "parent")

    own = nodes.withColumnRenamed("owner", "conv_id").join(first.select("conv_id", "length"), "conv_id")
    own = own.join(hanging, ["conv_id", "depth"], "left").join(parents, ["conv_id", "depth"], "left")
    children = F.coalesce("n_hanging", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long")
    own = own.select("conv_id", *_NODE, "n_convs", children.alias("n_children"), F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "chars")
    own = own.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")})

    # Bottom-up: along each chain, then each chain's total to the nodes above it.
    chains = stored(running(own, "conv_id", "depth", {"n_leaves": F.sum, "saved_tokens": F.sum}, lambda a, b: a + b, backward=True), "chains")
    totals = chains.join(tops.select("conv_id", F.col("top").alias("depth")), ["conv_id", "depth"]).select("conv_id", F.col("depth").alias("top"), "n_leaves", "saved_tokens")
    above = prefixes.join(totals, "conv_id").filter("depth < top").groupBy(*_NODE).agg(F.sum("n_leaves").alias("up_leaves"), F.sum("saved_tokens").alias("up_saved"))

    ends = prefixes.join(first.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*_NODE, "conv_id")
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = ends.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_end_digests, "depth long, p1 long, p2 long, ends_sha256 string")

    both = chains.join(above, _NODE, "left").join(ends, _NODE, "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.coalesce("up_leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("up_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
