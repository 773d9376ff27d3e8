"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, stored

#: Leaf plans that are broadcast, at most; more are joined by leaf, the largest leaves apart.
BROADCAST_LEAVES = 100_000
#: The seeded order is cut into slices by its upper bits, then the slice in which a budget ends again.
SHIFTS = (52, 40)

Path = tuple[str, ...]


def _level(nodes: DataFrame, parent: list[str], own: str) -> DataFrame:
    """Divide ``budget`` of each parent among its children by ``weight``, up to ``capacity``: adds ``given``.

    What full children can't take goes to their siblings by weight again, until
    all that is left is given ``level * weight``. In the order of capacity /
    weight, with those before it full, a child sees the level (budget - their
    capacities) / (weights from it on); the level is the greatest of these. It
    is found among slices of that order first, then inside two of them.
    """
    ratio = F.col("capacity") / F.col("weight")
    open_ = nodes.filter("weight > 0 and capacity > 0").withColumn("ratio", ratio).withColumn("slice", F.floor(F.log2("ratio") * 64))
    sums = open_.groupBy(*parent, "budget", "slice").agg(F.sum("capacity").alias("capacity"), F.sum("weight").alias("weight"))

    def levels(rows: DataFrame, order: list[str], full: Column, onward: Column) -> DataFrame:
        by = Window.partitionBy(*parent)
        up = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        on = by.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        before = full + F.coalesce(F.sum("capacity").over(up), F.lit(0.0))
        weights = onward + F.sum("weight").over(on)
        return rows.withColumns({"before": before, "weights": weights}).withColumn("level", (F.col("budget") - F.col("before")) / F.col("weights"))

    sliced = stored(levels(sums, ["slice"], F.lit(0.0), F.lit(0.0)), "mix-slices")
    peak = sliced.groupBy(*parent).agg(F.max_by("slice", "level").alias("peak"), F.sum("capacity").alias("capacities"))
    near = sliced.join(peak, parent)
    # The slice of the greatest level and the one before it.
    near = near.filter("slice <= peak").withColumn("place", F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("slice")))).filter("place <= 2")
    # What is full before both, and the weights after both.
    edge = near.groupBy(*parent).agg(F.min("before").alias("full"), (F.min("weights") - F.min_by("weight", "weights")).alias("onward"), F.min("slice").alias("low"), F.max("slice").alias("high"), F.max("capacities").alias("capacities"))
    inside = levels(open_.join(edge, parent).filter(F.col("slice").between(F.col("low"), F.col("high"))), ["ratio", own], F.col("full"), F.col("onward"))
    best = inside.groupBy(*parent).agg(F.max("level").alias("level"), F.max("capacities").alias("capacities"))
    takes = F.when(F.col("budget") >= F.col("capacities") * (1 - 1e-12), F.col("capacity")).otherwise(F.least("capacity", F.greatest(F.lit(0.0), F.col("level")) * F.col("weight")))
    given = F.when((F.col("weight") > 0) & (F.col("capacity") > 0), takes).otherwise(0.0)
    return nodes.join(best, parent, "left").withColumn("given", F.coalesce(given, F.lit(0.0)))


def leaf_budgets(leaves: DataFrame, names: list[str], weights: Mapping[Path, float], total: float, max_epochs: int) -> DataFrame:
    """``leaves`` (a row for each leaf: its path in ``names``, ``n`` tokens) with ``budget`` tokens for each.

    Going down from the root, each node divides its budget among its children by
    their weights (``weights`` by path; a child without one gets its share of
    the supply). A child takes ``max_epochs`` times its supply at most; a
    shortage goes to its siblings first, and to those of an ancestor only as far
    as the whole subtree is short, since a node is never given more than its
    leaves can take. Levels are planned in the cluster, however many leaves.
    """
    spark = leaves.sparkSession
    supply = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    above = spark.createDataFrame([(0, float(min(total, supply * max_epochs)), float(supply))], "root int, given double, held double")
    rooted = leaves.withColumn("root", F.lit(0))
    for d in range(1, len(names) + 1):
        path, parent = names[:d], ["root", *names[: d - 1]]
        nodes = rooted.groupBy("root", *path).agg(F.sum("n").cast("double").alias("held"))
        nodes = nodes.join(above.select(*parent, F.col("given").alias("budget"), F.col("held").alias("of")), parent)
        named = [(*p, float(w)) for p, w in weights.items() if len(p) == d]
        asked = spark.createDataFrame(named, ", ".join([*(f"{n} string" for n in path), "asked double"]))
        # The caller's own table of weights.
        nodes = nodes.join(F.broadcast(asked), path, "left")
        weight = F.coalesce("asked", F.try_divide("held", "of"), F.lit(0.0))
        nodes = nodes.select("root", *path, "held", "budget", weight.alias("weight"), (F.col("held") * max_epochs).alias("capacity"))
        above = stored(_level(nodes, parent, path[-1]).select("root", *path, "held", "given"), "mix-budgets")
    return leaves.join(above.select(*names, F.col("given").alias("budget")), names)


def _order_key(id_col: str, seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed), epoch)


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[Path, float],
    share: float = 1.0,
    max_epochs: int = 4,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Select documents so that their tokens meet the weights of a tree of sources.

    ``levels`` names the tree's levels (domain, language, source) and the columns
    that give them (null counts as an empty name); the budget is ``share`` of all
    tokens, where a token is a word. ``leaf_budgets`` divides it. A leaf gives
    whole epochs, then of one more epoch the longest prefix, in an order seeded
    by epoch and id, whose tokens fit what is left.

    The prefix's end is found in the cluster: token sums of slices of each
    leaf's order, of slices of the slice in which the budget ends, then a running
    sum inside one of those. The plan, a row for each leaf, is broadcast if it
    has ``BROADCAST_LEAVES`` rows at most; otherwise it is joined by leaf, and
    only rows of small leaves are shuffled for that.

    Returns the selected rows with all their columns, ``epoch`` (from 0) and
    ``n_tokens``, once for each epoch; columns of such names are replaced. Rows
    with equal ids and leaves go in or stay out together. Null, empty and blank
    texts take no budget: a leaf of such texts alone is taken once. An empty
    table gives an empty result.
    """
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    names = [f"{mark}l{i}" for i in range(len(levels))]
    path = {n: F.coalesce(c.cast("string"), F.lit("")) for c, n in zip(levels.values(), names)}
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stored(docs.select(*[c.alias(n) for n, c in path.items()], F.col(id_col).alias("id"), tokens.alias("n")), "mix-sizes")
    leaves = stored(sized.groupBy(*names).agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "mix-leaves")
    totals = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("leaves")).first()

    def by_leaf(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """Inner join of rows with one row a leaf."""
        return rows.join(F.broadcast(plan), names) if totals["leaves"] <= BROADCAST_LEAVES else join_groups(rows, plan, names, f"{mark}rows", totals["rows"])

    budgets = leaf_budgets(leaves, names, weights, share * totals["n"], max_epochs)
    # A hair above, so that a whole number of epochs isn't missed by rounding.
    budget, n = F.floor(F.col("budget") + 1e-6), F.col("n")
    whole = F.when(n > 0, F.least(F.lit(max_epochs).cast("long"), F.floor(F.try_divide(budget, n)))).otherwise(min(1, max_epochs)).cast("int")
    planned = budgets.select(*names, F.col("rows").alias(f"{mark}rows"), n, budget.alias("budget"), whole.alias(f"{mark}whole"))
    rest = F.when((F.col(f"{mark}whole") < max_epochs) & (n > 0), F.col("budget") - F.col(f"{mark}whole") * n).otherwise(0)
    planned = stored(planned.select(*names, f"{mark}rows", f"{mark}whole", rest.cast("long").alias(f"{mark}rest")), "mix-plan")

    inside = by_leaf(sized, planned).filter(F.col(f"{mark}rest") > 0).select(*names, "n", F.col(f"{mark}rest").alias("rest"), _order_key("id", seed, F.col(f"{mark}whole")).alias("key"), F.lit(0).cast("long").alias("before"))
    last = None
    for shift in SHIFTS:
        sums = inside.groupBy(*names, "rest", "before", F.shiftright("key", shift).alias("slice")).agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*names).orderBy("slice")
        running = sums.withColumn("start", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        # The slice in which the budget ends, and the tokens before it.
        ends = running.filter("start <= rest").groupBy(*names).agg(F.max_by(F.struct("slice", F.col("start").alias("before")), "slice").alias("e"))
        last = stored(ends.select(*names, "e.slice", "e.before"), "mix-ends")
        held = inside.drop("before").withColumn("slice", F.shiftright("key", shift))
        inside = held.join(F.broadcast(last) if totals["leaves"] <= BROADCAST_LEAVES else last, [*names, "slice"])
    total = F.col("before") + F.sum("n").over(Window.partitionBy(*names).orderBy("key"))
    # The first key that no longer fits, or past the slice's end where all of it fits.
    over = inside.withColumn("total", total).filter("total > rest").groupBy(*names).agg(F.min("key").alias("stop"))
    stops = last.join(over, names, "left").select(*names, F.col("slice").alias(f"{mark}slice"), F.col("stop").alias(f"{mark}stop"))
    ends = stored(planned.join(stops, names, "left"), "mix-stops")

    kept = [c for c in docs.columns if c.lower() not in ("epoch", "n_tokens")]
    marked = by_leaf(docs.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in path.items()], tokens.alias(f"{mark}n")), ends)
    whole, rest, slice_, stop = (F.col(f"{mark}{c}") for c in ("whole", "rest", "slice", "stop"))
    key = _order_key(id_col, seed, whole)
    here = F.shiftright(key, SHIFTS[-1])
    fits = (here < slice_) | ((here == slice_) & (stop.isNull() | (key < stop)))
    epochs = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.concat(epochs, F.when((rest > 0) & fits, F.array(whole)).otherwise(F.array().cast("array<int>")))
    return marked.select(*[F.col(f"`{c}`") for c in kept], F.explode(epochs).alias("epoch"), F.col(f"{mark}n").alias("n_tokens"))


def source_domain(source: Column) -> Column:
    """The domain that a source of the ``documents`` table belongs to: its hottest source is the crawl, then by number."""
    number = F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int")
    return F.when(number == 0, "crawl").when(number < 10, "reference").otherwise("community")


#: Target weights of the ``documents`` table: domains, then languages inside each domain; sources by supply.
DOCUMENT_WEIGHTS = {
    ("crawl",): 0.25,
    ("reference",): 0.40,
    ("community",): 0.35,
    **{(d, lang): w for d in ("crawl", "reference", "community") for lang, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))},
}


def mix_documents(docs: DataFrame, share: float, max_epochs: int) -> DataFrame:
    levels = {"domain": source_domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, DOCUMENT_WEIGHTS, share, max_epochs)
