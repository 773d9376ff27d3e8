"""URL allow and block lists behind a blocked Bloom filter, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, stored


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there up to ``?``, ``#`` or the end. Both are empty if the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def _suffixes(host: Column) -> Column:
    """The host and its parent domains, as ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_rule: int = 16) -> DataFrame:
    """Judge every url by the longest rule that fits it.

    ``rules`` has (host, path, verdict). A rule fits its host and all
    subdomains where the url's path starts with the rule's path. A listed
    canonical url is host + path; a page's candidates are its host suffixes
    with each prefix of its path whose length some rule has. A blocked Bloom
    filter (a bounded array, tested inside the row) drops nearly all of them;
    the rest meet the rules in an exact hash join, which removes false
    positives, and only pages with a possible hit are joined to its result.

    Ties between fitting rules of one length go to the longer host; of rules
    listed twice, ``block`` wins. Null or malformed urls have an empty host and
    path. No fitting rule: null rule and the ``default`` verdict. Rows that
    repeat are judged each; other columns are ignored.
    """
    listed = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict").filter("r_host is not null")
    listed = listed.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict")).withColumn("key", F.concat_ws("\n", "r_host", "r_path"))
    # A path has at most a few thousand lengths, however long the list is.
    sizes = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).first()
    n_words = bloom.words_for(sizes["n"], bits_per_rule)
    words = stored(bloom.filter_words(listed, "key", n_words), "url-bloom")

    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    lengths = F.array(*[F.lit(x) for x in sizes["lengths"]]).cast("array<int>")

    def keys_of(suffix: Column) -> Column:
        fitting = F.filter(lengths, lambda n: n <= F.length("path"))
        return F.transform(fitting, lambda n: F.concat_ws("\n", suffix, F.substring(F.col("path"), F.lit(1), n)))

    tried = parsed.withColumn("words", words.scalar())
    keys = F.flatten(F.transform(_suffixes(F.col("host")), keys_of))
    tried = tried.withColumn("keys", F.filter(keys, lambda k: bloom.words_may_contain(F.col("words"), k, n_words))).drop("words")

    missed = tried.filter(F.size("keys") == 0).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    possible = tried.filter(F.size("keys") > 0)
    pairs = possible.select("host", "path", "keys").distinct().select("host", "path", F.explode("keys").alias("key"))
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "r_host", "r_path", "r_verdict"))
    found = pairs.join(listed, "key").groupBy("host", "path").agg(best.alias("best"))
    judged = possible.select("id", "host", "path").join(found, ["host", "path"], "left").select(
        "id", "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict")
    )
    return missed.unionByName(judged).withColumnRenamed("id", id_col)
