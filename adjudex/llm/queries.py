"""The registered queries of the corpus operators, and SQL for those that have any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip_digests
from .chat_format import conversation_digests, format_turns, turns_of_frame
from .common import stored, table
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .maxscore import top_k
from .mixing import mix_documents
from .near_dedup import near_duplicates
from .ngram_lm import score_corpus
from .prefix_trie import ordered_turns, prefix_trie, share_openings
from .structure_repair import structure_report
from .suffix_dedup import suffix_dedup
from .toxicity import corpus_chain, score_chain
from .url_filter import url_filter

#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"), keep_model=False)[0]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter(table(spark, sf_dir, "pages"), rules)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text after removal, as doc_id, chars and SHA-256."""
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_chars", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), 1.0, 4).select("doc_id", "lang", "source", "epoch", "n_tokens")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_chain(docs.select("doc_id", "text"), corpus_chain(docs, table(spark, sf_dir, "labels"))).drop("text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=26, rows=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, laid out a row a turn, and conversation -1, laid out as prompt and response."""
    own = "</s>[INST] ok [/INST]"
    single = spark.createDataFrame([(-1, own, own)], "conv_id long, prompt string, response string")
    turns = turns_of_frame(table(spark, sf_dir, "conversations"), "conv_id").unionByName(turns_of_frame(single, "conv_id"))
    return conversation_digests(format_turns(turns))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_report(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_openings(stored(ordered_turns(table(spark, sf_dir, "conversations")), "turns")))


_WS = "[\\x20\\x09-\\x0D]"

_OP1_SQL = """
WITH v AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP3_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM p),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT h.page_id, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
  FROM h JOIN r ON (h.host = r_host OR ends_with(h.host, '.' || r_host)) AND starts_with(h.path, r_path) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""

_OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, {{'n': -n, 'id': doc_id}}) AS keep_id FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|(im_start|im_end|turn|text|end|endoftext)\|>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 8 + chars + 7) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, 4096 * j AS o, substr(x, 8192 * j + 1, 8590) AS y FROM (SELECT r, x, unnest(range(CAST(ceil(length(x) / 8192) AS BIGINT))) AS j FROM d)),
w AS (
  SELECT r, o + i AS p, md5_number(substr(y, 2 * i + 1, 400)) AS k
  FROM (SELECT r, o, y, unnest(range(least(4096, CAST(length(y) / 2 - 199 AS BIGINT)))) AS i FROM c)),
f AS (SELECT r, p FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS run FROM g) GROUP BY r, run),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS after FROM s),
u AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept
  FROM t JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN u USING (r)
"""

# CRC-32 bit by bit: each byte is xored in, then eight steps follow, marked -1.
_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
    string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""

_OP13_SQL = rf"""
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM o GROUP BY c),
h AS (SELECT c, n, c - c % 100 AS head, {_CRC32} % 6 AS h FROM n),
t AS (
  SELECT h.c, o.i + 1 AS d, role, text FROM h JOIN o ON o.c = h.head AND o.i < h.h
  UNION ALL
  SELECT h.c, o.i - h.h + least(h.h, coalesce(m.n, 0)) + 1, role, text FROM h JOIN o ON o.c = h.c AND o.i >= h.h LEFT JOIN n m ON m.c = h.head),
p AS (
  SELECT c, d, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k,
         length(text) AS chars FROM t
  UNION ALL SELECT c, 0, '', 0 FROM n),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
z AS (SELECT p.d, p.k, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS s FROM p JOIN e USING (c, d) GROUP BY p.d, p.k),
x AS (SELECT d, k, min(c) AS c, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY d, k),
y AS (SELECT x.*, u.c AS up FROM x LEFT JOIN p ON p.c = x.c AND p.d = x.d - 1 LEFT JOIN x u ON u.d = p.d AND u.k = p.k),
w AS (SELECT up AS c, d - 1 AS d, count(*) AS n_children FROM y WHERE d > 0 GROUP BY up, d),
v AS (SELECT y.*, coalesce(w.n_children, 0) AS n_children FROM y LEFT JOIN w ON w.c = y.c AND w.d = y.d),
s AS (
  SELECT p.d, p.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM v JOIN p ON p.c = v.c AND p.d <= v.d GROUP BY p.d, p.k)
SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, v.up AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       coalesce(z.s, sha256('')) AS ends_sha256
FROM v JOIN s USING (d, k) LEFT JOIN z USING (d, k)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_maxscore, op2_ngram_lm, op3_url_filter, op4_line_dedup, op5_mixing, op6_toxicity, op7_near_dedup, op8_exact_dedup, op9_byte_bpe, op10_chat_format)
    return {f.__name__: f for f in (*found, op11_suffix_dedup, op12_structure_repair, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_maxscore": _OP1_SQL, "op3_url_filter": _OP3_SQL, "op8_exact_dedup": _OP8_SQL, "op10_chat_format": _OP10_SQL, "op11_suffix_dedup": _OP11_SQL, "op13_prefix_trie": _OP13_SQL}
