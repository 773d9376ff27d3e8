"""Queries of the driver contract and their SQL.

Each pair computes the same columns; the SQL is for another engine, as an oracle.
"""

from __future__ import annotations

from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudex.functions import scalars as S
from adjudex.functions import canonical, stats, textlint
from adjudex.operators import evaluate as E
from adjudex.operators import cases, compiler, contradictions, evidence, graph, intervals, metrics, perturb, ruletables, sessions, similar, validate
from adjudex.operators.rules import Evidence, Exemption, Facts, Group, Leaf, Rule, Temporal, condition_column, leaf_column, temporal_column
from adjudex.streaming import evaluation, interview

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_facts(orders: DataFrame | None = None, **more) -> Facts:
    facts = Facts({f"order.{c[2:]}": F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}, **more)
    return facts.bind(orders) if orders is not None else facts


PRICE_CAP = Rule("ORD-1", "REQUIRE", Leaf("order", "totalprice", "<=", 400000), exceptions=(Exemption("finished orders", Leaf("order", "orderstatus", "==", "F")),), severity="high", action="review_order")
URGENT = Rule("ORD-2", "TRIGGER", Leaf("order", "orderpriority", "==", "1-URGENT"), evidence=(Evidence("shipment", min_count=2),), exceptions=(Exemption("finished orders", Leaf("order", "orderstatus", "==", "F")),), severity="medium", action="expedite_order")


def _order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").withColumn("subject_id", F.col("o_orderkey"))
    shipments = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.lit("shipment").alias("type"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("attrs"))
    return E.evaluate(orders, [PRICE_CAP, URGENT], _order_facts(), shipments)


_VERDICTS_SQL = """
WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o.*, coalesce(n, 0) AS n FROM orders o LEFT JOIN s ON o_orderkey = l_orderkey),
v AS (
  SELECT o_orderkey, o_custkey, 'ORD-1' AS rule_id, 'high' AS sev,
    CASE WHEN o_totalprice <= 400000 THEN 'COMPLIANT' WHEN o_orderstatus = 'F' THEN 'EXEMPT' ELSE 'VIOLATION' END AS verdict FROM o
  UNION ALL
  SELECT o_orderkey, o_custkey, 'ORD-2', 'medium',
    CASE WHEN o_orderpriority <> '1-URGENT' THEN 'NOT_APPLICABLE' WHEN n >= 2 THEN 'COMPLIANT' WHEN o_orderstatus = 'F' THEN 'EXEMPT' ELSE 'VIOLATION' END FROM o)
"""


@query(
    _VERDICTS_SQL
    + """
SELECT o_custkey, CASE WHEN count(*) FILTER (verdict = 'VIOLATION') > 0 THEN 'NON_COMPLIANT' WHEN count(*) FILTER (verdict = 'COMPLIANT') > 0 THEN 'COMPLIANT' ELSE 'NOT_APPLICABLE' END AS decision,
  count(*) FILTER (verdict = 'VIOLATION') AS n_violation, count(*) FILTER (verdict = 'ACTION_REQUIRED') AS n_action_required, count(*) FILTER (verdict = 'INDETERMINATE') AS n_indeterminate,
  count(*) FILTER (verdict = 'COMPLIANT') AS n_compliant, count(*) FILTER (verdict = 'NOT_APPLICABLE') AS n_not_applicable, count(*) FILTER (verdict = 'EXEMPT') AS n_exempt,
  CASE WHEN count(*) FILTER (verdict = 'VIOLATION' AND sev = 'high') > 0 THEN 'high' WHEN count(*) FILTER (verdict = 'VIOLATION') > 0 THEN 'medium' END AS highest_severity
FROM v GROUP BY o_custkey"""
)
def policy_decision_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.decide(_order_verdicts(spark, sf_dir), "o_custkey").drop("actions")


@query(_VERDICTS_SQL + "SELECT rule_id, verdict, count(*) AS n FROM v GROUP BY ALL")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_verdicts(spark, sf_dir).groupBy("rule_id", "verdict").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, o_totalprice > 100000 AS gt, o_totalprice >= 100000 AS ge, o_totalprice < 100000 AS lt, o_totalprice <= 100000 AS le,
    o_orderdate >= TIMESTAMP '1995-06-01' AS late, o_totalprice BETWEEN 50000 AND 150000 AS mid, NOT (o_totalprice > 50000 AND o_totalprice < 150000) AS outside FROM orders"""
)
def leaf_ordering_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    f, p = _order_facts(orders), "totalprice"
    tests = {"gt": Leaf("order", p, ">", 100000), "ge": Leaf("order", p, ">=", 100000), "lt": Leaf("order", p, "<", 100000), "le": Leaf("order", p, "<=", 100000), "late": Leaf("order", "orderdate", ">=", "1995-06-01"), "mid": Leaf("order", p, "between", [50000, 150000]), "outside": Leaf("order", p, "not_between", [50000, 150000], inclusive=False)}
    return orders.select("o_orderkey", *[leaf_column(t, f).alias(n) for n, t in tests.items()])


@query(
    """SELECT p_partkey, lower(p_brand) IN ('brand#11', 'brand#22') AS in_set, lower(p_brand) NOT IN ('brand#11', 'brand#22') AS not_in_set, p_size IN (1, 5, 9) AS sized,
    contains(lower(p_type), 'steel') AS has, NOT contains(lower(p_type), 'steel') AS has_not, lower(p_brand) = 'brand#11' AS same, p_size <> 7 AS differs, true AS there, true AS not_there FROM part"""
)
def leaf_membership_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Facts({f"part.{c}": F.col(f"p_{c}") for c in ("brand", "type", "size")}).bind(_t(spark, sf_dir, "part"))
    tests = {"in_set": Leaf("part", "brand", "in", ["Brand#11", "BRAND#22"]), "not_in_set": Leaf("part", "brand", "not_in", ["brand#11", "brand#22"]), "sized": Leaf("part", "size", "in", [1, 5, 9]), "has": Leaf("part", "type", "contains", "Steel"), "has_not": Leaf("part", "type", "not_contains", "STEEL"), "same": Leaf("part", "brand", "==", " brand#11 "), "differs": Leaf("part", "size", "!=", 7), "there": Leaf("part", "brand", "exists"), "not_there": Leaf("part", "colour", "not_exists")}
    return _t(spark, sf_dir, "part").select("p_partkey", *[leaf_column(t, f).alias(n) for n, t in tests.items()])


_KLEENE_SQL = """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events)
"""


@query(_KLEENE_SQL + "SELECT event_id, (v > 50 AND k > 50) AS both_, (v > 50 OR k > 50) AS either, NOT (v > 50) AS neither, (NOT (v > 50) OR k > 50) AS implied FROM e")
def kleene_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("v"), F.when(~F.col("event_type").isin("view", "error"), F.get_json_object("props", "$.k")).alias("k"))
    f = Facts({"event.v": F.col("v"), "event.k": F.col("k")}).bind(events)
    a, b = Leaf("event", "v", ">", 50), Leaf("event", "k", ">", 50)
    tests = {"both_": Group("AND", (a, b)), "either": Group("OR", (a, b)), "neither": Group("NOT", (a,)), "implied": Group("IMPLIES", (a, b))}
    return events.select("event_id", *[condition_column(t, f).alias(n) for n, t in tests.items()])


@query(_KLEENE_SQL + "SELECT event_id AS subject_id, 'R' AS rule_id, ((v > 50 AND k > 50) OR v <= 10) AS result FROM e")
def kleene_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    v = events.filter("event_type <> 'error'").select(F.col("event_id").alias("subject_id"), F.lit("event.v").alias("path"), F.col("value").cast("string").alias("raw"))
    k = events.filter("event_type NOT IN ('view', 'error')").select(F.col("event_id").alias("subject_id"), F.lit("event.k").alias("path"), F.get_json_object("props", "$.k").alias("raw"))
    nodes = spark.createDataFrame(
        [("R", 1, None, 1, "OR", None, None, None), ("R", 2, 1, 2, "AND", None, None, None), ("R", 3, 2, 3, None, "event.v", ">", 50.0), ("R", 4, 2, 3, None, "event.k", ">", 50.0), ("R", 5, 1, 2, None, "event.v", "<=", 10.0)],
        "rule_id string, node_id int, parent_id int, depth int, logic string, path string, op string, number double",
    ).withColumn("text", F.lit(None).cast("string"))
    return E.evaluate_tabular(v.unionByName(k), nodes, max_depth=3, subjects=events.select(F.col("event_id").alias("subject_id")))


@query(
    """SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-01' + INTERVAL 6 MONTH AS within_after, o_orderdate BETWEEN TIMESTAMP '1996-01-01' - INTERVAL 90 DAY AND TIMESTAMP '1996-01-01' AS within_before,
    o_orderdate BETWEEN TIMESTAMP '1996-01-01' - INTERVAL 1 YEAR AND TIMESTAMP '1996-01-01' + INTERVAL 1 YEAR AS around, o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 14 DAY AS old, o_orderdate < TIMESTAMP '1996-01-01' AS before_, o_orderdate > TIMESTAMP '1996-01-01' AS after_,
    o_orderdate BETWEEN TIMESTAMP '1994-02-01' AND TIMESTAMP '1994-12-31' AS inside FROM orders"""
)
def temporal_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _order_facts(_t(spark, sf_dir, "orders"), now=F.lit("1996-01-01").cast("timestamp_ntz"))
    made = {"within_after": Temporal("within", "order", "orderdate", "1996-01-01", 6, "months"), "within_before": Temporal("within", "order", "orderdate", "now", 90, "days", "before"), "around": Temporal("within", "order", "orderdate", "now", 1, "years", "either"), "old": Temporal("older_than", "order", "orderdate", "now", 2, "weeks"), "before_": Temporal("before", "order", "orderdate", "1996-01-01"), "after_": Temporal("after", "order", "orderdate", "now"), "inside": Temporal("between", "order", "orderdate", start="1994-02-01", end="1994-12-31")}
    return _t(spark, sf_dir, "orders").select("o_orderkey", *[temporal_column(t, f).alias(n) for n, t in made.items()])


@query("SELECT l_orderkey, l_linenumber, l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY AS on_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def temporal_field_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    f = Facts({"line.shipdate": F.col("l_shipdate"), "order.orderdate": F.col("o_orderdate")}).bind(both)
    return both.select("l_orderkey", "l_linenumber", temporal_column(Temporal("within", "line", "shipdate", "order.orderdate", 30, "days"), f).alias("on_time"))


@query(
    """WITH e AS (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN 'hours' WHEN 1 THEN 'min' WHEN 2 THEN 'kg' ELSE NULL END AS u FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN value * 3600.0 / 60.0 > 3000 WHEN 1 THEN value > 3000 WHEN 3 THEN value > 3000 END AS over_50_hours, round(CASE event_id % 4 WHEN 0 THEN value * 3600 / 86400 WHEN 1 THEN value * 60 / 86400 END, 3) AS days FROM e"""
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("event_id") % 4 == 0, "hours").when(F.col("event_id") % 4 == 1, "min").when(F.col("event_id") % 4 == 2, "kg")
    events = _t(spark, sf_dir, "events").withColumn("u", unit)
    f = Facts({"event.length": F.col("value")}, {"event.length": F.col("u")}).bind(events)
    days = S.convert(F.col("value"), S.unit_name(F.col("u")), F.lit("days"))
    return events.select("event_id", leaf_column(Leaf("event", "length", ">", 3000, "minutes"), f).alias("over_50_hours"), F.round(days, 3).alias("days"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice > 200000 WHEN 1 THEN o_totalprice * 1.25 > 200000 ELSE o_totalprice / 80.0 > 200000 END AS over FROM orders")
def fx_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("o_orderkey") % 3 == 0, "usd").when(F.col("o_orderkey") % 3 == 1, "£").otherwise("INR")
    f = Facts({"order.total": F.col("o_totalprice")}, {"order.total": unit}, rates={"GBP->USD": 1.25, "USD->INR": 80.0}).bind(_t(spark, sf_dir, "orders"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", leaf_column(Leaf("order", "total", ">", 200000, "USD"), f).alias("over"))


@query("SELECT l_orderkey AS subject_id, count(*) AS shipped, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey")
def evidence_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject_id"), F.lit("Line Shipment").alias("type"), F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("attrs"))
    return E.count_evidence(items, "subject_id", {"shipped": Evidence("line_shipment"), "returned": Evidence("line_shipment", match=(("flag", "r"),))})


@query(_VERDICTS_SQL + "SELECT o_custkey, max(CASE WHEN verdict = 'VIOLATION' THEN 1 ELSE 0 END) = 1 AS confirmed FROM v WHERE rule_id = 'ORD-1' GROUP BY o_custkey")
def derived_trigger_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confirm_violations(_order_verdicts(spark, sf_dir), "o_custkey", ["ORD-1"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS record_index FROM orders")
def record_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("records"))
    return E.fan_out(lists, "records", record="o_orderkey").select("o_custkey", "o_orderkey", F.col("record_index").cast("long").alias("record_index"))


@query(
    r"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.;!?])[ \t\n\f\r\v]+', '\1' || chr(10), 'g'), '\n+')) AS s FROM documents),
    t AS (SELECT doc_id, trim(s, ' ') AS s FROM s WHERE trim(s, ' ') <> '')
    SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(s, '\d') OR regexp_matches(s, '(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|fifteen|twenty|thirty|forty|fifty|sixty|ninety|hundred|thousand)\b')) AS with_number FROM t GROUP BY doc_id"""
)
def sentence_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _t(spark, sf_dir, "documents").select("doc_id", F.explode(textlint.sentences(F.col("text"))).alias("s"))
    return each.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(textlint.states_number(F.col("s"))).alias("with_number"))


def _clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause for each part, six forms in turn, with its size in it, and the severity that a model returned for it."""
    n, form = F.col("p_size"), F.pmod("p_partkey", F.lit(6))
    even, text = n % 2 == 0, n.cast("string")
    clause = (
        F.when(form == 0, F.concat(F.lit("Expenses over $"), F.format_number(n * 1000, 0), F.lit(" must have written approval within "), text, F.lit(" weeks.")))
        .when(form == 1, "Severity: critical. No employee may share passwords.").when(form == 2, "Reports should be timely unless exempted.")
        .when(form == 3, F.concat(F.lit("Discounts between "), text, F.lit("% and "), (n + 15).cast("string"), F.lit("% are of low priority.")))
        .when(form == 4, "Severe incidents are escalated in one day.").otherwise(F.concat(F.lit("Payments not exceeding "), text, F.lit(" lakh need no review.")))
    )
    returned = F.when(form == 1, F.when(even, "critical").otherwise("high")).when(form == 2, "medium").when(form == 3, F.when(even, "low").otherwise("high")).when(form.isin(0, 4), "high")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("clause_id"), clause.alias("clause"), returned.alias("returned"), even.alias("timed"))


@query(
    """SELECT p_partkey AS clause_id, CASE p_partkey % 6 WHEN 0 THEN 7 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 2 ELSE 0 END AS n_numbers,
    CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 7 * 24 * 60 WHEN 3 THEN p_size + 15 WHEN 4 THEN 24 * 60 WHEN 5 THEN p_size * 100000 END AS DOUBLE) AS largest FROM part"""
)
def number_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = textlint.numbers_in(F.col("clause"))
    return _clauses(spark, sf_dir).select("clause_id", F.size(pool).alias("n_numbers"), F.array_max(pool).alias("largest"))


@query(
    """SELECT p_partkey AS clause_id, CASE WHEN p_partkey % 6 IN (1, 3) AND p_size % 2 = 0 THEN 'policy_stated' WHEN p_partkey % 6 = 4 THEN 'ambiguous' ELSE 'schema_default' END AS severity_source
    FROM part"""
)
def severity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clauses(spark, sf_dir).select("clause_id", textlint.severity_grounding(F.col("returned"), F.col("clause"), F.col("clause")).alias("severity_source"))


@query(
    """SELECT p_partkey AS clause_id, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN '' ELSE 'time_limit_dropped' END WHEN 1 THEN 'negation_dropped' WHEN 2 THEN 'exception_dropped'
        WHEN 3 THEN 'range_dropped' WHEN 4 THEN '' ELSE 'negation_dropped' END AS findings,
    CASE p_partkey % 6 WHEN 1 THEN 'may' WHEN 2 THEN 'timely' END AS vague FROM part"""
)
def clause_crosschecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    found = textlint.crosschecks(F.col("clause"), negated=no, excepted=no, timed=F.col("timed"), ranged=no)
    return _clauses(spark, sf_dir).select("clause_id", F.array_join(found, ",").alias("findings"), textlint.ambiguity(F.col("clause")).alias("vague"))


@query("WITH h AS (SELECT sha256(text) AS content_hash, source FROM documents) SELECT content_hash, count(*) AS n_rows, count(DISTINCT source) AS n_splits FROM h GROUP BY 1 HAVING count(DISTINCT source) > 1")
def content_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.leakage(_t(spark, sf_dir, "documents"), F.col("text"), "source")


@query("SELECT text AS content, count(*) AS n FROM benchmark GROUP BY text HAVING count(*) > 1 UNION ALL SELECT sha256(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.duplicate_keys(_t(spark, sf_dir, "benchmark").select(F.col("text").alias("content")), "content")
    b = metrics.duplicate_keys(_t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content")), "content")
    return a.unionByName(b)


@query(
    """WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
    w(root, id, hop) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT root, dst, hop + 1 FROM w JOIN e ON id = src WHERE hop < 3) SELECT root, id, hop FROM w"""
)
def graph_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, supplier = (_t(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = nation.select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst")).unionByName(supplier.select(tag("n", "s_nationkey").alias("src"), tag("s", "s_suppkey").alias("dst")))
    return graph.traverse(edges, region.select(tag("r", "r_regionkey").alias("id")), 3)


@query("SELECT c_custkey AS key, 'customer' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    return graph.missing_references(wanted, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query(
    """WITH l AS (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 AS paid FROM lineitem GROUP BY 1)
    SELECT CASE WHEN paid IS NULL THEN 'MISSING_EVIDENCE' WHEN abs(paid - o_totalprice) <= 0.01 THEN 'CONSISTENT' WHEN paid - o_totalprice > 0.01 THEN 'MAJOR' WHEN o_orderstatus = 'P' THEN 'CONSISTENT' ELSE 'UNRESOLVED' END AS state, count(*) AS n
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"""
)
def contradiction_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("paid"))
    both = _t(spark, sf_dir, "orders").join(paid, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy(graph.amount_contradiction(F.col("o_totalprice"), F.col("paid"), F.col("o_orderstatus") == "P").alias("state")).agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 150000 THEN 'NOT_REQUIRED' ELSE 'ESTABLISHED' END AS status, '<=' AS region_op, CASE WHEN o_totalprice > 150000 THEN round(150000 - o_totalprice, 2) END AS delta,
    CASE WHEN o_totalprice > 150000 THEN 'decrease' END AS direction, CASE WHEN o_totalprice > 150000 THEN 150000.0 END AS target FROM orders"""
)
def counterfactual_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = graph.counterfactual(F.lit("FORBID"), F.lit(">"), F.lit(150000.0), F.col("o_totalprice"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.status", "c.region_op", F.round("c.delta", 2).alias("delta"), "c.direction", "c.target")


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'VIOLATION' WHEN o_totalprice > 250000 THEN 'INCONCLUSIVE' WHEN o_totalprice > 200000 THEN 'UNEVALUATED' ELSE 'SATISFIED' END AS verdict, o_orderstatus = 'P' AS gap, o_orderkey % 7 = 0 AS open_ FROM orders)
    SELECT o_orderkey, CASE WHEN verdict = 'INCONCLUSIVE' OR gap THEN 'INSUFFICIENT_EVIDENCE' WHEN verdict = 'UNEVALUATED' OR open_ THEN 'CONDITIONAL' WHEN verdict = 'VIOLATION' THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS state,
    concat_ws(',', CASE WHEN gap THEN 'CRITICAL_EVIDENCE_MISSING' END, CASE WHEN open_ THEN 'UNRESOLVED_CONTRADICTION' END, CASE WHEN verdict = 'VIOLATION' THEN 'HIGH_RISK' END) AS reasons FROM s"""
)
def uncertainty_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    verdict = F.when(p > 300000, "VIOLATION").when(p > 250000, "INCONCLUSIVE").when(p > 200000, "UNEVALUATED").otherwise("SATISFIED")
    gap, open_, fine = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 7 == 0, F.lit("VERIFIED")
    reasons = graph.escalation_reasons(gap, fine, open_, F.lit(False), verdict == "VIOLATION")
    return _t(spark, sf_dir, "orders").select("o_orderkey", graph.uncertainty_state(fine, verdict, gap, fine, open_).alias("state"), F.array_join(reasons, ",").alias("reasons"))


def _scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside two plain heuristics."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = _t(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select("doc_id", "lang", "source", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("expected"), F.when(F.col("n_chars") > 600, "good").otherwise("bad").alias("by_size"), F.when(F.col("n_chars") % 5 > 0, "good").otherwise("bad").alias("by_chance"), ((F.col("n_chars") % 101) / 100.0).alias("confidence"))


_LABELS_SQL = """WITH r AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS expected, CASE WHEN n_chars > 600 THEN 'good' ELSE 'bad' END AS by_size, CASE WHEN n_chars % 5 > 0 THEN 'good' ELSE 'bad' END AS by_chance, (n_chars % 101) / 100.0 AS confidence FROM labels JOIN documents USING (doc_id))
"""


@query(
    _LABELS_SQL
    + """, c AS (SELECT lang, count(*) AS n, count(*) FILTER (expected = 'good' AND by_size = 'good') AS gg, count(*) FILTER (expected = 'bad' AND by_size = 'bad') AS bb, count(*) FILTER (expected = 'bad' AND by_size = 'good') AS bg, count(*) FILTER (expected = 'good' AND by_size = 'bad') AS gb FROM r GROUP BY lang)
    SELECT lang, n, round((gg + bb) / n, 6) AS accuracy, round((2 * gg / nullif(2 * gg + bg + gb, 0) + 2 * bb / nullif(2 * bb + bg + gb, 0)) / 2, 6) AS macro_f1, round((bb / nullif(bb + bg, 0) + gg / nullif(gg + gb, 0)) / 2, 6) AS specificity,
    round((gg * bb - bg * gb) / nullif(sqrt((gg + bg) * (gg + gb) * (bb + bg) * (bb + gb)), 0), 6) AS mcc FROM c"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.classification(_scored_labels(spark, sf_dir), "expected", "by_size", ("good", "bad"), "lang")
    return m.select("lang", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "specificity", "mcc")])


@query(
    _LABELS_SQL
    + """, x AS (SELECT least(floor(confidence * 10), 9) AS bin, confidence AS c, CASE WHEN expected = by_size THEN 1.0 ELSE 0.0 END AS ok FROM r), b AS (SELECT bin, count(*) AS n, avg(c) AS mc, avg(ok) AS acc FROM x GROUP BY bin)
    SELECT CAST((SELECT count(*) FROM x) AS BIGINT) AS n, round((SELECT sum(n * abs(mc - acc)) / sum(n) FROM b), 6) AS ece, round((SELECT avg((c - ok) * (c - ok)) FROM x), 6) AS brier, round((SELECT avg(c) - avg(ok) FROM x), 6) AS mean_signed_error"""
)
def calibration_ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_labels(spark, sf_dir).withColumn("ok", F.col("expected") == F.col("by_size"))
    c = metrics.calibration(rows.withColumn("confidence", metrics.usable_confidence(F.col("confidence"))), "confidence", "ok")
    return c.select("n", *[F.round(x, 6).alias(x) for x in ("ece", "brier", "mean_signed_error")])


@query(
    _LABELS_SQL
    + "SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS group_kind, coalesce(lang, source) AS group_value, count(*) AS n, round(avg(CASE WHEN expected = by_size THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r GROUP BY GROUPING SETS ((), (lang), (source))"
)
def grouped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("expected") == F.col("by_size")
    return metrics.grouping_sets(_scored_labels(spark, sf_dir), ["lang", "source"], [F.count("*").alias("n"), F.round(metrics.boolean_accuracy(ok), 6).alias("accuracy")])


@query(
    _LABELS_SQL
    + """, g AS (SELECT source, list(doc_id) FILTER (expected = 'good') AS e, list(doc_id) FILTER (by_size = 'good') AS p, count(*) FILTER (expected = 'good' AND by_size = 'good') AS tp, count(*) FILTER (by_size = 'good') AS pred, count(*) FILTER (expected = 'good') AS exp FROM r GROUP BY source)
    SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(pred) AS BIGINT) AS predicted, CAST(sum(exp) AS BIGINT) AS expected, round(sum(tp) / sum(pred), 6) AS precision_, round(sum(tp) / sum(exp), 6) AS recall, round(2 * sum(tp) / (sum(pred) + sum(exp)), 6) AS f1 FROM g"""
)
def retrieval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, p = F.col("expected") == "good", F.col("by_size") == "good"
    counts = _scored_labels(spark, sf_dir).groupBy("source").agg(F.count_if(e & p).alias("tp"), F.count_if(p).alias("predicted"), F.count_if(e).alias("expected"))
    total = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "expected")])
    tp, p, e = F.col("tp"), F.col("predicted"), F.col("expected")
    return total.select(tp, p, e, F.round(metrics.ratio(tp, p), 6).alias("precision_"), F.round(metrics.ratio(tp, e), 6).alias("recall"), F.round(metrics.f1_counts(tp, p, e), 6).alias("f1"))


@query(
    _LABELS_SQL
    + """, k AS (SELECT source, count(*) AS n, count(*) FILTER (expected = by_size) AS k FROM r GROUP BY source), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM k)
    SELECT source, k, n, round(p, 6) AS estimate, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM z"""
)
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _scored_labels(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("expected") == F.col("by_size")).alias("k"), F.count("*").alias("n"))
    w = k.withColumn("w", stats.wilson(F.col("k"), F.col("n")))
    return w.select("source", "k", "n", *[F.round(f"w.{c}", 6).alias(c) for c in ("estimate", "low", "high")])


@query(
    _LABELS_SQL
    + "SELECT lang, count(*) AS n_pairs, count(*) FILTER (expected = by_size AND expected <> by_chance) AS b, count(*) FILTER (expected <> by_size AND expected = by_chance) AS c, count(*) FILTER ((expected = by_size) <> (expected = by_chance)) AS discordant FROM r GROUP BY lang"
)
def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_labels(spark, sf_dir).select("lang", (F.col("expected") == F.col("by_size")).alias("x"), (F.col("expected") == F.col("by_chance")).alias("y"))
    return stats.mcnemar(rows, "x", "y", "lang").select("lang", "n_pairs", "b", "c", "discordant")


_BINOMIAL = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0)))))"


@query(
    _LABELS_SQL
    + f""", k AS (SELECT source, count(*) AS n_pairs, count(*) FILTER (expected = by_size AND expected <> by_chance) AS b, count(*) FILTER (expected <> by_size AND expected = by_chance) AS c FROM r GROUP BY source),
    p AS (SELECT *, CASE WHEN b + c >= 10 THEN {_BINOMIAL} END AS p FROM k), o AS (SELECT source, p, row_number() OVER (ORDER BY p, source) AS i, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
    a AS (SELECT source, max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY p, source ROWS UNBOUNDED PRECEDING) AS h FROM o)
    SELECT source, n_pairs, b, c, round(p, 8) AS p_value, round(h, 8) AS p_adjusted FROM p LEFT JOIN a USING (source)"""
)
def mcnemar_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only tests with enough discordant pairs have a p-value and are in the family."""
    rows = _scored_labels(spark, sf_dir).select("source", (F.col("expected") == F.col("by_size")).alias("x"), (F.col("expected") == F.col("by_chance")).alias("y"))
    tests = stats.mcnemar(rows, "x", "y", "source").withColumn("p_value", F.when(F.col("reported"), F.col("p_value")))
    adjusted = stats.holm("p_value", ["source"])(tests)
    return adjusted.select("source", "n_pairs", "b", "c", F.round("p_value", 8).alias("p_value"), F.round("p_adjusted", 8).alias("p_adjusted"))


@query(
    _LABELS_SQL
    + f""", v AS (SELECT lang, doc_id, expected = by_size AS a1, expected = by_chance AS a2, expected = 'good' AS a3 FROM r),
    w AS (SELECT 'by_chance' AS version_a, 'by_size' AS version_b, lang, a2 AS x, a1 AS y FROM v UNION ALL SELECT 'always', 'by_chance', lang, a3, a2 FROM v UNION ALL SELECT 'always', 'by_size', lang, a3, a1 FROM v),
    k AS (SELECT version_a, version_b, lang, count(*) AS n_pairs, count(*) FILTER (x AND NOT y) AS b, count(*) FILTER (y AND NOT x) AS c FROM w GROUP BY GROUPING SETS ((version_a, version_b), (version_a, version_b, lang))),
    p AS (SELECT *, CASE WHEN b + c >= 10 THEN {_BINOMIAL} END AS p FROM k),
    o AS (SELECT version_a, version_b, lang, p, row_number() OVER (PARTITION BY version_a, version_b ORDER BY p, lang) AS i, count(*) OVER (PARTITION BY version_a, version_b) AS m FROM p WHERE p IS NOT NULL AND lang IS NOT NULL),
    a AS (SELECT version_a, version_b, lang, max(least(1.0, (m - i + 1) * p)) OVER (PARTITION BY version_a, version_b ORDER BY p, lang ROWS UNBOUNDED PRECEDING) AS h FROM o)
    SELECT version_a, version_b, lang, n_pairs, b, c, round(p, 8) AS p_value, round(h, 8) AS p_adjusted FROM p LEFT JOIN a USING (version_a, version_b, lang)"""
)
def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = F.array(*[F.struct(F.lit(n).alias("version"), (F.col("expected") == c).alias("ok")) for n, c in (("by_size", F.col("by_size")), ("by_chance", F.col("by_chance")), ("always", F.lit("good")))])
    scored = _scored_labels(spark, sf_dir).select("doc_id", "lang", F.inline(answers))
    tests = stats.version_pairs(scored, "version", "doc_id", "lang", "ok")
    return tests.select("version_a", "version_b", "lang", "n_pairs", "b", "c", F.round("p_value", 8).alias("p_value"), F.round("p_adjusted", 8).alias("p_adjusted"))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy of one clause for each part, and an answer with one rule: five forms of answers in turn."""
    size, amount = F.col("p_size").cast("string"), (F.col("p_size") * 1000).cast("string")
    form = F.pmod("p_partkey", F.lit(5))
    above = F.concat(F.lit("Orders above "), amount, F.lit(" USD require legal review."))
    ban = F.concat(F.lit("Contractors must not ship parts of size "), size, F.lit("."))
    text = F.when(form.isin(0, 1, 3), above).when(form == 2, "Shipments must be timely.").otherwise(ban)

    def rule(kind: str, leaf: Column, confidence: Column, more: str = "") -> Column:
        return F.concat(F.lit(f'{{"rules":[{{"rule_type":"{kind}",{more}"condition":{{'), leaf, F.lit('},"action":"act on it","confidence":'), confidence, F.lit(',"source_text":"'), text, F.lit('"}]}'))

    def order(op: str, value: Column) -> Column:
        return F.concat(F.lit(f'"entity":"order","field":"total","operator":"{op}","unit":"USD","value":'), value)

    proof, sure = '"required_evidence":[{"type":"legal review"}],', F.lit("0.9")
    answer = (
        F.when(form == 0, rule("TRIGGER", order(">", amount), sure, proof))
        .when(form == 1, rule("TRIGGER", order(">", (F.col("p_size") * 1000 + 1).cast("string")), sure, proof))
        .when(form == 2, rule("REQUIRE", F.lit('"entity":"shipment","field":"timely","operator":"==","value":true'), sure))
        .when(form == 3, rule("TRIGGER", order("~", amount), sure, proof))
        .otherwise(rule("PROHIBIT", F.concat(F.lit('"entity":"part","field":"size","operator":"==","value":'), size), F.when(F.col("p_size") < 25, "0.9").otherwise("0.5")))
    )
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("policy_id"), text.alias("policy_text"), answer.alias("answer"))


@query(
    """WITH f AS (SELECT p_partkey % 5 AS form, p_size < 25 AS sure FROM part), r AS (SELECT CASE WHEN form = 0 OR (form = 4 AND sure) THEN 'VALID' WHEN form = 3 THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS status, CASE form WHEN 0 THEN 'TRIGGER' WHEN 1 THEN 'TRIGGER' WHEN 2 THEN 'REQUIRE' WHEN 3 THEN 'TRIGGER' ELSE 'PROHIBIT' END AS rule_type FROM f)
    SELECT status, rule_type, count(*) AS n, round(sum(CASE status WHEN 'VALID' THEN 0.9 WHEN 'NEEDS_REVIEW' THEN 0.49 END), 2) AS confidence FROM r GROUP BY ALL"""
)
def compile_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, _ = compiler.compile_policies(_policies(spark, sf_dir))
    return rules.groupBy("status", "rule_type").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 2).alias("confidence"))


@query(
    """SELECT 'P-' || p_partkey AS policy_id, CASE WHEN p_partkey % 5 = 3 THEN 'REJECTED' WHEN p_partkey % 5 = 0 OR (p_partkey % 5 = 4 AND p_size < 25) THEN 'COMPILED' ELSE 'COMPILED_WITH_REVIEW' END AS status, 1 AS extracted,
    CASE WHEN p_partkey % 5 = 0 OR (p_partkey % 5 = 4 AND p_size < 25) THEN 1 ELSE 0 END AS valid, CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 0 END AS rejected FROM part"""
)
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.compile_policies(_policies(spark, sf_dir))[1].select("policy_id", "status", "extracted", "valid", "rejected")


_RULES_SQL = """WITH p AS (SELECT p_partkey, p_partkey % 5 AS form, p_size FROM part),
    a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
    l AS (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS timely FROM lineitem GROUP BY l_orderkey),
    v AS (SELECT o_orderkey, CASE
        WHEN form IN (0, 1) THEN CASE WHEN o_totalprice <= p_size * 1000 + form THEN 'NOT_APPLICABLE' WHEN o_orderpriority = '1-URGENT' THEN 'COMPLIANT' ELSE 'VIOLATION' END
        WHEN form = 2 THEN CASE WHEN o_orderstatus = 'P' THEN 'INDETERMINATE' WHEN timely THEN 'COMPLIANT' ELSE 'VIOLATION' END
        ELSE CASE WHEN o_orderkey % 50 + 1 = p_size THEN 'VIOLATION' ELSE 'COMPLIANT' END END AS verdict
        FROM a JOIN p ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN l USING (l_orderkey) WHERE form <> 3)
    SELECT o_orderkey AS subject_id, count(*) FILTER (verdict = 'VIOLATION') AS n_violation, count(*) FILTER (verdict = 'COMPLIANT') AS n_compliant,
        count(*) FILTER (verdict = 'NOT_APPLICABLE') AS n_not_applicable, count(*) FILTER (verdict = 'INDETERMINATE') AS n_indeterminate,
        CASE WHEN count(*) FILTER (verdict = 'VIOLATION') > 0 THEN 'NON_COMPLIANT' WHEN count(*) FILTER (verdict = 'INDETERMINATE') > 0 THEN 'INDETERMINATE'
        WHEN count(*) FILTER (verdict = 'COMPLIANT') > 0 THEN 'COMPLIANT' ELSE 'NOT_APPLICABLE' END AS decision
    FROM v GROUP BY o_orderkey"""


@query(_RULES_SQL)
def compiled_rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order against the compiled policies of the parts that it contains: from the model's answers to decisions, all as tables."""
    rules, _ = compiler.compile_policies(_policies(spark, sf_dir))
    tables = ruletables.rule_tables(rules)
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    applies = lines.select(F.col("l_orderkey").alias("subject_id"), F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("policy_id"))

    def fact(name: str, raw: Column) -> Column:
        return F.struct(F.lit(name).alias("fact"), raw.alias("raw"))

    timely = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(F.bool_and(F.col("l_returnflag") != "R"), "yes").otherwise("no").alias("timely"))
    own = [
        fact("order.total", F.concat(F.format_number("o_totalprice", 2), F.lit(" USD"))), fact("shipment.timely", F.when(F.col("o_orderstatus") != "P", F.col("timely"))),
        fact("part.size", (F.col("o_orderkey") % 50 + 1).cast("string")),
    ]
    facts = orders.join(timely, "o_orderkey").select(F.col("o_orderkey").alias("subject_id"), F.inline(F.array(*own))).filter("raw is not null")
    reviewed = orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("subject_id"), F.lit("Legal review").alias("type"), F.create_map(F.lit("by"), F.lit("counsel")).alias("attrs"))
    verdicts = ruletables.evaluate_rules(applies, tables, facts, reviewed, include_needs_review=True)
    return E.decide(verdicts, "subject_id").select("subject_id", "n_violation", "n_compliant", "n_not_applicable", "n_indeterminate", "decision")


@query(
    """WITH p AS (SELECT n_nationkey, (n_nationkey * 37 % 25 + 1) / 500.0 AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, n_nationkey) AS k, count(*) OVER () AS m FROM p)
    SELECT n_nationkey, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY p, n_nationkey ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM r"""
)
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "nation").select("n_nationkey", ((F.col("n_nationkey") * 37 % 25 + 1) / 500.0).alias("p"), F.lit(1).alias("family"))
    return stats.holm("p", ["n_nationkey"], "family")(p).select("n_nationkey", F.round("p_adjusted", 9).alias("p_adjusted"))


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored_labels(spark, sf_dir).select("lang", F.pmod("doc_id", F.lit(40)).alias("family"), (F.col("expected") == F.col("by_size")).alias("ok"))
    return stats.cluster_bootstrap(rows, "lang", "family", "ok")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def chat_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_n(_t(spark, sf_dir, "conversations"), "conv_id", ["turn"], 3).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) WHERE d <= 2 OR a = 1")
def chat_history_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.with_first(_t(spark, sf_dir, "conversations"), "conv_id", ["turn"], 2).select("conv_id", "turn", "role")


@query(
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN 'a' ELSE 'b' END AS role, text FROM conversations), g AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS ch FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), b AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM g)
    SELECT conv_id, CAST(block AS BIGINT) AS block, role, string_agg(text, '|' ORDER BY turn) AS text, count(*) AS n FROM b GROUP BY conv_id, block, role"""
)
def chat_role_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 < 2, "a").otherwise("b").alias("role"), "text")
    return sessions.merge_roles(c, "conv_id", "turn", "role", "text", "|")


@query("SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transcript(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT min(page_id) AS page_id, host FROM (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages) GROUP BY host ORDER BY 1 LIMIT 4")
def source_dedupe_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))
    return sessions.first_by_key(pages, "host", [F.col("page_id")])


@query("SELECT page_id, substr(regexp_replace(html, '<[^>]+>', ' ', 'g'), 1, 3000) AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.strip_html(F.col("html")).alias("text"))


_WARNINGS = {"signup": "STRIKE: Candidate exited Full-Screen mode.", "purchase": "Browser window lost focus.", "view": "ordinary", "click": "Clipboard used.", "error": "FATAL STRIKE 3: Auto-terminated."}
_PROCTOR_SQL = """WITH e AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 10 WHEN 'purchase' THEN 15 WHEN 'click' THEN 25 ELSE 0 END AS lost, event_type = 'error' AND event_id % 10 = 0 AS fatal FROM events)"""


@query(
    _PROCTOR_SQL
    + """, i AS (SELECT user_id, CASE WHEN bool_or(fatal) THEN 0 ELSE greatest(0, least(100, 100 - sum(lost))) END AS integrity, bool_or(fatal) AS is_terminated FROM e GROUP BY user_id)
    SELECT user_id, CAST(integrity AS INTEGER) AS integrity, CASE WHEN is_terminated THEN 'Terminated' WHEN integrity < 100 THEN 'Warning/Violations Detected' ELSE 'Clean' END AS proctoring_status, is_terminated, CASE WHEN 0.7 * 80 + 0.3 * integrity < 70 THEN 'Consider with Reservations' ELSE 'Recommend Hire' END AS bucket FROM i"""
)
def proctor_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.create_map(*[F.lit(x) for kv in _WARNINGS.items() for x in kv])
    # Of errors every tenth is fatal.
    events = _t(spark, sf_dir, "events").withColumn("d", F.when((F.col("event_type") != "error") | (F.col("event_id") % 10 == 0), F.element_at(text, F.col("event_type"))).otherwise("ordinary"))
    i = sessions.integrity(events, "user_id", "ts", "d")
    return i.withColumn("bucket", sessions.hire_bucket(F.lit(80.0) * 0.7 + F.col("integrity") * 0.3))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS strike, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3 AS fatal FROM events WHERE event_type = 'error'")
def proctor_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = _t(spark, sf_dir, "events").filter("event_type = 'error'")
    return sessions.strikes(errors, "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("strike").cast("long").alias("strike"), "fatal")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS r FROM events),
    w AS (SELECT user_id, event_id, r, t AS last, true AS ok FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN o.t - w.last >= 3600000 THEN o.t ELSE w.last END, o.t - w.last >= 3600000 FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1) SELECT user_id, event_id FROM w WHERE ok"""
)
def event_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.debounce(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3_600_000)


_CASES = (
    ("OB-01-1A", 0, (("d1", "Invoice of $1,200 dated 2024-01-10 from Acme Trading Company."), ("d2", "written approval was granted with remark")), "EXP-1.0: The approval must be given within 30 days of receipt.", "COMPLIANT", False, ("d1",), (), (), "EXP-1.0"),
    ("OB-02-1B", 1, (("d1", "Goods received on 2024-03-31."), ("d2", "Invoice dated 2024-01-01, 15% discount.")), "REC-2.0: Invoices must arrive within 45 days of delivery.", "NON_COMPLIANT", True, ("d1", "d2"), (), (), "REC-2.0"),
    ("OB-03-2A", 2, (("d1", "The visitor log is missing."),), "VIS-3.0: A log must be kept; the newer record prevails.", "INSUFFICIENT_EVIDENCE", True, (), (), ("log",), "VIS-3.0"),
)


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CASES, "case_id string, idx int, document_set array<struct<doc_id:string,text:string>>, policy string, expected_decision string, expected_escalation boolean, supporting_evidence array<string>, contradicting_evidence array<string>, missing_evidence array<string>, applicable_policy_rule string")


@query()
def suite_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.check_records(perturb.suite(_cases(spark)), perturb.TYPES)


@query(
    r"""SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 3 = 1 AND regexp_matches(trim(w, '.,:;''"()'), '^\p{Ll}{4,}$') AND trim(w, '.,:;''"()') NOT IN ('none','not','never','without','before','after','within','more','than','only','late','over','under','above','below','less','full','partial','pending','cleared','void','fake','valid','signed','unsigned','missing','absent')
    THEN CASE WHEN contains(w, 'm') THEN regexp_replace(w, 'm', 'rn') WHEN contains(w, 'e') THEN regexp_replace(w, 'e', 'c') WHEN contains(w, 'i') THEN regexp_replace(w, 'i', 'l') WHEN contains(w, 'l') THEN regexp_replace(w, 'l', 'I') WHEN contains(w, 'a') THEN regexp_replace(w, 'a', 'o') ELSE w END ELSE w END), ' ') AS text FROM documents"""
)
def perturb_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", perturb.ocr_text(F.col("text")).alias("text"))


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate + INTERVAL 100 DAY AS DATE) AS b FROM orders)
    SELECT o_orderkey, date_diff('day', last_day(a), CAST(date_trunc('month', b) AS DATE)) AS low, date_diff('day', CAST(date_trunc('month', a) AS DATE), last_day(b)) AS high FROM d"""
)
def temporal_month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    low, high = perturb.month_bounds(day, F.date_add(day, 100))
    return _t(spark, sf_dir, "orders").select("o_orderkey", low.cast("long").alias("low"), high.cast("long").alias("high"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.tumbling(_t(spark, sf_dir, "events"), "ts", "1 hour", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interview.session_windows(_t(spark, sf_dir, "events"), "ts", "6 hours", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    """WITH a AS (SELECT doc_id, regexp_extract_all(text, '(?i)(CC BY|MIT License|Apache License|GNU General)', 1) AS l FROM documents), x AS (SELECT doc_id, unnest(list_distinct(list_transform(l, lambda v: upper(v)))) AS lic FROM a), h AS (SELECT lic, min(doc_id) AS hub FROM x GROUP BY lic)
    SELECT hub, doc_id AS id, lic AS identifier FROM x JOIN h USING (lic) WHERE doc_id <> hub"""
)
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(CC BY|MIT License|Apache License|GNU General)"), F.lit(1)), lambda x: F.upper(x)))
    terms = _t(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("identifier"), F.lit("licence").alias("kind"))
    return graph.shared_identifiers(terms).select("hub", "id", "identifier")


@query("SELECT 'a' AS side, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'b', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def unpaired_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return validate.unpaired(a, b, "key")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase orders from customers, invoices from orders (every fifth from another vendor) and an approval of every third invoice."""
    customers, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")

    def paper(rows: DataFrame, letter: str, key: str, *parts: object) -> DataFrame:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return rows.select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("doc_id"), text.alias("text"))

    vendor = F.when(F.col("o_orderkey") % 5 == 0, F.lit("Other Works")).otherwise(F.concat(F.lit("Firm"), F.col("o_custkey").cast("string")))
    number = F.col("o_orderkey")
    bought = paper(customers, "c", "c_custkey", "Purchase Order No: PO-", F.col("c_custkey"), "\nSupplier: Firm", F.col("c_custkey"), " Pvt Ltd")
    billed = paper(orders, "i", "o_orderkey", "Invoice No: INV-", number, "\nPO Number: PO", F.col("o_custkey"), "\nVendor: ", vendor, " Ltd\nApproval ID: APR-", number, "\nBilled INR ", F.col("o_totalprice"))
    agreed = paper(orders.filter("o_orderkey % 3 = 0"), "a", "o_orderkey", "Approval ID: APR-", number, "\nStatus: granted")
    return bought.unionByName(billed).unionByName(agreed)


@query(
    r"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS s FROM documents),
    r AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM w WHERE len(s) > 0 GROUP BY s),
    e AS (SELECT rep, n, unnest(s) AS word FROM r),
    p AS (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS common FROM e x JOIN e y ON x.word = y.word AND x.rep < y.rep GROUP BY ALL)
    SELECT a, b, 'WEAK' AS status, common, round(common / (na + nb - common), 9) AS score FROM p WHERE common >= 0.8 * (na + nb - common) - 1e-9"""
)
def doc_semantic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of unlike documents of which four fifths of the words are the same."""
    found, _ = similar.semantic_links(_t(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)
    return found.select("a", "b", "status", "common", F.round("score", 9).alias("score"))


@query(
    """WITH l AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS total, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS most, count(*) AS n,
            min(CAST(l_shipdate AS DATE)) AS shipped FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS more, o_orderpriority, CAST(o_orderdate AS DATE) AS ordered, l.* EXCLUDE (k) FROM orders JOIN l ON l.k = o_orderkey),
    f AS (
        SELECT 'i' || k AS a, 'l' || k AS b, 'total' AS name, CASE WHEN NOT more THEN 'CONSISTENT' WHEN (total + 100000 - most) / (total + 100000) <= 0.01 THEN 'MINOR_CONTRADICTION' ELSE 'MAJOR_CONTRADICTION' END AS category, NULL AS difference FROM d
        UNION ALL SELECT 'i' || k, 'l' || k, 'day', CASE abs(date_diff('day', ordered, shipped)) WHEN 0 THEN 'CONSISTENT' WHEN 1 THEN 'MINOR_CONTRADICTION' ELSE 'MAJOR_CONTRADICTION' END, NULL FROM d
        UNION ALL SELECT 'i' || k, 'p' || k, 'total', CASE WHEN o_orderpriority = '1-URGENT' THEN 'MAJOR_CONTRADICTION' WHEN o_orderpriority = '2-HIGH' THEN 'CONSISTENT' ELSE 'UNRESOLVED' END,
            CASE WHEN o_orderpriority = '2-HIGH' THEN 'partial_payment' END FROM d)
    SELECT * FROM f"""
)
def contradiction_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's invoice against its lines, which should add up to it (every third is billed more), and against a payment of too much or of a part."""
    orders, lines = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    by_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(cents).alias("items"), F.sum(cents).alias("total"), F.min("l_shipdate").alias("shipped"))
    both = graph.cut(orders.select("o_orderkey", "o_orderdate", "o_orderpriority").join(by_order, "o_orderkey"))
    key, billed = F.col("o_orderkey").cast("string"), F.col("total") + F.when(F.col("o_orderkey") % 3 == 0, 100000).otherwise(0)
    ids = {letter: F.concat(F.lit(letter), key) for letter in "ilp"}
    links = both.select(F.explode(F.array(*[F.struct(ids["i"].alias("a"), ids[x].alias("b")) for x in "lp"])).alias("x")).select("x.*", F.lit("EXPLICIT").alias("status"))

    def claim(letter: str, name: str, field: str, values: Column, settles: bool = False) -> Column:
        says = F.lit(settles) & (F.col("o_orderpriority") == "2-HIGH")
        return F.struct(ids[letter].alias("id"), F.lit(name).alias("name"), F.lit(field).alias("field"), values.alias("values"), F.lit(settles).alias("settles"), says.alias("says_partial"))

    paid = F.when(F.col("o_orderpriority") == "1-URGENT", billed + 500000).otherwise(F.floor(billed / 2))
    texts = lambda *c: F.array(*[x.cast("string") for x in c])
    made = [
        claim("i", "total", "amount", texts(billed)), claim("l", "total", "amount", F.transform("items", lambda x: x.cast("string"))), claim("p", "total", "amount", texts(paid), True),
        claim("i", "day", "date", texts(F.col("o_orderdate").cast("date"))), claim("l", "day", "date", texts(F.col("shipped").cast("date"))),
    ]
    found = contradictions.findings(links, both.select(F.inline(F.array(*made))))
    return found.select("a", "b", "name", "category", "difference")


@query(
    """WITH m AS (
        SELECT 'PO' || c_custkey AS v, 'c' || c_custkey AS id, 'firm' || c_custkey AS vendor, 1 AS kind, NULL AS invoice FROM customer
        UNION ALL SELECT 'PO' || o_custkey, 'i' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'firm' || o_custkey END, 2, o_orderkey FROM orders
        UNION ALL SELECT 'APR' || o_orderkey, 'i' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'firm' || o_custkey END, 2, o_orderkey FROM orders
        UNION ALL SELECT 'APR' || o_orderkey, 'a' || o_orderkey, NULL, 3, NULL FROM orders WHERE o_orderkey % 3 = 0),
    p AS (
        SELECT x.v, x.id AS a, y.id AS b, x.vendor IS NOT NULL AND y.vendor IS NOT NULL AND x.vendor <> y.vendor AS unlike, x.invoice <> y.invoice AS other_invoice,
            x.vendor IS NOT DISTINCT FROM y.vendor AS same, least(x.kind, y.kind) AS k1, greatest(x.kind, y.kind) AS k2
        FROM m x JOIN m y ON x.v = y.v AND x.id < y.id),
    f AS (SELECT v, vendor, min(id) AS id FROM m GROUP BY v, vendor),
    g AS (SELECT v, min(id) AS id FROM f WHERE vendor IS NOT NULL GROUP BY v)
    SELECT a, b, p.v AS identifier, CASE WHEN unlike THEN 'CONFLICTING' ELSE 'EXPLICIT' END AS status,
        CASE k1 WHEN 1 THEN 'PURCHASE_ORDER' WHEN 2 THEN 'INVOICE' ELSE 'APPROVAL' END || '_TO_' || CASE k2 WHEN 1 THEN 'PURCHASE_ORDER' WHEN 2 THEN 'INVOICE' ELSE 'APPROVAL' END AS relationship,
        concat_ws(',', CASE WHEN other_invoice THEN 'invoice' END, CASE WHEN unlike THEN 'vendor' END) AS conflicts
    FROM p WHERE CASE WHEN same THEN EXISTS (SELECT 1 FROM f WHERE f.v = p.v AND f.id = p.a)
        WHEN unlike THEN EXISTS (SELECT 1 FROM g WHERE g.v = p.v AND g.id IN (p.a, p.b)) AND EXISTS (SELECT 1 FROM f WHERE f.v = p.v AND f.id = p.a) AND EXISTS (SELECT 1 FROM f WHERE f.v = p.v AND f.id = p.b)
        ELSE EXISTS (SELECT 1 FROM f WHERE f.v = p.v AND f.id = p.a) AND EXISTS (SELECT 1 FROM f WHERE f.v = p.v AND f.id = p.b) END"""
)
def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.links(evidence.facts(_papers(spark, sf_dir)))
    return found.select("a", "b", "identifier", "status", "relationship", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    """WITH l AS (SELECT 'c' || o_custkey AS root, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer))
    SELECT 'c' || c_custkey AS root, 'c' || c_custkey AS id, 0 AS hop, 'c' || c_custkey AS path FROM customer UNION ALL SELECT root, 'i' || k, 1, root || '>i' || k FROM l
    UNION ALL SELECT root, 'a' || k, 2, root || '>i' || k || '>a' || k FROM l WHERE k % 3 = 0"""
)
def evidence_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = evidence.members(_papers(spark, sf_dir))
    seeds = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return evidence.explore(members, seeds, 2).withColumn("path", F.array_join("path", ">"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'VERIFICATION_FAILED' WHEN o_orderkey % 4 = 0 THEN 'APPLICABILITY_MISMATCH' WHEN o_orderkey % 7 = 0 THEN 'SEVERAL_RULES_ON_LINE' END AS reason,
    'SATISFIED' AS replayed FROM orders"""
)
def counterfactual_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.lit("FORBID"), F.lit(">="), F.lit(150000.0)
    change = graph.counterfactual(*rule, F.col("o_totalprice"))
    verified = F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("VERIFIED")
    applicable = F.when(F.col("o_orderkey") % 4 == 0, "MISMATCH").otherwise("VERIFIED")
    reason = evidence.unresolved_reason(verified, applicable, F.lit(True), F.when(F.col("o_orderkey") % 7 == 0, 2).otherwise(1))
    return _t(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"), evidence.replay(*rule, F.col("o_totalprice"), change).alias("replayed"))


@query(
    """SELECT lang, CASE WHEN count(*) FILTER (quality = 0 AND toxic = 1) > 0 THEN 'NON_COMPLIANT' WHEN count(*) FILTER (quality = 0) > 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'COMPLIANT' END AS predicted_decision,
    count(*) FILTER (quality = 0) > 0 AS predicted_escalation, CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN true WHEN count(*) FILTER (toxic = 0) = count(*) THEN false END AS predicted_contradiction_detected
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def decisions_to_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    outcome = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "VIOLATION").when(F.col("quality") == 0, "NO_CONCLUSION").otherwise("SATISFIED")
    verification = F.when(F.col("quality") == 0, "ESCALATE").otherwise("VERIFIED")
    return cases.complete_predictions(rows.select("lang", outcome.alias("outcome"), verification.alias("verification"), (F.col("toxic") == 1).alias("contradiction")), "lang")


@query(
    """WITH e AS (
        SELECT user_id, epoch_us(ts) AS us, event_type = 'purchase' AND event_id % 5 = 0 AS closes, event_type, event_id, value,
            CASE event_type WHEN 'click' THEN 15 WHEN 'error' THEN 20 ELSE 0 END AS lost, ['communication', 'technical', 'problem_solving'][event_id % 3 + 1] AS named FROM events),
    f AS (SELECT *, CASE WHEN us - lag(us) OVER o <= 43200000000 AND NOT lag(closes) OVER o THEN 0 ELSE 1 END AS fresh FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, closes)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, closes ROWS UNBOUNDED PRECEDING) AS episode FROM f),
    h AS (
        SELECT user_id, min(us) AS start_us, max(us) AS end_us, CASE WHEN bool_or(closes) THEN 'disconnect' ELSE 'idle' END AS ended_by,
            count(*) FILTER (event_type IN ('click', 'error')) AS events, count(*) FILTER (event_type = 'signup') AS answers, greatest(0, least(100, 100 - sum(lost))) AS integrity,
            coalesce(CAST(printf('%.1f', sum(event_id % 11) FILTER (event_type = 'signup') * 10.0::DOUBLE / nullif(count(*) FILTER (event_type = 'signup'), 0)) AS DOUBLE), 0) AS qa,
            arg_max(value, us) FILTER (event_type = 'view' AND named = 'communication') AS c, arg_max(value, us) FILTER (event_type = 'view' AND named = 'technical') AS t,
            arg_max(value, us) FILTER (event_type = 'view' AND named = 'problem_solving') AS p
        FROM g GROUP BY user_id, episode),
    i AS (SELECT *, CAST(printf('%.1f', qa * 0.7::DOUBLE + integrity * 0.3::DOUBLE) AS DOUBLE) AS suitability FROM h)
    SELECT user_id, start_us, end_us, ended_by, events, answers, qa AS qa_score, CAST(integrity AS INTEGER) AS integrity,
        CASE WHEN integrity < 100 THEN 'Warning/Violations Detected' ELSE 'Clean' END AS proctoring_status,
        least(coalesce(c, qa), qa + 15) AS communication, least(coalesce(t, qa), qa + 10) AS technical, least(coalesce(p, qa), qa + 10) AS problem_solving, suitability,
        CASE WHEN suitability < 50 THEN 'Do Not Hire' WHEN suitability < 70 THEN 'Consider with Reservations' ELSE 'Recommend Hire' END AS outcome FROM i"""
)
def session_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as messages of interviews, which end at every fifth purchase or after twelve hours of silence."""
    e = F.col("event_type")
    kind = F.when(e == "signup", "answer").when(e.isin("click", "error"), "event").when(e == "view", "competency")
    kind = kind.when((e == "purchase") & (F.col("event_id") % 5 == 0), "disconnect").otherwise("note")
    named = F.element_at(F.array(*map(F.lit, evaluation.ROOM)), (F.col("event_id") % 3 + 1).cast("int"))
    content = F.when(e == "click", "Candidate switched tabs").when(e == "error", "No face detected").otherwise(named)
    score = F.when(e == "signup", (F.col("event_id") % 11).cast("double")).when(e == "view", F.col("value"))
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind"), content.alias("content"), score.alias("score"))
    found = evaluation.evaluate_sessions(rows, "user_id", "ts", "kind", "content", "score", "12 hours")
    return found.withColumnsRenamed({"session": "user_id"}).withColumns({"start_us": F.unix_micros("started"), "end_us": F.unix_micros("ended")}).drop("started", "ended")


@query(
    """SELECT event_id, o_orderkey FROM events JOIN orders ON ts - INTERVAL 25 YEAR >= o_orderdate + to_minutes(o_orderkey % 1440)
    AND ts - INTERVAL 25 YEAR <= o_orderdate + to_minutes(o_orderkey % 1440) + to_minutes(CASE WHEN o_orderkey % 100 = 0 THEN 14400 ELSE o_orderkey % 700 END) WHERE event_type = 'error'"""
)
def orders_open_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with every order that was open at their time of day and year; orders are open for minutes to days, and no key ties the two."""
    key, minutes = F.col("o_orderkey"), lambda c: F.make_dt_interval(mins=c.cast("int"))
    opened = F.col("o_orderdate").cast("timestamp") + minutes(key % 1440)
    closed = opened + minutes(F.when(key % 100 == 0, 14400).otherwise(key % 700))
    held = _t(spark, sf_dir, "orders").select("o_orderkey", opened.alias("opened"), closed.alias("closed"))
    errors = _t(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", (F.col("ts").cast("timestamp") - F.expr("INTERVAL 25 YEAR")).alias("moment"))
    return intervals.interval_join(errors, held, "moment", "opened", "closed").select("event_id", "o_orderkey")


@query(
    """WITH m AS (SELECT o_orderdate + to_minutes(o_orderkey % 1440) AS m, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
    SELECT event_id, o_orderkey FROM (SELECT event_id, ts - INTERVAL 25 YEAR AS t FROM events) ASOF LEFT JOIN m ON t >= m"""
)
def latest_order_before_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order before it, whoever's it is."""
    opened = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    events = _t(spark, sf_dir, "events").select("event_id", (F.col("ts").cast("timestamp") - F.expr("INTERVAL 25 YEAR")).alias("moment"))
    found = intervals.latest_before(events, _t(spark, sf_dir, "orders").select(opened.alias("opened"), "o_orderkey"), "moment", "opened")
    return found.select("event_id", F.col("found.o_orderkey").alias("o_orderkey"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, '"' || array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE
            WHEN ord(c) > 65535 THEN printf('\u%04x\u%04x', 55296 + ((ord(c) - 65536) >> 10), 56320 + ((ord(c) - 65536) & 1023)) WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\'
            WHEN c = chr(10) THEN '\n' WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN ord(c) < 32 OR ord(c) > 126 THEN printf('\u%04x', ord(c)) ELSE c END), '') || '"' AS q
        FROM conversations),
    h AS (
        SELECT conv_id, sha256('{"conv_id":' || conv_id || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || coalesce(q, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}') AS d
        FROM c),
    p AS (
        SELECT conv_id, count(*) AS n_rows, sum(('0x' || d[1:16])::UBIGINT) AS a, sum(('0x' || d[17:32])::UBIGINT) AS b, sum(('0x' || d[33:48])::UBIGINT) AS e, sum(('0x' || d[49:64])::UBIGINT) AS f
        FROM h GROUP BY conv_id)
    SELECT conv_id, n_rows, sha256(concat_ws(',', n_rows, a, b, e, f)) AS fingerprint FROM p"""
)
def conversation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each conversation's turns as canonical JSON, in whatever order they are stored."""
    return canonical.fingerprint(_t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), "conv_id")
