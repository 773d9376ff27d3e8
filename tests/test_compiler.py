import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from adjudex.functions import stats
from adjudex.operators import compiler, evaluate as E, metrics, perturb, sessions
from adjudex.operators.rules import Evidence, Exemption, Facts, Group, Leaf, Rule, Temporal, condition_column, leaf_column, read_date, temporal_column


def leaf(entity, field, op, value=None, unit=None):
    return {k: v for k, v in {"entity": entity, "field": field, "operator": op, "value": value, "unit": unit}.items() if v is not None}


def rule(text, condition=None, kind="REQUIRE", **more):
    return {"rule_type": kind, "condition": condition, "action": "act on it", "confidence": 0.9, "source_text": text, **more}


def compiled(spark, *cases):
    """(rules by id, summary by policy) of (text, rules) cases."""
    rows = [(f"P{i}", text, a if isinstance(a, str) else json.dumps({"rules": a})) for i, (text, a) in enumerate(cases)]
    rules, summary = compiler.compile_policies(spark.createDataFrame(rows, "policy_id string, policy_text string, answer string"))
    return {r["rule_id"]: r for r in rules.collect()}, {r["policy_id"]: r for r in summary.collect()}


def deep(n):
    node = leaf("x", "a", "exists")
    for _ in range(n):
        node = {"logic": "NOT", "children": [node]}
    return node


def test_policies_compile(spark):
    timing = "Approval must be given before the payment."
    confirmed = "Confirmed violations must be reported to the board."
    level = "Backups must be kept (severity: critical)."
    kept = "Backups must be kept."
    limit = "Orders above 50 USD require review."
    over = leaf("order", "total", ">", 50, "USD")
    yes = leaf("backup", "kept", "==", True)
    rules, summary = compiled(
        spark,
        (timing, [rule(timing, kind="REQUIRE", entity="payment", required_evidence=[{"type": "approval", "description": "written approval"}], temporal={"kind": "before", "entity": "payment", "field": "payment_date", "reference": "now"})]),
        (confirmed, [rule(confirmed, leaf("violation", "confirmed", "==", True)), rule(confirmed, leaf("employee", "confirmed", "==", True))]),
        (level, [rule(level, yes, severity="critical")]),
        (kept, [rule(kept, yes, severity="high"), rule(kept, yes, severity="urgent"), rule(kept, {"logic": "IMPLIES", "children": [yes] * 3}), rule(kept, deep(6)), "no rule", rule(kept), rule(kept, yes, confidence=2), rule(kept, yes, ambiguities=["which?"])]),
        (limit, [rule(limit, over, "TRIGGER"), rule(limit, leaf("order", "total", ">", 51, "USD"), "TRIGGER"), rule(limit, leaf("order", "total", ">", 50), "TRIGGER"), rule("Orders over fifty", over, "TRIGGER"), rule(limit, {"logic": "AND", "children": [over, leaf("order", "state", "in", ["a", 7])]}, "TRIGGER")]),
        ("No order may be late.", [rule("No order may be late.", leaf("order", "late", "==", True))]),
        ("Keep it.", "```json\n" + json.dumps({"rules": []}) + "\n```"),
        ("Keep it.", "sorry"),
        (" ", [rule(kept, yes)]),
    )
    assert rules["P0-R001"]["temporal"] is None and rules["P0-R001"]["evidence"][0]["match"] == {"timing": "before_payment"} and rules["P0-R001"]["status"] == "VALID"
    assert [rules[f"P1-R00{i}"]["rule_type"] for i in (1, 2)] == ["TRIGGER", "REQUIRE"] and rules["P1-R001"]["issues"] == ["retyped_as_trigger"]
    assert (rules["P2-R001"]["severity"], rules["P2-R001"]["severity_source"], rules["P2-R001"]["status"]) == ("critical", "policy_stated", "VALID")
    assert (rules["P3-R001"]["severity"], rules["P3-R001"]["issues"], rules["P3-R001"]["status"]) == ("medium", ["severity_discarded"], "VALID")
    assert [rules[f"P3-R00{i}"]["errors"] for i in (2, 3, 4)] == [["severity"], ["condition"], ["condition"]]
    assert {rules[f"P3-R00{i}"]["status"] for i in (5, 6, 7)} == {"REJECTED"} and rules["P3-R006"]["errors"] == ["nothing_to_execute", "entity"]
    assert rules["P3-R008"]["ambiguities"] == ["reported: which?"] and rules["P3-R008"]["confidence"] == 0.49
    assert rules["P4-R001"]["status"] == "VALID" and rules["P4-R001"]["numbers"] == [50.0] and rules["P4-R002"]["ambiguities"] == ["number_not_stated: 51.0"]
    assert rules["P4-R003"]["issues"] == ["no_unit: order.total"] and "not_quoted" in rules["P4-R004"]["ambiguities"]
    assert rules["P4-R005"]["numbers"] == [50.0, 7.0] and [x["field"] for x in rules["P4-R005"]["leaves"]] == ["total", "state"]
    assert "negation_dropped" in rules["P5-R001"]["ambiguities"] and rules["P5-R001"]["status"] == "NEEDS_REVIEW"
    assert [summary[f"P{i}"]["status"] for i in range(9)] == ["COMPILED", "COMPILED", "COMPILED", "COMPILED_WITH_REVIEW", "COMPILED_WITH_REVIEW", "COMPILED_WITH_REVIEW", "REJECTED", "FAILED", "FAILED"]
    assert tuple(summary["P3"][c] for c in ("extracted", "valid", "needs_review", "rejected")) == (8, 1, 1, 6)


def test_policy_ids(spark):
    got = spark.range(1).select(compiler.policy_id(F.lit(" Some  Policy\n")).alias("a"), compiler.policy_id(F.lit("some policy")).alias("b")).first()
    assert got["a"] == got["b"] and got["a"].startswith("POL-") and len(got["a"]) == 14


def test_typed_facts_read_as_their_text_does(spark):
    rows = spark.createDataFrame([(1, 5.0, 7), (2, float("nan"), None), (3, float("inf"), 50), (4, None, 5)], "id int, d double, i int").withColumns({"t": F.lit("2024-01-09").cast("timestamp_ntz"), "b": F.col("id") == 1})
    typed = Facts({f"x.{c}": F.col(c) for c in "ditb"}).bind(rows)
    text = Facts({f"x.{c}": F.col(c).cast("string") for c in "ditb"})
    tests = [Leaf("x", "d", ">", 4), Leaf("x", "i", "between", ["1", "50"]), Leaf("x", "d", "==", 5), Leaf("x", "i", "in", [7, "50"]), Leaf("x", "t", "between", ["9 Jan 2024", "10 Jan 2024"]), Leaf("x", "t", "==", "2024-01-09"), Leaf("x", "b", "==", True), Leaf("x", "d", "exists"), Leaf("x", "i", "!=", "7")]
    got = rows.select(*[F.struct(leaf_column(x, typed).alias("a"), leaf_column(x, text).alias("b")).alias(f"c{n}") for n, x in enumerate(tests)]).collect()
    assert all(v["a"] == v["b"] for r in got for n, v in enumerate(r) if n != 7)
    t = Temporal("between", "x", "t", start="5 January 2024", end="10 January 2024")
    assert {r[0] for r in rows.select(temporal_column(t, typed)).collect()} == {True}
    assert read_date("2024-01-09T02:00:00+02:00") == read_date("9 Jan 2024")
    with pytest.raises(ValueError):
        Leaf("x", "t", "between", ["10 Jan 2024", "9 Jan 2024"])


def test_lists_are_searched_by_item(spark):
    rows = spark.createDataFrame([(["ab", "C d"],), (["abc"],), ([],), (None,)], "l array<string>")
    f = Facts({"x.l": F.col("l")}).bind(rows)
    assert [r[0] for r in rows.select(leaf_column(Leaf("x", "l", "contains", "c  D"), f)).collect()] == [True, False, False, None]
    assert [r[0] for r in rows.select(leaf_column(Leaf("x", "l", "contains", "b"), f)).collect()] == [False, False, False, None]


def test_results_in_full(spark):
    subjects = spark.createDataFrame([(1, "30 days", "no"), (2, "90", None), (3, None, "yes"), (4, "abc", "no"), (5, "10 days", None)], "subject_id int, age string, old string")
    evidence = spark.createDataFrame([(1, "Receipt", {}), (5, "Receipt", {})], "subject_id int, type string, attrs map<string,string>")
    over = Leaf("bill", "age", "<=", 60, "days")
    rules = [
        Rule("A", "REQUIRE", over, evidence=(Evidence("receipt"),), exceptions=(Exemption("old bills", Leaf("bill", "old", "==", True)),), action="chase"),
        Rule("B", "PROHIBIT", over, status="NEEDS_REVIEW"),
    ]
    got = {(r["subject_id"], r["rule_id"]): r for r in E.evaluate(subjects, rules, Facts({"bill.age": F.col("age"), "bill.old": F.col("old")}), evidence, details=True).collect()}
    assert {i: got[i, "A"]["verdict"] for i in range(1, 6)} == {1: "COMPLIANT", 2: "INDETERMINATE", 3: "INDETERMINATE", 4: "INDETERMINATE", 5: "COMPLIANT"}
    # An exception's fact is missed only where exceptions were looked at; unreadable facts are not missing.
    assert {i: got[i, "A"]["missing_facts"] for i in range(1, 6)} == {1: [], 2: ["bill.old"], 3: ["bill.age"], 4: [], 5: []}
    assert got[2, "A"]["reasons"] == ["condition_false", "exception_unknown"] and got[3, "A"]["reasons"] == ["condition_unknown"]
    assert got[1, "A"]["evidence_satisfied"] == ["receipt"] and [tuple(x) for x in got[2, "A"]["missing_evidence"]] == [("receipt", 1, 0)]
    assert got[2, "A"]["notes"] == ["bill.age taken in days"] and got[1, "A"]["notes"] == []
    assert [tuple(x) for x in got[1, "A"]["trace"]] == [("bill.age <= 60 days", True)] and len(got[2, "A"]["trace"]) == 2
    assert all(got[i, "B"]["verdict"] == "INDETERMINATE" and got[i, "B"]["missing_facts"] == [] and got[i, "B"]["reasons"] == ["needs_review"] for i in range(1, 6))


def test_tabular_mode_has_all_operators(spark):
    values = list(itertools.product(("1", "5", "x y", None), repeat=2))
    wide = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "subject_id int, a string, b string")
    rows, trees = [], {}

    def add(name, tree):
        trees[name], numbers = tree, itertools.count(1)

        def walk(node, parent, depth):
            n = next(numbers)
            if isinstance(node, Group):
                rows.append((name, n, parent, depth, node.logic, *[None] * 8))
                for c in node.children:
                    walk(c, n, depth + 1)
                return
            v = node.value
            number = float(v) if isinstance(v, (int, float)) else None
            pair = v if node.op in ("between", "not_between") else (None, None)
            rows.append((name, n, parent, depth, None, f"t.{node.path}", node.op, number, v if isinstance(v, str) else None, [str(x) for x in v] if node.op in ("in", "not_in") else None, *map(lambda x: None if x is None else float(x), pair), node.inclusive))

        walk(tree, None, 1)

    a, b = Leaf("t", "a", ">", 2), Leaf("t", "b", "in", ["5", "x  Y"])
    add("implies", Group("IMPLIES", (a, b)))
    add("deep", Group("OR", (Group("AND", (Leaf("t", "a", "not_exists"), Leaf("t", "b", "exists"))), Group("NOT", (Group("IMPLIES", (b, a)),)))))
    add("range", Group("AND", (Leaf("t", "a", "between", [1, 5], inclusive=False), Leaf("t", "b", "not_contains", "Y"))))
    add("leaf", Leaf("t", "a", "not_exists"))
    add("out", Group("OR", (Leaf("t", "a", "not_in", ["1"]), Leaf("t", "b", "not_between", [2, 9]), Leaf("t", "b", "contains", "x"))))
    nodes = spark.createDataFrame(rows, "rule_id string, node_id int, parent_id int, depth int, logic string, path string, op string, number double, text string, items array<string>, low double, high double, inclusive boolean")
    long = wide.select("subject_id", F.inline(F.array(*[F.struct(F.lit(f"t.{c}").alias("path"), F.col(c).alias("raw")) for c in "ab"]))).filter("raw is not null")
    f = Facts({"t.a": F.col("a"), "t.b": F.col("b")})
    want = {(r["subject_id"], n): r[n] for r in wide.select("subject_id", *[condition_column(t, f).alias(n) for n, t in trees.items()]).collect() for n in trees}
    got = {(r["subject_id"], r["rule_id"]): r["result"] for r in E.evaluate_tabular(long, nodes, subjects=wide).collect()}
    assert got == want
    with pytest.raises(ValueError):
        E.evaluate_tabular(long, nodes.withColumn("op", F.lit("~")))


def test_exact_binomial(spark):
    pairs = [(0, 0), (0, 1), (3, 9), (10, 10), (200, 260), (4000, 4100), (100_000, 101_000)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", stats.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        n, m = r["b"] + r["c"], min(r["b"], r["c"])
        if n == 0:
            assert r["p"] is None
        elif n < 9000:
            exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)
            assert r["p"] == pytest.approx(exact, rel=1e-8)
        else:
            assert 0.02 < r["p"] < 0.03


def test_small_measures(spark):
    r = spark.range(1).select(
        metrics.usable_confidence(F.lit("0.5")).alias("text"), metrics.usable_confidence(F.lit(0.5)).alias("number"), metrics.only_confidence(F.array(F.lit(0.2), F.lit(0.3))).alias("two"), metrics.only_confidence(F.array(F.lit(1.0))).alias("one"), metrics.usable_confidence(F.lit(True)).alias("flag"),
    ).first()
    assert tuple(r) == (None, 0.5, None, 1.0, None)
    groups = spark.createDataFrame([("a", 1.0, None), ("b", 0.0, 0.5)], "g string, x double, y double")
    assert tuple(metrics.macro_by(groups, ["x", "y"]).first()) == (0.5, 2, 0.5, 1)
    assert [x["g"] for x in metrics.in_order(spark.createDataFrame([("z",), ("b",), ("a",)], "g string"), "g", ["z"]).collect()] == ["z", "a", "b"]
    lists = spark.createDataFrame([([], ["x"]), (["x"], ["y"]), ([], None)], "e array<string>, p array<string>")
    assert lists.agg(metrics.missing_flag_accuracy(F.col("e"), F.col("p")).alias("m")).first()["m"] == 0.5
    turns = sessions.round_robin(spark.range(20).withColumn("o", 100 - F.col("id")), "o", 3)
    assert {(x["o"], x["turn_of"]) for x in turns.collect()} == {(81 + i, i % 3) for i in range(20)}


def test_next_document_id(spark):
    docs = F.array(*[F.struct(F.lit(i).alias("doc_id"), F.lit("").alias("text")) for i in ("d2", "12a", "x")])
    assert spark.range(1).select(perturb.next_id(docs).alias("i")).first()["i"] == "d13"


def test_small_files_are_compiled_in_many_tasks(spark, tmp_path):
    rows = [(f"P-{i}", f"Orders above {i} USD require review.", '{"rules":[]}') for i in range(40)]
    spark.createDataFrame(rows, "policy_id string, policy_text string, answer string").coalesce(1).write.parquet(f"{tmp_path}/policies")
    policies = spark.read.parquet(f"{tmp_path}/policies")
    assert policies.rdd.getNumPartitions() == 1
    rules, summary = compiler.compile_policies(policies)
    assert rules.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert summary.count() == 40


def test_a_text_that_many_policies_share_is_checked_once(spark, monkeypatch):
    rule = lambda n: json.dumps({"rules": [{"rule_type": "REQUIRE", "condition": {"entity": "order", "field": "total", "operator": "<", "value": n, "unit": "USD"}, "action": "act on it", "confidence": 0.9, "source_text": f"Below {n} USD."}] * 2})
    rows = [(f"P-{i}", f"Below {i % 3} USD.", rule(i % 3)) for i in range(30)] + [("bad id", "Below 1 USD.", rule(1)), ("P-x", None, rule(1)), ("P-y", "Below 1 USD.", None)]
    policies = spark.createDataFrame(rows, "policy_id string, policy_text string, answer string")
    counted, check = [], compiler.check
    monkeypatch.setattr(compiler, "check", lambda rules, least: counted.append(rules.count()) or check(rules, least))
    rules, summary = compiler.compile_policies(policies)
    assert counted == [6]
    monkeypatch.undo()
    # As without sharing, row by row.
    alone = compiler.check(compiler.extract(policies.filter("policy_id <> 'bad id' and policy_text is not null")))
    said = lambda df: sorted((x.policy_id, x.rule_id, x.status, str(x.leaves), tuple(x.ambiguities), tuple(x.errors)) for x in df.collect())
    assert said(rules) == said(alone) and rules.columns == alone.columns and rules.count() == 60
    got = {x.policy_id: (x.status, x.extracted) for x in summary.collect()}
    assert len(got) == 33 and got["bad id"] == got["P-x"] == got["P-y"] == ("FAILED", 0) and got["P-7"][1] == 2
