import json
import random

import pytest
from pyspark.sql import functions as F

from adjudex.operators import compiler, graph, ruletables
from adjudex.operators import evaluate as E
from adjudex.operators.rules import Evidence, Exemption, Facts, Group, Leaf, Rule, Temporal

PATHS = ["total", "due", "kind", "paid", "weight"]
VALUES = {
    "total": ["1,200", "1200 USD", "50", "USD 80", "free", "", None],
    "due": ["2024-03-01", "5 Mar 2024", "2023-12-31", "soon", None],
    "kind": ["Gold", " gold ", "silver", "7", "2024-03-01", None],
    "paid": ["yes", "no", "true", "False", "maybe", None],
    "weight": ["2 kg", "1500 g", "3", "0.5 kg", None],
}


def random_leaf(r):
    path = r.choice(PATHS)
    number = {"total": [50, 80, 1200], "weight": [1.5, 2, 3]}
    if path in number:
        unit = r.choice([None, {"total": "USD", "weight": "kg"}[path]])
        op = r.choice([">", ">=", "<", "<=", "==", "!=", "between", "not_between", "in", "not_in", "exists", "not_exists"])
        v = r.choice(number[path])
        value = None if "exists" in op else [50, 1200] if "between" in op else [v, 3] if op in ("in", "not_in") else v
        return {"entity": "bill", "field": path, "operator": op, "value": value, "unit": unit, "inclusive": r.choice([True, False])}
    if path == "due":
        op = r.choice([">", "<=", "==", "between", "exists"])
        value = None if op == "exists" else ["2024-01-01", "2024-03-05"] if op == "between" else "2024-03-01"
    elif path == "paid":
        op, value = r.choice(["==", "!="]), r.choice([True, False])
    else:
        op = r.choice(["==", "!=", "in", "not_in", "contains", "not_contains"])
        value = r.choice([["gold", "7"], ["2024-03-01"]]) if op in ("in", "not_in") else r.choice(["gold", "7", "2024-03-01", "ol"])
    return {"entity": "bill", "field": path, "operator": op, "value": value}


def random_tree(r, depth=0):
    if depth == 3 or r.random() < 0.4:
        return random_leaf(r)
    logic = r.choice(["AND", "OR", "NOT", "IMPLIES"])
    n = {"NOT": 1, "IMPLIES": 2}.get(logic) or r.choice([2, 3])
    return {"logic": logic, "children": [random_tree(r, depth + 1) for _ in range(n)]}


def as_node(t):
    if "logic" in t:
        return Group(t["logic"], tuple(map(as_node, t["children"])))
    return Leaf(t["entity"], t["field"], t["operator"], t["value"], t.get("unit"), t.get("inclusive", True))


TEMPORALS = [
    {"kind": "before", "entity": "bill", "field": "due", "reference": "2024-03-02"},
    {"kind": "within", "entity": "bill", "field": "due", "reference": "bill.kind", "amount": 3, "unit": "month", "direction": "before"},
    {"kind": "older_than", "entity": "bill", "field": "due", "reference": "today", "amount": 10, "unit": "days"},
    {"kind": "between", "entity": "bill", "field": "due", "start": "2024-01-01", "end": "2024-03-04"},
]


def random_rule(r):
    kind = r.choice(["REQUIRE", "PROHIBIT", "TRIGGER"])
    rule = {"rule_type": kind, "condition": random_tree(r), "action": "act_on_it", "confidence": 0.9, "source_text": "x", "severity": None}
    if r.random() < 0.4:
        rule["temporal"] = r.choice(TEMPORALS)
    if kind != "PROHIBIT" and r.random() < 0.5:
        rule["required_evidence"] = [{"type": "Legal Review", "min_count": r.choice([1, 2]), "match": r.choice([None, {"by": "Ann"}])}]
    if r.random() < 0.5:
        rule["exception"] = [{"description": f"case {j}", "condition": random_tree(r, 2)} for j in range(r.choice([1, 2]))]
    return rule


def as_rule(rule, rule_id):
    t = rule.get("temporal")
    temporal = t and Temporal(t["kind"], t["entity"], t["field"], t.get("reference"), t.get("amount"), (t.get("unit") or "").rstrip("s") + "s" if t.get("unit") else None, t.get("direction", "after"), t.get("start"), t.get("end"))
    evidence = tuple(Evidence("legal_review", True, e["min_count"], tuple((e["match"] or {}).items())) for e in rule.get("required_evidence", []))
    exceptions = tuple(Exemption(x["description"], as_node(x["condition"])) for x in rule.get("exception", []))
    return Rule(rule_id, rule["rule_type"], as_node(rule["condition"]), temporal, evidence, exceptions, action="act_on_it", status="NEEDS_REVIEW")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(11)
    rules = [random_rule(r) for _ in range(30)]
    policies = spark.createDataFrame([(f"P{i // 10}", "x", json.dumps({"rules": rules[i : i + 10]})) for i in (0, 10, 20)], "policy_id string, policy_text string, answer string")
    # Stored, as a compiled policy is.
    place = str(tmp_path_factory.mktemp("rules") / "checked")
    compiler.check(compiler.extract(policies)).write.parquet(place)
    checked = spark.read.parquet(place)
    objects = [as_rule(x, f"P{i // 10}-R{i % 10 + 1:03d}") for i, x in enumerate(rules)]
    wide = spark.createDataFrame([(i, *[r.choice(VALUES[p]) for p in PATHS]) for i in range(120)], "subject_id int, " + ", ".join(f"{p} string" for p in PATHS))
    long = wide.select("subject_id", F.inline(F.array(*[F.struct(F.lit(f"bill.{p}").alias("fact"), F.col(p).alias("raw")) for p in PATHS]))).filter("raw is not null")
    items = [(i, r.choice(["legal review", "Legal_Review", "note"]), {"by": r.choice(["ann", "Bob"])}) for i in range(60) for _ in range(r.choice([1, 3]))]
    return checked, objects, wide, long, spark.createDataFrame(items, "subject_id int, type string, attrs map<string,string>")


COLUMNS = ("verdict", "severity", "action", "exception_applied", "missing_facts")


@pytest.mark.parametrize("supplied", [True, False])
def test_rules_as_data_equal_rule_objects(made, supplied):
    checked, objects, wide, long, items = made
    assert checked.filter("status = 'REJECTED'").select("rule_id", "errors").collect() == []
    now = F.lit("2024-03-20").cast("timestamp_ntz")
    items = items if supplied else None
    want = E.evaluate(wide, objects, Facts({f"bill.{p}": F.col(p) for p in PATHS}, now=now), items, include_needs_review=True)
    want = {(r["subject_id"], r["rule_id"]): tuple(r[c] for c in COLUMNS) for r in want.collect()}
    applies = wide.select("subject_id", F.explode(F.array(*map(F.lit, ("P0", "P1", "P2")))).alias("policy_id"))
    tables = ruletables.rule_tables(checked)
    # Repeated rows count once.
    got = ruletables.evaluate_rules(applies, tables, long.unionByName(long), items, now=now, include_needs_review=True)
    got = {(r["subject_id"], r["rule_id"]): tuple(r[c] for c in COLUMNS) for r in got.collect()}
    assert len(got) == 120 * 30
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert not wrong, (len(wrong), next(iter(wrong.items())), objects[[o.rule_id for o in objects].index(next(iter(wrong))[1])])
    assert len({v[0] for v in got.values()}) == 6


def test_pairs_that_apply_and_rules_under_review(made, spark):
    checked, _, _, long, items = made
    tables = ruletables.rule_tables(checked)
    applies = spark.createDataFrame([(1, "P0"), (1, "P0"), (2, "P1"), (999, "P2"), (3, "none")], "subject_id int, policy_id string")
    got = ruletables.evaluate_rules(applies, tables, long, items, now=F.lit("2024-03-20").cast("timestamp_ntz")).collect()
    assert sorted({(r["subject_id"], r["policy_id"]) for r in got}) == [(1, "P0"), (2, "P1"), (999, "P2")] and len(got) == 30
    review = {r["rule_id"] for r in checked.filter("status = 'NEEDS_REVIEW'").collect()}
    waits = [r for r in got if r["rule_id"] in review]
    assert {r["verdict"] for r in waits} == {"INDETERMINATE"} and all(r["missing_facts"] == [] for r in waits)


def test_of_unlike_facts_the_least_text_counts(made, spark):
    checked = made[0]
    facts = spark.createDataFrame([(1, "bill.kind", "silver"), (1, "bill.kind", "gold"), (1, "other.fact", "x")], "subject_id int, fact string, raw string")
    row = ruletables.place_facts(facts, ruletables.rule_tables(checked)).collect()
    assert len(row) == 1 and {v["norm"] for v in row[0]["facts"].values()} == {"gold"}


def test_tabular_mode_counts_repeated_facts_once_and_compares_dates(spark):
    facts = spark.createDataFrame([(1, "a", "60"), (1, "a", "60"), (1, "b", "70"), (1, "d", "2024-03-05"), (2, "d", "2023-03-05"), (3, "d", "soon")], "subject_id int, path string, raw string")
    schema = "rule_id string, node_id int, parent_id int, depth int, logic string, path string, op string, number double, text string, items array<string>, low double, high double, inclusive boolean"
    rest = [None] * 4
    nodes = [("R", 1, None, 1, "AND", None, None, None, None, *rest), ("R", 2, 1, 2, None, "a", ">", 50.0, None, *rest), ("R", 3, 1, 2, None, "b", ">", 50.0, None, *rest)]
    date = [("D", 1, None, 1, None, "d", ">", None, "2024-01-01", *rest)]
    got = {(r["subject_id"], r["rule_id"]): r["result"] for r in E.evaluate_tabular(facts, spark.createDataFrame(nodes + date, schema)).collect()}
    assert got == {(1, "R"): True, (2, "R"): None, (3, "R"): None, (1, "D"): True, (2, "D"): False, (3, "D"): None}
    with pytest.raises(ValueError):
        E.evaluate_tabular(facts, spark.createDataFrame([("D", 1, None, 1, None, "d", ">", None, "soon", *rest)], schema))


def _leaf(field, entity="expense", op=">", value=2000):
    return {"entity": entity, "field": field, "operator": op, "value": value, "unit": "USD"}


def _alias_rules(spark, *conditions, exception=()):
    rules = [{"rule_type": "REQUIRE", "condition": c, "exception": list(exception), "action": "act_on_it", "confidence": 0.9, "source_text": "x"} for c in conditions]
    # Cut off, as a compiled policy is stored.
    return graph.cut(compiler.check(compiler.extract(spark.createDataFrame([("P", "x", json.dumps({"rules": rules}))], "policy_id string, policy_text string, answer string"))))


RECORDS = "entity string, record_id int, field string, raw string"
OWN = [("expense", 1, "amount", "3400 USD"), ("expense", 1, "currency", "USD")]


@pytest.mark.parametrize(
    "leaf, records, renamed",
    [
        (_leaf("total_amount"), OWN, True),
        (_leaf("expense_amount"), OWN, True),
        (_leaf("Total"), OWN, True),
        (_leaf("total_amount"), [*OWN, ("expense", 1, "total_amount", "3400")], False),
        (_leaf("total_amount"), [("expense", 1, "currency", "USD")], False),
        (_leaf("total_amount"), [*OWN, ("expense", 2, "currency", "USD")], False),
        (_leaf("total_amount"), [*OWN, ("expense", 2, "amount", " ")], False),
        (_leaf("total_amount"), [], False),
        (_leaf("total_amount", "purchase_order"), [("purchase_order", 1, "amount", "5")], False),
        (_leaf("balance"), OWN, False),
        (_leaf("payment_amount"), OWN, False),
        ({"logic": "AND", "children": [_leaf("total_amount"), _leaf("amount", op="<", value=9000)]}, OWN, False),
    ],
)
def test_amounts_go_by_another_name_only_where_records_bear_it_out(spark, leaf, records, renamed):
    found = ruletables.amount_aliases(_alias_rules(spark, leaf), spark.createDataFrame(records, RECORDS)).collect()
    assert [(x.rule_id, x.entity, x.to_field) for x in found] == ([("P-R001", "expense", "amount")] if renamed else [])


def test_rules_with_an_alias_are_judged_by_the_amount(spark):
    checked = _alias_rules(spark, _leaf("total_amount"), _leaf("balance"), exception=[{"description": "small", "condition": _leaf("total", op="<", value=50)}])
    aliases = ruletables.amount_aliases(checked, spark.createDataFrame(OWN, RECORDS))
    assert sorted((x.rule_id, x.from_field) for x in aliases.collect()) == [("P-R001", "total"), ("P-R001", "total_amount"), ("P-R002", "total")]
    facts = spark.createDataFrame([(1, "expense.amount", "3400 USD"), (2, "expense.amount", "30 USD"), (3, "expense.amount", "300 USD")], "subject_id int, fact string, raw string")
    applies = facts.select("subject_id", F.lit("P").alias("policy_id"))

    def verdicts(tables):
        rows = ruletables.evaluate_rules(applies, tables, facts, include_needs_review=True).filter("rule_id = 'P-R001'").collect()
        return {x.subject_id: (x.verdict, x.missing_facts) for x in rows}

    assert verdicts(ruletables.rule_tables(checked, aliases)) == {1: ("COMPLIANT", []), 2: ("EXEMPT", []), 3: ("VIOLATION", [])}
    assert {v for v, _ in verdicts(ruletables.rule_tables(checked)).values()} == {"INDETERMINATE"}


def test_a_sibling_that_cannot_be_judged_keeps_a_line_from_being_compliant(spark):
    lines = [("a", "COMPLIANT"), ("a", "INDETERMINATE"), ("b", "COMPLIANT"), ("b", "NOT_APPLICABLE"), ("c", "INDETERMINATE"), ("c", "VIOLATION"), ("d", "EXEMPT"), ("d", "NOT_APPLICABLE"), ("e", "NOT_APPLICABLE"), ("f", "ACTION_REQUIRED"), ("f", None)]
    got = {x.line: x.verdict for x in ruletables.decide_lines(spark.createDataFrame(lines, "line string, verdict string"), "line").collect()}
    assert got == {"a": None, "b": "COMPLIANT", "c": "VIOLATION", "d": "EXEMPT", "e": "NOT_APPLICABLE", "f": "ACTION_REQUIRED"}


def test_rules_that_say_the_same_are_one_form(spark):
    rule = lambda n: {"rule_type": "PROHIBIT", "condition": _leaf("amount", value=n), "action": "act_on_it", "confidence": 0.9, "source_text": "x"}
    policies = [(f"P{i}", "x", json.dumps({"rules": [rule(100 * (i % 2)), rule(300)]})) for i in range(12)]
    checked = graph.cut(compiler.check(compiler.extract(spark.createDataFrame(policies, "policy_id string, policy_text string, answer string"))))
    tables = ruletables.rule_tables(checked)
    assert (tables.policies.count(), tables.rules.count(), tables.n_nodes) == (24, 3, 3)
    facts = spark.createDataFrame([(1, "expense.amount", "USD 250.50"), (2, "expense.amount", "1,000 USD"), (3, "expense.amount", "-5")], "subject_id int, fact string, raw string")
    applies = facts.select("subject_id", F.explode(F.array(*[F.lit(f"P{i}") for i in range(12)])).alias("policy_id"))
    got = {(x.subject_id, x.rule_id): x.verdict for x in ruletables.evaluate_rules(applies, tables, facts, include_needs_review=True).collect()}
    assert len(got) == 72
    for (subject, rule_id), verdict in got.items():
        limit = 300 if rule_id.endswith("2") else 100 * (int(rule_id[1:].split("-")[0]) % 2)
        assert verdict == ("VIOLATION" if {1: 250.5, 2: 1000, 3: -5}[subject] > limit else "COMPLIANT"), (subject, rule_id)


def test_thresholds_are_placed_as_by_counting(spark):
    for n in range(10):
        bounds = F.array(*[F.lit(2.0 * i) for i in range(n)]).cast("array<double>")
        steps = F.array(*[F.lit(2**k) for k in range(4, -1, -1)])
        rows = spark.range(-1, 20).select(F.col("id").cast("double").alias("x"), ruletables._place(bounds, steps, F.col("id").cast("double")).alias("at")).collect()
        assert [r.at and tuple(r.at) for r in rows] == [(sum(2.0 * i < r.x for i in range(n)), sum(2.0 * i <= r.x for i in range(n))) if n else None for r in rows]
