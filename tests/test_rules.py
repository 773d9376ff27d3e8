import itertools

import pytest
from pyspark.sql import functions as F

from adjudex.functions import scalars as S
from adjudex.operators import evaluate as E
from adjudex.operators.rules import Evidence, Exemption, Facts, Group, Leaf, Rule, Temporal, condition_column, leaf_column, temporal_column

TRI = (True, False, None)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


@pytest.mark.parametrize(
    "text,number",
    [("12", 12.0), ("10,000", 10000.0), ("1_000", 1000.0), (" 3.5 ", 3.5), (".5", 0.5), ("1e3", 1000.0), ("12d", None), ("nan", None), ("inf", None), ("1e999", None), ("", None), ("true", None)],
)
def test_numbers(spark, text, number):
    assert one(spark, x=S.as_number(F.lit(text)))["x"] == number


@pytest.mark.parametrize(
    "text,iso",
    [
        ("2024-03-05", "2024-03-05 00:00:00"), ("2024-03-05T10:30", "2024-03-05 10:30:00"), ("2024-03-05T10:30:00Z", "2024-03-05 10:30:00"), ("2024-03-05T10:30:00+02:00", "2024-03-05 08:30:00"),
        ("20240301", "2024-03-01 00:00:00"), ("2024-W10-5", "2024-03-08 00:00:00"), ("5 Mar 2024", "2024-03-05 00:00:00"), ("March 5, 2024", "2024-03-05 00:00:00"), ("mar 5 2024", "2024-03-05 00:00:00"),
        ("2024", None), ("2024-3-1", None), ("05/03/2024", None), ("", None), ("2024-02-30", None),
    ],
)
def test_timestamps(spark, text, iso):
    found = one(spark, x=S.as_timestamp(F.lit(text)))["x"]
    assert (str(found) if found else None) == iso


def test_quantities_and_units(spark):
    r = one(
        spark, a=S.parse_quantity(F.lit("₹12,000")), b=S.parse_quantity(F.lit("30 days")), c=S.parse_quantity(F.lit("many")), d=S.convert(F.lit(2.0), F.lit("weeks"), F.lit("days")), e=S.convert(F.lit(2.0), F.lit("kg"), F.lit("days")),
        f=S.convert(F.lit(10.0), F.lit("USD"), F.lit("INR"), {"inr->$": 0.0125}), g=S.unit_dimension(F.lit("EUR")), h=S.shift(F.lit("2024-01-31").cast("timestamp_ntz"), 1, "months"),
    )
    assert tuple(r["a"]) == (12000.0, "INR") and tuple(r["b"]) == (30.0, "days") and r["c"] is None
    assert r["d"] == 14.0 and r["e"] is None and abs(r["f"] - 800) < 1e-9 and r["g"] == "currency" and str(r["h"]) == "2024-02-29 00:00:00"
    with pytest.raises(ValueError):
        S.check_rates({"USD->INR": 0})


def test_text_readings(spark):
    r = one(spark, a=S.normal_text(F.lit("  Große\t Straße ")), b=S.snake_case(F.lit("Written Approval!")), c=S.as_boolean(F.lit("Yes")), d=S.as_boolean(F.lit("maybe")), e=S.present(F.lit("  ")), f=S.present(F.lit(None).cast("string")))
    assert r == {"a": "grosse strasse", "b": "written_approval", "c": True, "d": None, "e": False, "f": False}


def test_kleene_truth_tables(spark):
    rows = spark.createDataFrame(list(itertools.product(TRI, TRI)), "a boolean, b boolean")
    f = Facts({"x.a": F.col("a").cast("string"), "x.b": F.col("b").cast("string")})
    a, b = Leaf("x", "a", "==", True), Leaf("x", "b", "==", True)
    got = rows.select("a", "b", *[condition_column(Group(g, (a, b)), f).alias(g) for g in ("AND", "OR", "IMPLIES")], condition_column(Group("NOT", (a,)), f).alias("NOT")).collect()
    for r in got:
        x, y = r["a"], r["b"]
        both = False if x is False or y is False else None if x is None or y is None else True
        either = True if x or y else None if x is None or y is None else False
        inverse = None if x is None else not x
        implied = True if inverse or y else None if inverse is None or y is None else False
        assert (r["AND"], r["OR"], r["IMPLIES"], r["NOT"]) == (both, either, implied, inverse)


@pytest.mark.parametrize("values", list(itertools.combinations_with_replacement(TRI, 3)))
def test_kleene_over_groups(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v boolean")
    r = rows.agg(S.kleene_all(F.col("v")).alias("all"), S.kleene_any(F.col("v")).alias("any")).first()
    assert r["all"] == (False if False in values else None if None in values else True)
    assert r["any"] == (True if True in values else None if None in values else False)


def test_membership_is_unknown_only_if_every_item_is(spark):
    f = Facts({"x.n": F.lit("abc"), "x.gone": F.lit(None).cast("string")})
    r = one(spark, mixed=leaf_column(Leaf("x", "n", "in", [1, "zzz"]), f), unknown=leaf_column(Leaf("x", "n", "in", [1, 2]), f), gone=leaf_column(Leaf("x", "gone", "in", ["a"]), f), not_mixed=leaf_column(Leaf("x", "n", "not_in", [1, "zzz"]), f))
    assert r == {"mixed": False, "unknown": None, "gone": None, "not_mixed": True}


VERDICTS = {
    ("REQUIRE", True): ("COMPLIANT", "VIOLATION", "INDETERMINATE"),
    ("REQUIRE", False): ("VIOLATION",) * 3,
    ("PROHIBIT", True): ("VIOLATION",) * 3,
    ("PROHIBIT", False): ("COMPLIANT",) * 3,
    ("TRIGGER", True): ("COMPLIANT", "VIOLATION", "INDETERMINATE"),
    ("TRIGGER", False): ("NOT_APPLICABLE",) * 3,
}


@pytest.mark.parametrize("kind,holds", [(k, h) for k in ("REQUIRE", "PROHIBIT", "TRIGGER") for h in TRI])
def test_verdicts(spark, kind, holds):
    rule = Rule("R", kind, evidence=(Evidence("receipt"),))
    p = F.lit(holds).cast("boolean")
    r = one(spark, ok=E.verdict_column(rule, p, [F.lit(1)], F.lit(True), []), missing=E.verdict_column(rule, p, [F.lit(0)], F.lit(True), []), absent=E.verdict_column(rule, p, [F.lit(0)], F.lit(False), []))
    assert tuple(r.values()) == (("INDETERMINATE",) * 3 if holds is None else VERDICTS[kind, holds])


@pytest.mark.parametrize("holds,verdict", [(True, "EXEMPT"), (False, "VIOLATION"), (None, "INDETERMINATE")])
def test_exceptions(spark, holds, verdict):
    rule = Rule("R", "PROHIBIT")
    assert one(spark, v=E.verdict_column(rule, F.lit(True), [], F.lit(True), [F.lit(False), F.lit(holds).cast("boolean")]))["v"] == verdict


def test_trigger_without_evidence_asks_for_action(spark):
    assert one(spark, v=E.verdict_column(Rule("R", "TRIGGER", action="call"), F.lit(True), [], F.lit(False), []))["v"] == "ACTION_REQUIRED"


def test_evaluate_and_decide(spark):
    subjects = spark.createDataFrame([(1, 3000.0, True), (2, 500.0, True), (3, None, True), (4, 3000.0, False)], "subject_id int, amount double, evidence_supplied boolean")
    evidence = spark.createDataFrame([(1, "Written Approval", {"timing": "Before_Payment"}), (2, "note", {})], "subject_id int, type string, attrs map<string,string>")
    rules = [
        Rule("A", "TRIGGER", Leaf("expense", "amount", ">", 2000, "USD"), evidence=(Evidence("written_approval", match=(("timing", "before_payment"),)),), action="ask", severity="high"),
        Rule("B", "PROHIBIT", Leaf("expense", "amount", ">", 2500), exceptions=(Exemption("small", Leaf("expense", "amount", "<", 100)),), severity="low"),
    ]
    got = E.evaluate(subjects, rules, Facts({"expense.amount": F.col("amount")}), evidence)
    v = {(r["subject_id"], r["rule_id"]): r["verdict"] for r in got.collect()}
    assert v == {(1, "A"): "COMPLIANT", (1, "B"): "VIOLATION", (2, "A"): "NOT_APPLICABLE", (2, "B"): "COMPLIANT", (3, "A"): "INDETERMINATE", (3, "B"): "INDETERMINATE", (4, "A"): "INDETERMINATE", (4, "B"): "VIOLATION"}
    d = {r["subject_id"]: (r["decision"], r["highest_severity"]) for r in E.decide(got, "subject_id").collect()}
    assert d == {1: ("NON_COMPLIANT", "low"), 2: ("COMPLIANT", None), 3: ("INDETERMINATE", None), 4: ("NON_COMPLIANT", "low")}
    c = {r["subject_id"]: r["confirmed"] for r in E.confirm_violations(got, "subject_id", ["B"]).collect()}
    assert c == {1: True, 2: False, 3: None, 4: True}


def test_both_modes_agree(spark):
    facts = [(i, a, b) for i, (a, b) in enumerate(itertools.product(("1", "5", "x", None), repeat=2))]
    wide = spark.createDataFrame(facts, "subject_id int, a string, b string")
    tree = Group("OR", (Group("AND", (Leaf("t", "a", ">", 2), Leaf("t", "b", "<=", 5))), Group("NOT", (Leaf("t", "b", "==", "x"),))))
    compiled = {r[0]: r[1] for r in wide.select("subject_id", condition_column(tree, Facts({"t.a": F.col("a"), "t.b": F.col("b")}))).collect()}
    long = wide.select("subject_id", F.inline(F.array(*[F.struct(F.lit(f"t.{c}").alias("path"), F.col(c).alias("raw")) for c in "ab"])))
    nodes = spark.createDataFrame(
        [("R", 1, None, 1, "OR", None, None, None, None), ("R", 2, 1, 2, "AND", None, None, None, None), ("R", 3, 2, 3, None, "t.a", ">", 2.0, None), ("R", 4, 2, 3, None, "t.b", "<=", 5.0, None), ("R", 5, 1, 2, "NOT", None, None, None, None), ("R", 6, 5, 3, None, "t.b", "==", None, "x")],
        "rule_id string, node_id int, parent_id int, depth int, logic string, path string, op string, number double, text string",
    )
    assert {r["subject_id"]: r["result"] for r in E.evaluate_tabular(long, nodes).collect()} == compiled


def test_temporal_edges(spark):
    f = Facts({"t.d": F.lit("2024-02-29"), "t.ref": F.lit("31 Jan 2024")}, now=F.lit("2024-03-01").cast("timestamp_ntz"))
    r = one(spark, field=temporal_column(Temporal("within", "t", "d", "t.ref", 1, "months"), f), gone=temporal_column(Temporal("before", "t", "none", "now"), f), between=temporal_column(Temporal("between", "t", "d", start="2024-02-29", end="2024-03-01"), f), old=temporal_column(Temporal("older_than", "t", "d", "now", 1, "days"), f))
    assert r == {"field": True, "gone": None, "between": True, "old": False}


@pytest.mark.parametrize("bad", [lambda: Leaf("X", "a", "==", 1), lambda: Leaf("x", "a", ">", "word"), lambda: Leaf("x", "a", "in", []), lambda: Leaf("x", "a", "between", [2, 1]), lambda: Leaf("x", "a", "exists", 1), lambda: Group("NOT", (Leaf("x", "a", "exists"),) * 2), lambda: Temporal("within", "x", "d", "now", 0, "days"), lambda: Temporal("within", "x", "d", "now", 1.5, "months"), lambda: Evidence("e", min_count=0), lambda: Rule("R", "ALLOW")])
def test_bad_rules_are_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_size_limits():
    leaf = Leaf("x", "a", "exists")
    deep = leaf
    for _ in range(6):
        deep = Group("NOT", (deep,))
    with pytest.raises(ValueError):
        Rule("R", "REQUIRE", deep)
    with pytest.raises(ValueError):
        Rule("R", "REQUIRE", Group("AND", (leaf,) * 50))
