import hashlib
import random

import pytest
from pyspark.sql import functions as F

from adjudex.functions import stats, textlint
from adjudex.operators import metrics
from adjudex.plans import catalogue


def test_calibration_by_hand(spark):
    rows = spark.createDataFrame([(0.9, True), (0.9, True), (0.8, False), (0.2, False), (0.1, True)], "c double, ok boolean")
    r = metrics.calibration(rows, "c", "ok").first()
    assert abs(r["ece"] - 0.42) < 1e-9 and abs(r["brier"] - (0.01 + 0.01 + 0.64 + 0.04 + 0.81) / 5) < 1e-9
    edge = metrics.calibration(spark.createDataFrame([(1.0, True), (0.0, False)], "c double, ok boolean"), "c", "ok").first()
    assert edge["ece"] == 0.0 and edge["brier"] == 0.0


def test_unusable_confidences(spark):
    rows = spark.createDataFrame([("nan",), ("inf",), ("high",), ("1.5",), ("0.5",)], "c string")
    # Text is no confidence, whatever it says.
    assert [r[0] for r in rows.select(metrics.usable_confidence(F.col("c"))).collect()] == [None] * 5
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.1,), (1.5,), (0.5,)], "c double")
    assert [r[0] for r in rows.select(metrics.usable_confidence(F.col("c"))).collect()] == [None, None, None, None, 0.5]


def test_classification_by_hand(spark):
    C, N, I = "COMPLIANT", "NON_COMPLIANT", "INSUFFICIENT_EVIDENCE"
    rows = spark.createDataFrame([(C, C), (N, C), (I, C), (I, I)], "e string, p string")
    r = metrics.classification(rows, "e", "p", (C, N, I)).first()
    assert r["accuracy"] == 0.5 and abs(r["macro_f1"] - (0.5 + 0 + 2 / 3) / 3) < 1e-12


def test_not_measured_is_null(spark):
    r = spark.range(0).agg(metrics.ratio(F.sum("id"), F.count("*")).alias("x"), metrics.boolean_accuracy(F.col("id") > 0).alias("y")).first()
    assert r["x"] is None and r["y"] is None
    f = spark.range(1).select(metrics.f1_strict(F.lit(None).cast("double"), F.lit(0.5)).alias("a"), metrics.f1_counts(F.lit(0), F.lit(0), F.lit(3)).alias("b")).first()
    assert f["a"] is None and f["b"] == 0.0


def test_decision_rates_by_hand(spark):
    rows = spark.createDataFrame([(True, False, False, False, False), (True, False, False, True, True), (True, True, False, True, False), (False, True, True, True, False)], "committed boolean, none boolean, esc boolean, exp boolean, src boolean")
    c = [F.col(x) for x in ("committed", "none", "esc", "exp", "src")]
    r = rows.agg(*[v.alias(k) for k, v in metrics.decision_rates(*c).items()]).first()
    assert (r["unsupported_rate"], r["escalation_accuracy"], r["change_recall"], r["change_false_alarm"]) == (0.5, 0.5, 0.5, 0.5)
    assert abs(r["unsupported_of_committed"] - 1 / 3) < 1e-12


def test_grounded_citations(spark):
    rows = spark.createDataFrame([(["d1"], [], ["d1"]), (["d1", "d9"], [], ["d1", "d2"]), (["d2"], None, ["d2"]), (["d1"], ["d2"], ["d1", "d2"])], "sup array<string>, con array<string>, docs array<string>")
    good, every = metrics.grounded_share([F.col("sup"), F.col("con")], F.col("docs"))
    assert tuple(rows.agg(good, every).first()) == (5, 6)


def test_wilson(spark):
    r = spark.range(1).select(stats.wilson(F.lit(5), F.lit(10)).alias("a"), stats.wilson(F.lit(0), F.lit(0)).alias("b")).first()
    assert r["a"]["estimate"] == 0.5 and r["a"]["low"] < 0.5 < r["a"]["high"] and r["b"] is None


def test_mcnemar(spark):
    def p(b, c):
        rows = [(True, False)] * b + [(False, True)] * c + [(True, True)]
        return stats.mcnemar(spark.createDataFrame(rows, "x boolean, y boolean"), "x", "y").first()

    assert p(0, 10)["p_value"] == 2 / 2**10 and p(0, 10)["p_value_ref"] == 1.0 and p(0, 10)["reported"]
    assert p(1, 1)["p_value"] == 1.0 and p(0, 0)["p_value"] is None


def test_holm(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "n string, p double").withColumn("f", F.lit(1))
    got = {r["n"]: r["p_adjusted"] for r in stats.holm("p", ["n"], "f")(rows).collect()}
    assert got["d"] is None and [round(got[k], 9) for k in "acb"] == [0.03, 0.06, 0.06]


def test_bootstrap(spark):
    def run(n):
        rows = spark.range(n * 5).select(F.lit("V1").alias("v"), (F.col("id") % n).alias("fam"), (F.col("id") % 3 > 0).alias("ok"))
        return stats.cluster_bootstrap(rows, "v", "fam", "ok", 200).first()

    few, many = run(19), run(24)
    assert few["low"] is None and few["n_clusters"] == 19
    assert many["low"] <= many["estimate"] <= many["high"] and many == run(24)


def test_bootstrap_query_has_the_reference_interval(spark, monkeypatch):
    """2,000 resamples of families in string order, seeded with ``version|family|...``."""
    families = {str(f): [(f + i) % 3 > 0 for i in range(f % 5 + 1)] for f in range(24)}
    data = spark.createDataFrame([("en", int(f), "good", "good" if ok else "bad") for f, x in families.items() for ok in x], "lang string, doc_id long, expected string, by_size string")
    monkeypatch.setattr(catalogue, "_scored_labels", lambda *_: data)
    got = catalogue.queries()["cluster_bootstrap"](spark, "").first()
    names = sorted(families)
    draw = random.Random(int(hashlib.sha256(("en|" + "|".join(names)).encode()).hexdigest()[:16], 16))
    values = []
    for _ in range(2000):
        outcomes = [v for f in [names[draw.randrange(24)] for _ in names] for v in families[f]]
        values.append(sum(outcomes) / len(outcomes))
    values.sort()
    assert (got["n_clusters"], got["low"], got["high"]) == (24, values[int(0.025 * 1999)], values[int(0.975 * 1999)])


@pytest.mark.parametrize("text,numbers", [("20% of 3 lakh", {20.0, 0.2, 3.0, 300000.0}), ("within 2 weeks", {2.0, 20160.0, 336.0, 14.0}), ("two managers", {2.0}), ("1,200.50 only", {1200.5}), ("", set())])
def test_numbers_in_text(spark, text, numbers):
    got = spark.range(1).select(textlint.numbers_in(F.lit(text)).alias("n")).first()["n"]
    assert numbers <= {round(x, 9) for x in got} and (numbers or not got)


def test_grounding_and_status(spark):
    r = spark.range(1).select(
        textlint.grounded(F.lit(14.0), textlint.numbers_in(F.lit("2 weeks"))).alias("a"), textlint.quoted(F.lit(" Must  be PAID "), F.lit("It must be paid.")).alias("b"), textlint.quoted(F.lit(""), F.lit("x")).alias("c"),
        textlint.compile_status([F.lit("x")], F.array(), F.lit(0.9)).alias("d"), textlint.compile_status([F.lit(None).cast("string")], F.array(), F.lit(0.9)).alias("e"), textlint.ambiguity(F.lit("High severity events are logged.")).alias("f"),
    ).first()
    assert r["a"] and r["b"] and not r["c"] and tuple(r["d"]) == ("NEEDS_REVIEW", 0.49) and tuple(r["e"]) == ("VALID", 0.9) and r["f"] is None


def test_deltas_and_leakage(spark):
    a, b = spark.createDataFrame([(0.5, 0.0)], "acc double, err double"), spark.createDataFrame([(0.75, 0.0)], "acc double, err double")
    got = {r["metric"]: (r["absolute"], r["relative"], r["improved"]) for r in metrics.deltas(a, b, {"acc": True, "err": False}).collect()}
    assert got == {"acc": (0.25, 0.5, True), "err": (0.0, None, False)}
    rows = spark.createDataFrame([("x", "TRAIN"), ("x", "TEST"), ("y", "DEV")], "t string, split string")
    assert metrics.leakage(rows, F.col("t"), "split").count() == 1
