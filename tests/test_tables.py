import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from adjudex.operators import graph, perturb, sessions, validate, versions
from adjudex.plans import catalogue
from adjudex.sources import files
from adjudex.streaming import interview


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_debounce_counts_from_the_last_accepted(spark):
    ts = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 3, 4, 9)]
    events = spark.createDataFrame([("a", t, i) for i, t in enumerate(ts)], "s string, ts timestamp_ntz, id long")
    assert rows(sessions.debounce(events, "s", "ts", "id"), "id") == [(0,), (2,), (4,), (5,)]


def test_debounce_folds_run_by_run(spark):
    """No array is longer than a run of close events, and the accepted ones are those of one fold."""
    at = [(i * i * 37 % 1000) * 700 for i in range(300)]
    events = spark.createDataFrame([("ab"[i % 2], datetime.fromtimestamp(t / 1000), i) for i, t in enumerate(at)], "s string, ts timestamp, id long")
    want = []
    for s in "ab":
        last = None
        for t, i in sorted((t, i) for i, t in enumerate(at) if "ab"[i % 2] == s):
            if last is None or t - last >= 2000:
                want.append((s, i))
                last = t
    got = sessions.debounce(events, "s", "ts", "id")
    assert rows(got, "s", "id") == sorted(want)
    assert "run" in got._jdf.queryExecution().analyzed().toString()


def test_integrity(spark):
    events = spark.createDataFrame([("a", 1, "STRIKE 1: Candidate exited Full-Screen mode."), ("a", 2, "Browser window lost focus."), ("b", 1, "Clipboard used"), ("b", 2, "FATAL STRIKE 3: Auto-terminated."), ("c", 1, "hello"), *[("d", i, "Multiple faces seen") for i in range(9)]], "s string, n int, d string")
    assert rows(sessions.integrity(events, "s", "n", "d"), "s", "integrity", "proctoring_status") == [("a", 75, "Warning/Violations Detected"), ("b", 0, "Terminated"), ("c", 100, "Clean"), ("d", 0, "Warning/Violations Detected")]


def test_scores(spark):
    r = spark.createDataFrame([(7.0,), (8.0,), (9.5,)], "s double").agg(sessions.qa_score(F.col("s")).alias("q")).first()
    assert r["q"] == 81.7
    s = spark.range(1).select(sessions.suitability(F.lit(100.0), F.lit(0)).alias("a"), sessions.hire_bucket(F.lit(69.9)).alias("b"), sessions.competency(F.lit(99.0), F.lit(80.0), 15).alias("c"), sessions.merged_integrity(F.lit(80), F.lit(55.9)).alias("d")).first()
    assert tuple(s) == (70.0, "Consider with Reservations", 95.0, 55)


def test_links_and_traversal(spark):
    docs = spark.createDataFrame([("d1", "Invoice INV-100 for PO-7700"), ("d2", "Order po7700, approval APR-55"), ("d3", "APR-55 was signed"), ("d4", "nothing")], "doc_id string, text string")
    star = graph.shared_identifiers(graph.identifiers(docs))
    assert rows(star, "hub", "id", "identifier") == [("d1", "d2", "PO7700"), ("d2", "d3", "APR55")]
    walk = graph.traverse(star.select(F.col("hub").alias("src"), F.col("id").alias("dst")), spark.createDataFrame([("d1",)], "id string"))
    assert rows(walk, "id", "hop") == [("d1", 0), ("d2", 1), ("d3", 2)]


@pytest.mark.parametrize("mode,op,region,direction,target", [("FORBID", ">", "<=", "decrease", 1000.0), ("FORBID", ">=", "<", "decrease", None), ("REQUIRE", "<", "<", "decrease", None), ("REQUIRE", "<=", "<=", "decrease", 1000.0), ("FORBID", "<", ">=", None, None)])
def test_counterfactual(spark, mode, op, region, direction, target):
    c = spark.range(1).select(graph.counterfactual(F.lit(mode), F.lit(op), F.lit(1000.0), F.lit(5000.0)).alias("c")).first()["c"]
    assert (c["region_op"], c["direction"], c["target"]) == (region, direction, target)
    assert (c["delta"] == -4000.0) if direction else (c["status"] == "NOT_REQUIRED")


def test_contradictions(spark):
    r = spark.range(1).select(
        graph.amount_contradiction(F.lit(20000.0), F.lit(8000.0), F.lit(True)).alias("a"), graph.amount_contradiction(F.lit(9000.0), F.lit(4000.0), F.lit(False)).alias("b"), graph.amount_contradiction(F.lit(9000.0), F.lit(9500.0), F.lit(True)).alias("c"),
        graph.field_contradiction(F.lit("approved"), F.lit("pending"), "approval_status").alias("d"), graph.field_contradiction(F.lit("Acme"), F.lit(" ACME "), "vendor").alias("e"), graph.verification(F.lit(0), F.lit(1), F.lit(False), F.lit(2)).alias("f"),
        graph.outcome(F.lit("FAILED"), F.lit("VIOLATION")).alias("g"), graph.merge_verdicts(F.lit("INDETERMINATE"), F.lit("SATISFIED")).alias("h"),
    ).first()
    assert tuple(r) == ("CONSISTENT", "UNRESOLVED", "MAJOR", "UNRESOLVED", "CONSISTENT", "ESCALATE", "NO_CONCLUSION", "SATISFIED")


def test_simple_rules(spark):
    lines = spark.createDataFrame([("FORBID TRANSACTION > INR 9,000 severity=high",), ('REQUIRE KEYWORD "signed copy"',), ("Transaction amounts must match.",), ("something else",)], "l string")
    got = lines.select(graph.parse_simple_rule(F.col("l")).alias("r")).select("r.*").collect()
    assert [r["kind"] for r in got] == ["AMOUNT", "KEYWORD", "AMOUNT_MATCH", "UNEVALUATED"] and got[0]["amount"] == 9000.0 and got[1]["keyword"] == "signed copy"


def test_perturbations_keep_or_change_labels(spark):
    cases = catalogue._cases(spark)
    got = perturb.suite(cases).collect()
    changing = {"missing_evidence", "contradictory_evidence", "conflicting_policy_statements"}
    for r in got:
        if r["perturbation_type"] in changing:
            assert r["decision"] == "INSUFFICIENT_EVIDENCE" and r["escalation"] and r["outcome_change"] == "CHANGED"
        elif r["perturbation_type"] != "temporal_ambiguity":
            assert r["outcome_change"] == "UNCHANGED"
    by = {(r["perturbation_type"], r["case_id"]): r for r in got}
    assert by["numerical_noise", "OB-01-1A"]["document_set"][0]["text"].startswith("Invoice of $1200.00")
    assert by["numerical_noise", "OB-02-1B"]["document_set"][1]["text"].endswith("15.0% discount.")
    assert by["entity_name_variation", "OB-01-1A"]["document_set"][0]["text"].endswith("from ACME TRADING COMPANY.")
    assert ("document_ordering", "OB-03-2A") not in by and by["irrelevant_documents", "OB-01-1A"]["document_set"][3]["doc_id"] == "d4"
    assert perturb.suite_differences(perturb.suite(cases), cases).isEmpty()


def test_validation(spark):
    records = spark.createDataFrame([("r1", ["d1"]), ("r2", ["d2"])], "perturbation_id string, docs array<string>")
    predictions = spark.createDataFrame([("r1", "COMPLIANT", ["d1"]), ("r1", "MAYBE", ["d9", "d9"]), ("r9", "COMPLIANT", None)], "perturbation_id string, predicted_decision string, predicted_supporting_evidence array<string>")
    got = validate.check_predictions(predictions, records, "docs")
    assert sorted(tuple(r["errors"]) for r in got.collect()) == [("id_repeated",), ("id_repeated", "unknown_decision", "predicted_supporting_evidence_repeats", "predicted_supporting_evidence_not_in_set"), ("id_unknown",)]
    assert validate.status(got).first()["status"] == "INVALID"


def test_counterfactual_anchors(spark):
    docs = F.array(F.lit("d1"), F.lit("d2"))

    def score(a, b):
        return spark.range(1).select(validate.counterfactual_correct(validate.anchors(F.lit(a), docs), validate.anchors(F.lit(b), docs)).alias("x")).first()["x"]

    assert score("Under EXP-1.0 d1 must show 500", "500 in d1 by EXP-1.0") is True
    assert score("d1 shows 500", "d1 shows 700") is False
    assert score("d1 and d2", "d1") is None


def test_versions(spark):
    cases = spark.createDataFrame([("a", "VIOLATION", "SATISFIED", "VERIFIED", "VERIFIED", False, False, False, False, "NON_COMPLIANT"), ("b", None, "SATISFIED", "FAILED", "VERIFIED", True, False, False, False, "INSUFFICIENT_EVIDENCE")], "case_id string, verdict string, legacy_verdict string, verified string, applicable string, missing_critical boolean, major_open boolean, low_confidence boolean, high_risk boolean, expected_decision string")
    made = {v.name: versions.predict(cases, v) for v in versions.VERSIONS}
    got = {r["version"]: (r["coverage"], r["accuracy"]) for r in versions.compare(cases, made, validate.DECISIONS).collect()}
    assert got["V1"] == (0.0, None) and got["V2"] == (1.0, 0.0) and got["V8"] == (1.0, 1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 30000)
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00\x80")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.text_files(spark, str(tmp_path)).collect()}
    assert len(got["a.txt"]) == 25000 and got["b.bin"] == files.BINARY_NOTE
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "raw", "source": "no"}, {"cell_type": "markdown", "source": "c"}]})
    r = spark.range(1).select(files.notebook_text(F.lit(book)).alias("x"), files.notebook_text(F.lit("plain")).alias("y")).first()
    assert tuple(r) == ("a\nb\nc", "plain")
    assert rows(files.url_list(spark.createDataFrame([(1, "a, ,b")], "id int, urls string"), "urls"), "url") == [("a",), ("b",)]
    rules = spark.createDataFrame([("p1", "r1"), ("p2", "r2")], "policy_id string, rule_id string")
    files.write_policies(rules, str(tmp_path / "rules"))
    assert rows(files.read_policy(spark, str(tmp_path / "rules"), "p2"), "rule_id") == [("r2",)]
    with pytest.raises(ValueError):
        files.read_policy(spark, str(tmp_path), "../x")


def test_prompts_are_asked_once(spark):
    asked = files.cached_by_prompt(spark.createDataFrame([(1, "s", "u"), (2, "s", "u"), (3, "s", "v")], "id int, sys string, usr string"), "sys", "usr", lambda s, u: s + u)
    assert rows(asked, "id", "answer") == [(1, "su"), (2, "su"), (3, "sv")]


def test_stage_failures_are_noted(spark):
    tables, failed = graph.stages(("a", lambda t: spark.range(1)), ("b", lambda t: 1 / 0), ("c", lambda t: t["a"]))
    assert set(tables) == {"a", "c"} and failed[0][0] == "b"


def test_streamed_strikes(spark, tmp_path):
    events = [("s1", datetime(2024, 1, 1, 0, 0, s), f"e{s}") for s in (0, 1, 5, 10, 20)] + [("s2", datetime(2024, 1, 1, 0, 0, 3), "only")]
    spark.createDataFrame(events, "session_id string, ts timestamp, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, ts timestamp, content string").parquet(str(tmp_path / "in"))
    q = interview.strikes(stream).writeStream.format("memory").queryName("strikes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert rows(spark.table("strikes"), "session_id", "content", "strike", "terminated") == [("s1", "e0", 1, False), ("s1", "e10", 3, True), ("s1", "e5", 2, False), ("s2", "only", 1, False)]


def test_streamed_windows(spark, tmp_path):
    events = [(datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 2, 7)] + [(datetime(2024, 1, 1, 3, 0), "a", 1.0)]
    spark.createDataFrame(events, "ts timestamp, k string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "in"))
    q = interview.tumbling(stream, "ts", "5 minutes", "k").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert rows(spark.table("windows"), "n", "total") == [(1, 1.0), (2, 2.0)]


def test_every_query_has_rows_or_an_empty_schema(spark):
    assert len(catalogue.queries()) >= 40 and set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert catalogue.queries()["policy_decision_by_customer"](spark, "/root/testdata/sf0.001").count() > 0


def test_proctor_scoring_counts_every_event(spark, tmp_path):
    kinds = ["signup", "purchase", "view", "click", "error"]
    events = [(i % 7, i, kinds[i % 5], datetime(2024, 1, 1, 0, i)) for i in range(1, 30)]
    spark.createDataFrame(events, "user_id long, event_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    lost = {"signup": 10, "purchase": 15, "click": 25}
    want = {}
    for user in range(7):
        own = [(i, k) for u, i, k, _ in events if u == user]
        fatal = any(k == "error" and i % 10 == 0 for i, k in own)
        want[user] = (0 if fatal else max(0, 100 - sum(lost.get(k, 0) for _, k in own)), fatal)
    got = catalogue.queries()["proctor_scoring"](spark, str(tmp_path)).collect()
    assert {r["user_id"]: (r["integrity"], r["is_terminated"]) for r in got} == want
