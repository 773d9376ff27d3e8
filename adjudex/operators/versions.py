"""Versions of the evaluation pipeline and their comparison."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .metrics import classification, grounded_share, grouping_sets, ratio


@dataclass(frozen=True)
class Version:
    """What a version switches on; each includes those before it."""

    name: str
    graph: bool = False
    compiled: bool = False
    links: bool = False
    contradictions: bool = False
    verification: bool = False
    counterfactual: bool = False
    uncertainty: bool = False


_FLAGS = ("graph", "compiled", "links", "contradictions", "verification", "counterfactual", "uncertainty")
VERSIONS = tuple(Version(f"V{i + 1}", **{f: True for f in _FLAGS[:i]}) for i in range(8))


def predict(cases: DataFrame, version: Version) -> DataFrame:
    """Labels of a version from the columns that the graph stages give a case.

    Needs case_id, verdict, legacy_verdict, verified, applicable,
    missing_critical, major_open, low_confidence, high_risk. A version without
    a graph parses nothing: its predictions are an empty table.
    """
    if not version.graph:
        return cases.limit(0).select("case_id", F.lit("").alias("predicted_decision"), F.lit(False).alias("predicted_escalation"))
    verdict = graph.merge_verdicts(F.col("verdict"), F.col("legacy_verdict")) if version.compiled else F.col("legacy_verdict")
    verified = F.col("verified") if version.verification else F.lit("VERIFIED")
    if version.uncertainty:
        state = graph.uncertainty_state(verified, verdict, F.col("missing_critical"), F.col("applicable"), F.col("major_open"))
        label = F.when(state == "CONDITIONAL", "INSUFFICIENT_EVIDENCE").otherwise(state)
        reasons = graph.escalation_reasons(F.col("missing_critical"), F.col("applicable"), F.col("major_open"), F.col("low_confidence"), F.col("high_risk"))
        return cases.select("case_id", label.alias("predicted_decision"), (F.size(reasons) > 0).alias("predicted_escalation"))
    result = graph.outcome(verified, verdict)
    label = F.when(result == "VIOLATION", "NON_COMPLIANT").when(result.isin("SATISFIED", "COMPLIANT"), "COMPLIANT").otherwise("INSUFFICIENT_EVIDENCE")
    return cases.select("case_id", label.alias("predicted_decision"), ((result == "ESCALATE") | (F.lit(version.contradictions) & F.col("major_open"))).alias("predicted_escalation"))


def compare(records: DataFrame, predictions: Mapping[str, DataFrame], labels: tuple[str, ...], key: str = "case_id", expected: str = "expected_decision") -> DataFrame:
    """Measures by version over the same records, and the share of them answered; versions are a grouping column."""
    rows = None
    for name, p in predictions.items():
        own = records.select(key, expected).join(p.select(key, "predicted_decision"), key, "left").withColumn("version", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    answered = rows.groupBy("version").agg(ratio(F.count("predicted_decision"), F.count("*")).alias("coverage"))
    scored = classification(rows.filter("predicted_decision is not null"), expected, "predicted_decision", labels, "version")
    return answered.join(scored, "version", "left")


def realised(proof: DataFrame) -> DataFrame:
    """(version, status): PASS if all its components were used in all records, FAIL if one never was, else PARTIAL."""
    per = proof.groupBy("version", "component").agg(F.count_if("used").alias("k"), F.count("*").alias("n"))
    return per.groupBy("version").agg(F.when(F.min("k") == 0, "FAIL").when(F.count_if(F.col("k") < F.col("n")) == 0, "PASS").otherwise("PARTIAL").alias("status"))


def mask_failed(metrics: DataFrame, status: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Quality measures, their intervals too, are NULL for a version that failed."""
    joined = metrics.join(F.broadcast(status), "version", "left")
    return joined.select(*[F.when(F.col("status") != "FAIL", F.col(c)).alias(c) if c in names else F.col(c) for c in metrics.columns], "status")


def citation_validity(records: DataFrame, cited: str, documents: str, keys: tuple[str, ...]) -> DataFrame:
    """Pooled valid citations over all, overall and by each key."""
    good, every = grounded_share([F.col(cited)], F.col(documents))
    return grouping_sets(records, keys, [good.alias("valid"), every.alias("cited")]).withColumn("rate", ratio(F.col("valid"), F.col("cited")))


def review_labels(reviews: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Human verdicts as labels, and those that give none."""
    label = F.when(verdict.isin("VIOLATION", "NON_COMPLIANT"), "NON_COMPLIANT").when(verdict.isin("SATISFIED", "COMPLIANT"), "COMPLIANT").when(verdict.isin("INCONCLUSIVE", "NEEDS_EVIDENCE"), "INSUFFICIENT_EVIDENCE")
    marked = reviews.withColumn("predicted_decision", label)
    return marked.filter("predicted_decision is not null"), marked.filter("predicted_decision is null").drop("predicted_decision")
