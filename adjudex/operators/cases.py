"""Benchmark cases: identity, noise and checks; predictions from decisions, with those that have none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .validate import DECISIONS, errors

# Categories by number, splits by family, and the noise that scans make.
CATEGORIES = (
    "simple_compliance", "multi_document_compliance", "contradictory_evidence", "missing_evidence", "policy_exceptions",
    "temporal_violations", "entity_mismatch", "distractor_documents", "ocr_noise", "policy_paraphrasing", "ambiguous_policies",
    "adversarial_document_content", "prompt_injection_inside_documents", "conflicting_policies", "evidence_removal",
)
FAMILY_SPLITS = {1: "TRAIN", 2: "TRAIN", 3: "DEV", 4: "TEST"}
SCAN_NOISE = (("o", "0"), ("l", "1"), ("e", "c"), ("m", "rn"), ("i", "l"))


def case_identity(category: Column, family: Column, tag: Column) -> Column:
    """struct(case_id, family_id, split, difficulty_category) of category and family numbers and a tag; a family lies in one split."""
    number = F.lpad(category.cast("string"), 2, "0")
    splits = F.create_map(*[F.lit(x) for pair in FAMILY_SPLITS.items() for x in pair])
    return F.struct(
        F.format_string("OB-%s-%s%s", number, family.cast("string"), tag).alias("case_id"),
        F.format_string("FAM-%s-%s", number, family.cast("string")).alias("family_id"),
        F.try_element_at(splits, family.cast("int")).alias("split"),
        F.get(F.array(*map(F.lit, CATEGORIES)), category.cast("int") - 1).alias("difficulty_category"),
    )


def scanned(text: Column) -> Column:
    """A text as a bad scan gives it: one letter of every third word (from the second) of over three letters; digits never change."""

    def word(w: Column, i: Column) -> Column:
        core = F.regexp_replace(w, r"^[.,:;]+|[.,:;]+$", "")
        out = w
        for letter, seen in reversed(SCAN_NOISE):
            out = F.when(core.contains(letter), F.overlay(w, F.lit(seen), F.instr(w, letter), F.lit(1))).otherwise(out)
        return F.when((i % 3 == 1) & core.rlike(r"^\p{L}{4,}$"), out).otherwise(w)

    return F.concat(F.lit("| "), F.array_join(F.transform(F.split(text, " "), word), " "))


def check_cases(cases: DataFrame) -> DataFrame:
    """Adds ``errors``: ids, enumerations, documents, and evidence that names documents of the case, none on both sides."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    splits = F.size(F.collect_set("split").over(Window.partitionBy("family_id")))
    ids = F.transform("document_set", lambda d: d["doc_id"])
    sides = ("supporting_evidence", "contradicting_evidence")
    found = [
        ("id_missing", F.col("case_id").isNull() | (F.trim("case_id") == "")),
        ("id_repeated", n > 1),
        ("unknown_category", ~F.coalesce(F.col("difficulty_category").isin(*CATEGORIES), F.lit(False))),
        ("unknown_split", ~F.coalesce(F.col("split").isin(*FAMILY_SPLITS.values()), F.lit(False))),
        ("family_in_several_splits", splits > 1),
        ("unknown_decision", ~F.coalesce(F.col("expected_decision").isin(*DECISIONS), F.lit(False))),
        ("no_documents", F.size("document_set") < 1),
        ("documents_repeat", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("empty_document", F.exists("document_set", lambda d: F.coalesce(F.trim(d["text"]), F.lit("")) == "")),
        *[(f"{c}_not_in_set", F.size(F.array_except(c, ids)) > 0) for c in sides],
        *[(f"{c}_repeats", F.size(F.array_distinct(c)) != F.size(c)) for c in sides],
        ("document_on_both_sides", F.arrays_overlap(*sides)),
        ("escalation_missing", F.col("expected_escalation").isNull()),
    ]
    return cases.withColumn("errors", errors(*found))


def rule_matches(expected: Column, predicted: Column) -> Column:
    """Whether two texts name the same set of rule ids or, where either names none, are the same text but for case and spaces."""
    ids = [F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b([A-Z]{2,}-\d+(?:\.\d+)?)\b"), F.lit(1)))) for t in (expected, predicted)]
    plain = [F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")) for t in (expected, predicted)]
    return F.when((F.size(ids[0]) > 0) & (F.size(ids[1]) > 0), ids[0] == ids[1]).otherwise(plain[0] == plain[1])


def complete_predictions(decisions: DataFrame, key: str = "case_id") -> DataFrame:
    """A case's label, escalation and contradiction flag from its decisions (key, outcome, verification, contradiction).

    A violation outranks an open decision, which outranks compliance; one that
    sees a contradiction is enough, none only if all say so, else NULL.
    """
    outcome = F.col("outcome")
    label = F.when(outcome.isin("VIOLATION", "NON_COMPLIANT"), "NON_COMPLIANT").when(outcome.isin("SATISFIED", "COMPLIANT"), "COMPLIANT").otherwise("INSUFFICIENT_EVIDENCE")
    seen = F.col("contradiction")
    return decisions.groupBy(key).agg(
        graph.merged_decision(label).alias("predicted_decision"),
        (F.count_if(F.col("verification") == "ESCALATE") > 0).alias("predicted_escalation"),
        F.when(F.count_if(seen) > 0, True).when(F.count_if(~seen) == F.count("*"), False).alias("predicted_contradiction_detected"),
    )


def production_predictions(records: DataFrame, decisions: DataFrame, key: str = "case_id", conditional: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, skipped): the one uncertainty state of each record whose policy was compiled; others with the reason, never filled.

    ``decisions`` has key, state, compiled. CONDITIONAL is skipped unless
    ``conditional`` names its label.
    """
    per = decisions.groupBy(key).agg(F.count("*").alias("n"), F.min("state").alias("state"), F.bool_and(F.coalesce("compiled", F.lit(False))).alias("compiled"))
    label = F.when(F.col("state") == "CONDITIONAL", F.lit(conditional)).when(F.col("state").isin(*DECISIONS), F.col("state"))
    reason = F.when(F.col("n").isNull(), "NO_DECISION").when(F.col("n") > 1, "SEVERAL_DECISIONS").when(~F.col("compiled"), "NOT_COMPILED").when(label.isNull(), "STATE_HAS_NO_LABEL")
    marked = records.select(key).join(per, key, "left").select(key, label.alias("predicted_decision"), reason.alias("reason"))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").select(key, "reason")


def compiled_only(predictions: DataFrame, proof: DataFrame, key: str = "case_id") -> DataFrame:
    """Predictions of records proven (key, component, used) to rest on compiled decisions."""
    return predictions.join(proof.filter("component = 'compiled' and used").select(key).distinct(), key, "left_semi")


def pilot(records: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """The first ``n`` records by key, the same ones in every run; a pilot is asked for by its number."""
    return records.orderBy(key).limit(n)
