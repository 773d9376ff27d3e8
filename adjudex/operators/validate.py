"""Checks of records and predictions as error arrays; one bad row makes a set invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("COMPLIANT", "NON_COMPLIANT", "INSUFFICIENT_EVIDENCE")


def errors(*checks: tuple[str, Column]) -> Column:
    """Names of the checks that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]))


def check_records(records: DataFrame, types: tuple[str, ...], splits: tuple[str, ...] = ("TRAIN", "DEV", "TEST")) -> DataFrame:
    """Adds ``errors`` to perturbation records: ids, enumerations and duplicates."""
    n = F.count("*").over(Window.partitionBy("perturbation_id"))
    found = [
        ("id_missing", F.col("perturbation_id").isNull() | (F.trim("perturbation_id") == "")),
        ("id_repeated", n > 1),
        ("unknown_type", ~F.coalesce(F.col("perturbation_type").isin(*types), F.lit(False))),
        ("unknown_decision", ~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False))),
    ]
    if "split" in records.columns:
        found.append(("unknown_split", ~F.coalesce(F.col("split").isin(*splits), F.lit(False))))
    return records.withColumn("errors", errors(*found))


def check_predictions(predictions: DataFrame, records: DataFrame, documents: str | None = None) -> DataFrame:
    """Adds ``errors`` to predictions: unknown and repeated ids, unknown decisions, repeated or unknown documents cited."""
    n = F.count("*").over(Window.partitionBy("perturbation_id"))
    known = records.select("perturbation_id", F.lit(True).alias("__known"), *([F.col(documents).alias("__docs")] if documents else []))
    rows = predictions.join(known, "perturbation_id", "left")
    found = [
        ("id_unknown", F.col("__known").isNull()),
        ("id_repeated", n > 1),
        ("unknown_decision", ~F.coalesce(F.col("predicted_decision").isin(*DECISIONS), F.lit(False))),
    ]
    for c in predictions.columns:
        if c.startswith("predicted_") and c.endswith("_evidence"):
            found.append((f"{c}_repeats", F.coalesce(F.size(F.array_distinct(c)) != F.size(c), F.lit(False))))
            if documents and c != "predicted_missing_evidence":
                found.append((f"{c}_not_in_set", F.coalesce(F.size(F.array_except(c, "__docs")) > 0, F.lit(False))))
    return rows.withColumn("errors", errors(*found)).drop("__known", "__docs")


def status(checked: DataFrame) -> DataFrame:
    """One row: INVALID if any row has errors, with their number."""
    bad = F.count_if(F.size("errors") > 0)
    return checked.agg(F.when(bad > 0, "INVALID").otherwise("VALID").alias("status"), bad.alias("n_bad"), F.count("*").alias("n"))


def unpaired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("side", F.lit("a"))
    return left.unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("side", F.lit("b")))


def leaked_columns(df: DataFrame) -> list[str]:
    """Columns that give predictions away."""
    return [c for c in df.columns if c.startswith("predicted_")]


def release_report(cases: DataFrame, categories: int, splits: tuple[str, ...] = ("TRAIN", "DEV", "TEST")) -> DataFrame:
    """One row of booleans about a set of cases: unique ids, splits, families in one split, cells covered, no leaks."""
    family = cases.groupBy("family_id").agg(F.countDistinct("split").alias("s")).agg(F.max("s").alias("family_splits"))
    cells = cases.select("difficulty_category", "split").distinct().agg(F.count("*").alias("cells"))
    main = cases.agg(
        (F.count("*") == F.countDistinct("case_id")).alias("ids_unique"),
        (F.count_if(~F.col("split").isin(*splits)) == 0).alias("splits_known"),
        (F.count_if(~F.col("expected_decision").isin(*DECISIONS)) == 0).alias("decisions_known"),
        (F.countDistinct("difficulty_category") == categories).alias("categories_there"),
    )
    return main.join(family, how="cross").join(cells, how="cross").select("ids_unique", "splits_known", "decisions_known", "categories_there", (F.col("family_splits") <= 1).alias("families_whole"), (F.col("cells") == categories * len(splits)).alias("cells_covered"), F.lit(not leaked_columns(cases)).alias("no_predictions"))


def anchors(text: Column, doc_ids: Column) -> Column:
    """struct(rules, decisions, docs, numbers, unchanged) that a counterfactual names, each kind removed before the next is looked for."""
    rule = r"([A-Z]{2,}-\d+(?:\.\d+)?)"
    label = r"\b(NON_COMPLIANT|INSUFFICIENT_EVIDENCE|COMPLIANT)\b"
    rules = F.regexp_extract_all(text, F.lit(rule), F.lit(1))
    rest = F.regexp_replace(text, rule, " ")
    labels = F.regexp_extract_all(rest, F.lit(label), F.lit(1))
    rest = F.regexp_replace(rest, label, " ")
    words = F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))
    named = F.array_intersect(words, doc_ids)
    plain = F.aggregate(doc_ids, rest, lambda t, d: F.regexp_replace(t, F.concat(F.lit(r"\b"), d, F.lit(r"\b")), F.lit(" ")))
    numbers = F.regexp_extract_all(plain, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    tidy = [F.array_sort(F.array_distinct(x)) for x in (rules, labels, named, numbers)]
    return F.struct(*[x.alias(n) for x, n in zip(tidy, ("rules", "decisions", "docs", "numbers"))], text.rlike("(?i)no change").alias("unchanged"))


def counterfactual_correct(expected: Column, predicted: Column) -> Column:
    """True for equal anchors, false for one too many or another flag, NULL where one is missing."""
    kinds = ("rules", "decisions", "docs", "numbers")
    extra, gap = F.lit(False), F.lit(False)
    for k in kinds:
        extra = extra | (F.size(F.array_except(predicted[k], expected[k])) > 0)
        gap = gap | (F.size(F.array_except(expected[k], predicted[k])) > 0)
    return F.when(extra | (expected["unchanged"] != predicted["unchanged"]), F.lit(False)).when(~gap, F.lit(True))
