"""Classification, retrieval and calibration measures. What can't be measured is NULL, never 0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def boolean_accuracy(value: Column) -> Column:
    """The mean of the booleans that are there."""
    return F.avg(value.cast("int"))


def f1_strict(precision: Column, recall: Column) -> Column:
    """NULL where either is; 0 where both are 0."""
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(F.try_divide(2 * precision * recall, precision + recall))


def f1_counts(tp: Column, predicted: Column, expected: Column) -> Column:
    """From pooled counts: a measured 0 where only one of precision and recall is there."""
    return ratio(2 * tp, predicted + expected)


def set_overlap(expected: Column, predicted: Column) -> dict[str, Column]:
    """tp, predicted and expected counts of distinct items; NULL where no prediction was supplied."""
    known = predicted.isNotNull()
    return {
        "tp": F.when(known, F.size(F.array_intersect(expected, predicted))),
        "predicted": F.when(known, F.size(F.array_distinct(predicted))),
        "expected": F.when(known, F.size(F.array_distinct(expected))),
    }


def grounded_share(cited: Sequence[Column], documents: Column) -> tuple[Column, Column]:
    """(sum of citations that name a document of the set, sum of all citations), as aggregates over records; items count as often as cited."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cited])
    return F.sum(F.size(F.filter(every, lambda x: F.array_contains(documents, x)))), F.sum(F.size(every))


def label_counts(df: DataFrame, expected: str, predicted: str, labels: Sequence[str], *groups: str) -> DataFrame:
    """(groups, label, tp, fp, fn, tn) one against the rest, in one pass."""
    e, p = F.col(expected), F.col(predicted)
    each = F.inline(F.array(*[F.struct(F.lit(x).alias("label"), (e == x).alias("is_e"), (p == x).alias("is_p")) for x in labels]))
    rows = df.select(*groups, each)
    is_e, is_p = F.coalesce("is_e", F.lit(False)), F.coalesce("is_p", F.lit(False))
    return rows.groupBy(*groups, "label").agg(F.count_if(is_e & is_p).alias("tp"), F.count_if(~is_e & is_p).alias("fp"), F.count_if(is_e & ~is_p).alias("fn"), F.count_if(~is_e & ~is_p).alias("tn"))


def classification(df: DataFrame, expected: str, predicted: str, labels: Sequence[str], *groups: str) -> DataFrame:
    """accuracy, macro precision, recall, F1 and specificity (means of what is measured), and the multiclass MCC.

    MCC from the label counts: with s records, c right ones, p and t predicted
    and true ones of a label, (c s - sum p t) / sqrt((s^2 - sum p^2)(s^2 - sum t^2)).
    """
    per = label_counts(df, expected, predicted, labels, *groups)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    there = (F.col("tp") + F.col("fp") + F.col("fn")) > 0
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    per = per.withColumns(
        {
            "n": n,
            "p_": F.col("tp") + F.col("fp"),
            "t_": F.col("tp") + F.col("fn"),
            "precision": F.when(there, precision),
            "recall": F.when(there, recall),
            "f1": F.when(there, f1_counts(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))),
            "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )
    out = per.groupBy(*groups).agg(
        F.max("n").alias("n"),
        F.sum("tp").alias("right"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg("specificity").alias("specificity"),
        F.sum(F.col("p_") * F.col("t_")).alias("pt"),
        F.sum(F.col("p_") * F.col("p_")).alias("pp"),
        F.sum(F.col("t_") * F.col("t_")).alias("tt"),
    )
    s = F.col("n").cast("double")
    spread = (s * s - F.col("pp")) * (s * s - F.col("tt"))
    mcc = F.when(spread > 0, (F.col("right") * s - F.col("pt")) / F.sqrt(F.greatest(spread, F.lit(0.0))))
    return out.select(*groups, "n", ratio(F.col("right"), F.col("n")).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", "specificity", mcc.alias("mcc"))


def decision_rates(committed: Column, expects_none: Column, escalated: Column, expects_escalation: Column, source_escalation: Column) -> dict[str, Column]:
    """Unsupported decisions, by expected and by committed ones, and escalation measures, as aggregates.

    ``committed``: the prediction is a decision; ``expects_none``: evidence is
    expected to be insufficient. A changed record is one whose expected
    escalation differs from the source's.
    """
    unsupported = committed & expects_none
    changed = expects_escalation != source_escalation
    return {
        "unsupported_rate": ratio(F.count_if(unsupported), F.count_if(expects_none)),
        "unsupported_of_committed": ratio(F.count_if(unsupported), F.count_if(committed)),
        "escalation_accuracy": boolean_accuracy(escalated == expects_escalation),
        "change_recall": ratio(F.count_if(changed & (escalated == expects_escalation)), F.count_if(changed & escalated.isNotNull())),
        "change_false_alarm": ratio(F.count_if(~changed & (escalated != source_escalation)), F.count_if(~changed & escalated.isNotNull())),
        "automation_coverage": ratio(F.count_if(committed), F.count(F.lit(1))),
        "escalation_rate": ratio(F.count_if(escalated), F.count(escalated)),
    }


def usable_confidence(value: Column) -> Column:
    """Numbers from 0 to 1; NULL for others: text, booleans and NaN included."""
    number = F.when(~F.typeof(value).isin("string", "boolean"), value.try_cast("double"))
    return F.when(~F.isnan(number) & number.between(0.0, 1.0), number)


def only_confidence(entries: Column) -> Column:
    """The confidence of a list that has exactly one entry; NULL for any other list."""
    return F.when(F.size(entries) == 1, usable_confidence(F.get(entries, F.lit(0))))


def missing_flag_accuracy(expected: Column, predicted: Column) -> Column:
    """How often a list is predicted to be empty just where it is; unanswered rows don't count. An aggregate."""
    return boolean_accuracy(F.when(predicted.isNotNull(), (F.size(predicted) > 0) == (F.size(expected) > 0)))


def macro_by(grouped: DataFrame, measures: Sequence[str], *above: str) -> DataFrame:
    """Plain means over groups with a measured value, and how many these are."""
    return grouped.groupBy(*above).agg(*[c for m in measures for c in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))])


def in_order(df: DataFrame, key: str, canonical: Sequence[str]) -> DataFrame:
    """Rows sorted by a key: first the canonical ones in their order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, canonical)), F.col(key))
    return df.orderBy(F.when(place > 0, place).otherwise(len(canonical) + 1), key)


def calibration_bins(df: DataFrame, confidence: str, correct: str, *groups: str) -> DataFrame:
    """Ten equal bins (1.0 in the last): count, mean confidence, accuracy and squared error sum."""
    c, ok = F.col(confidence), F.col(correct).cast("int")
    usable = df.filter(c.isNotNull() & F.col(correct).isNotNull())
    return usable.groupBy(*groups, F.least(F.floor(c * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(c).alias("mean_confidence"), F.avg(ok).alias("accuracy"), F.sum((c - ok) * (c - ok)).alias("squared"), F.sum(F.abs(c - ok)).alias("absolute")
    )


def calibration(df: DataFrame, confidence: str, correct: str, *groups: str) -> DataFrame:
    """ECE, Brier score and reliability, summed up from the bins."""
    b = calibration_bins(df, confidence, correct, *groups)
    n, total = F.col("n"), F.sum("n")
    mean = F.sum(n * F.col("mean_confidence")) / total
    right = F.sum(n * F.col("accuracy")) / total
    return b.groupBy(*groups).agg(
        total.alias("n"),
        (F.sum(n * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / total).alias("ece"),
        (F.sum("squared") / total).alias("brier"),
        mean.alias("mean_confidence"),
        right.alias("observed_accuracy"),
        (mean - right).alias("mean_signed_error"),
        (F.sum("absolute") / total).alias("mean_absolute_error"),
    )


def grouping_sets(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Overall and by each key, in one pass: group_kind, group_value and the aggregates."""
    sets = [[], *[[F.col(k)] for k in keys]]
    out = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__g"), *aggregates)
    full = (1 << len(keys)) - 1
    kind, value = F.lit("overall"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        mine = F.col("__g") == (full & ~(1 << (len(keys) - 1 - i)))
        kind, value = F.when(mine, F.lit(k)).otherwise(kind), F.when(mine, F.col(k).cast("string")).otherwise(value)
    names = [c for c in out.columns if c not in (*keys, "__g")]
    return out.select(kind.alias("group_kind"), value.alias("group_value"), *names)


def deltas(left: DataFrame, right: DataFrame, higher_is_better: dict[str, bool]) -> DataFrame:
    """(metric, value_a, value_b, absolute, relative, improved) of two one-row metric tables; relative only for a base other than 0."""

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in higher_is_better])
        return df.select(F.inline(pairs))

    both = long(left, "value_a").join(long(right, "value_b"), "metric")
    change = F.col("value_b") - F.col("value_a")
    up = reduce(lambda a, m: a.when(F.col("metric") == m, F.lit(higher_is_better[m])), higher_is_better, F.when(F.lit(False), F.lit(True)))
    improved = F.when(change == 0, F.lit(False)).otherwise((change > 0) == up)
    return both.select("metric", "value_a", "value_b", change.alias("absolute"), F.try_divide(change, F.abs(F.nullif(F.col("value_a"), F.lit(0.0)))).alias("relative"), improved.alias("improved"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def leakage(df: DataFrame, content: Column, split: str) -> DataFrame:
    """Contents (by SHA-256) that lie in more than one split, with the number of rows and splits."""
    return df.select(F.sha2(content, 256).alias("content_hash"), split).groupBy("content_hash").agg(F.count("*").alias("n_rows"), F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def automation(state: Column, expected: Column, escalated: Column, expects_escalation: Column, undecided: str = "INSUFFICIENT_EVIDENCE") -> dict[str, Column]:
    """State accuracy, unsafe finalisation, escalation errors and automated coverage, rounded to 4 digits."""
    committed = state != undecided
    unsafe = committed & (expected == undecided)
    rates = {
        "state_accuracy": ratio(F.count_if(state == expected), F.count(F.lit(1))),
        "unsafe_finalisation": ratio(F.count_if(unsafe), F.count_if(expected == undecided)),
        "escalation_rate": ratio(F.count_if(escalated), F.count(escalated)),
        "escalation_false_positive": ratio(F.count_if(escalated & ~expects_escalation), F.count_if(~expects_escalation)),
        "escalation_false_negative": ratio(F.count_if(~escalated & expects_escalation), F.count_if(expects_escalation)),
        "automation_coverage": ratio(F.count_if(committed & ~escalated), F.count(F.lit(1))),
        "automated_accuracy": ratio(F.count_if(committed & ~escalated & (state == expected)), F.count_if(committed & ~escalated)),
    }
    return {k: F.round(v, 4) for k, v in rates.items()}
