"""What linked documents say about the same thing: consistent, contradictory or open, field by field.

Claims are rows (id, field, values); a finding compares the claims of the two
ends of a link. Nothing is resolved, and a contradiction is no violation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudex.functions import scalars as S

FIELDS = ("amount", "date", "vendor", "identity", "transaction_id", "approval_status", "factual_claim")
#: A difference of amounts up to this share is minor.
MINOR_SHARE = 0.01
#: Sums of items that are kept one by one.
_FEW_SUMS = 1 << 16
#: Days between dates up to which a difference is minor.
MINOR_DAYS = 1
# Words of statuses, and of a stated part payment.
_YES, _NO = r"(?i)^(approved|granted|delivered|received|complete[d]?)$", r"(?i)^(rejected|denied|refused|not delivered|not received|undelivered|incomplete)$"
_OPEN = r"(?i)^(pending|awaited|in progress|under review|on hold)$"
PARTIAL = r"(?i)\b(partial|part|instal+ment|advance)\s+payment\b|\bpaid\s+in\s+part\b"


@F.pandas_udf(T.BooleanType())
def sums_to(items: pd.Series, total: pd.Series) -> pd.Series:
    """Whether some of a row's items, whole numbers, add up to its total.

    The reachable sums are listed while they are few, then marked in a bit set.
    """

    def one(values, wanted) -> bool | None:
        if values is None or wanted is None or pd.isna(wanted):
            return None
        wanted = int(wanted)
        if wanted < 0:
            return False
        sums, reach = np.zeros(1, np.int64), None
        for v in (int(v) for v in values if v is not None and 0 < v <= wanted):
            if reach is None:
                sums = np.union1d(sums, sums[sums <= wanted - v] + v)
                if len(sums) > _FEW_SUMS:
                    reach = np.zeros(wanted + 1, bool)
                    reach[sums] = True
            else:
                reach[v:] |= reach[:-v].copy()
        return bool(sums[-1] == wanted or wanted in sums) if reach is None else bool(reach[wanted])

    return pd.Series([one(v, t) for v, t in zip(items, total, strict=True)], dtype=object)


def _adds_up(items: Column, total: Column) -> Column:
    """Whether some of two or more items add up to a total; only where neither all of them nor their size tell does a search begin."""
    usable = F.filter(items, lambda v: (v > 0) & (v <= total))
    every = F.aggregate(usable, F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v).cast("decimal(38,0)"))
    known = F.when(~(F.size(items) > 1), F.lit(False)).when(total < 0, F.lit(False)).when(every <= total, every == total).when(F.array_contains(usable, total), F.lit(True))
    return F.coalesce(known, sums_to(F.when(known.isNull(), items), F.when(known.isNull(), total)))


def amount_category(a: Column, b: Column, settles: Column, says_partial: Column) -> Column:
    """Of the amounts (arrays of cents) that two documents state.

    CONSISTENT where they share one, where some of one side's add up to one of
    the other's (line items), or where a part payment is stated and is less;
    UNRESOLVED where ``settles`` (``b`` is a payment) is less without saying so;
    a payment over what is billed is MAJOR, as other differences over
    ``MINOR_SHARE`` are. NULL unless both state amounts.
    """
    most_a, most_b = F.array_max(a), F.array_max(b)
    parts = _adds_up(a, most_b) | _adds_up(b, most_a)
    gap = F.abs(most_a - most_b) / F.greatest(most_a, most_b)
    apart = F.when(gap <= MINOR_SHARE, "MINOR_CONTRADICTION").otherwise("MAJOR_CONTRADICTION")
    paid = F.when(most_b < most_a, F.when(says_partial, "CONSISTENT").otherwise("UNRESOLVED")).otherwise("MAJOR_CONTRADICTION")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.when(F.arrays_overlap(a, b) | parts, "CONSISTENT").when(settles, paid).otherwise(apart))


def name_category(a: Column, b: Column) -> Column:
    """Of names: equal sets of words agree, one within the other differs little, else they are other parties."""
    x, y = (F.array_distinct(F.split(S.normal_text(c), " ")) for c in (a, b))
    common = F.size(F.array_intersect(x, y))
    return F.when((common == F.size(x)) & (common == F.size(y)), "CONSISTENT").when(common == F.least(F.size(x), F.size(y)), "MINOR_CONTRADICTION").otherwise("MAJOR_CONTRADICTION")


def status_category(a: Column, b: Column) -> Column:
    """Of statuses: a pending one leaves it open, a yes against a no is major, other words are open."""
    x, y = F.trim(a), F.trim(b)
    against = (x.rlike(_YES) & y.rlike(_NO)) | (x.rlike(_NO) & y.rlike(_YES))
    same = (S.normal_text(x) == S.normal_text(y)) | (x.rlike(_YES) & y.rlike(_YES)) | (x.rlike(_NO) & y.rlike(_NO))
    return F.when(same, "CONSISTENT").when(x.rlike(_OPEN) | y.rlike(_OPEN), "UNRESOLVED").when(against, "MAJOR_CONTRADICTION").otherwise("UNRESOLVED")


def fact_category(a: Column, b: Column) -> Column:
    """Of factual claims: numbers that differ are major, words are compared as statuses."""
    x, y = S.as_number(a), S.as_number(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, "CONSISTENT").otherwise("MAJOR_CONTRADICTION")).otherwise(status_category(a, b))


def date_category(a: Column, b: Column) -> Column:
    return day_category(S.as_timestamp(a).cast("date"), S.as_timestamp(b).cast("date"))


def day_category(a: Column, b: Column) -> Column:
    gap = F.abs(F.date_diff(a, b))
    return F.when(gap == 0, "CONSISTENT").when(gap <= MINOR_DAYS, "MINOR_CONTRADICTION").otherwise("MAJOR_CONTRADICTION")


def findings(links: DataFrame, claims: DataFrame) -> DataFrame:
    """(a, b, name, field, category, values_a, values_b, difference) of every claim that both ends of a link make.

    ``links``: a, b, status; WEAK and semantic links give one row of field
    ``link``, UNRESOLVED, and compare nothing. ``claims``: id, ``name`` (what
    it is about, such as ``order_date``), ``field`` (of ``FIELDS``), ``values``
    (texts; amounts in cents), ``settles`` and ``says_partial`` (of payments;
    NULL counts as false). Claims of the same name are compared; ids agree if
    they share one. ``difference`` names a legitimate one.
    """
    strong = links.filter("status in ('EXPLICIT', 'CONFLICTING')").select("a", "b").distinct()
    weak = links.filter("status not in ('EXPLICIT', 'CONFLICTING')").select("a", "b").distinct().join(strong, ["a", "b"], "left_anti")
    no = F.lit(False)
    # A date is read once for its claim, not for each link.
    day = F.when(F.col("field") == "date", S.as_timestamp(F.get("values", F.lit(0))).cast("date"))
    parts = ("values", "settles", "partial", "day")
    sided = claims.select("id", "name", "field", "values", F.coalesce("settles", no).alias("settles"), F.coalesce("says_partial", no).alias("partial"), day.alias("day"))
    x = sided.select(F.col("id").alias("a"), "name", "field", *[F.col(c).alias(f"{c}_a") for c in parts])
    y = sided.select(F.col("id").alias("b"), "name", "field", *[F.col(c).alias(f"{c}_b") for c in parts])
    both = strong.join(x, "a").join(y, ["b", "name", "field"])
    # Billed first, paid second.
    turned = F.col("settles_a") & ~F.col("settles_b")
    first, second = F.when(turned, F.col("values_b")).otherwise(F.col("values_a")), F.when(turned, F.col("values_a")).otherwise(F.col("values_b"))
    cents = [F.when(F.col("field") == "amount", F.transform(v, lambda i: i.cast("long"))).otherwise(F.array().cast("array<long>")) for v in (first, second)]
    settles, partial = F.col("settles_a") != F.col("settles_b"), F.col("partial_a") | F.col("partial_b")
    money = amount_category(*cents, settles, partial)
    u, v = F.get("values_a", F.lit(0)), F.get("values_b", F.lit(0))
    ids = F.when(F.arrays_overlap("values_a", "values_b"), "CONSISTENT").otherwise("MAJOR_CONTRADICTION")
    kinds = {"amount": money, "date": day_category(F.col("day_a"), F.col("day_b")), "vendor": name_category(u, v), "identity": name_category(u, v), "transaction_id": ids, "approval_status": status_category(u, v), "factual_claim": fact_category(u, v)}
    category = F.coalesce(*[F.when(F.col("field") == f, c) for f, c in kinds.items()])
    # Exploded, so that the filter and the difference don't work it out again.
    both = both.withColumn("category", F.explode(F.array(category)))
    part = (F.col("field") == "amount") & settles & partial & ~F.arrays_overlap("values_a", "values_b")
    rows = both.select("a", "b", "name", "field", "category", "values_a", "values_b", F.when(part & (F.col("category") == "CONSISTENT"), "partial_payment").alias("difference"))
    none = F.lit(None)
    open_links = weak.select("a", "b", F.lit("link").alias("name"), F.lit("link").alias("field"), F.lit("UNRESOLVED").alias("category"), none.cast("array<string>").alias("values_a"), none.cast("array<string>").alias("values_b"), none.cast("string").alias("difference"))
    return rows.filter("category is not null").unionByName(open_links)


def missing_evidence(references: DataFrame, supplied: DataFrame) -> DataFrame:
    """(id, field, reference, category) of references (id, field, reference) that no document in ``supplied`` (field, reference) is about."""
    gone = references.join(supplied.select("field", "reference").distinct(), ["field", "reference"], "left_anti")
    return gone.select("id", "field", "reference", F.lit("MISSING_EVIDENCE").alias("category"))


def policy_violations(decisions: DataFrame) -> DataFrame:
    """(id, category) that mirrors violations already decided; no contradiction ever makes one."""
    return decisions.filter("verdict = 'VIOLATION'").select("id", F.lit("POLICY_VIOLATION").alias("category"), F.lit(False).alias("derived_from_contradiction"))
