"""Evidence graph: identifiers, links between documents, traversal, contradictions and what follows from them.

Of the original only examples of behaviour are known; similarity, scores and
wording here are our choice.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adjudex.functions import scalars as S

#: (kind, pattern): identifiers that tie documents to one transaction.
IDENTIFIERS = (("invoice", r"(?i)\b(INV-?\d{2,})\b"), ("purchase_order", r"(?i)\b(PO-?\d{2,})\b"), ("payment", r"(?i)\b(UTR-?[A-Z0-9]{4,})\b"), ("approval", r"(?i)\b(APR-?\d{2,}|APPROVAL-?\d{2,})\b"))
NEGATED = {">": "<=", ">=": "<", "<": ">=", "<=": ">"}


def normal_identifier(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def field_of(text: Column, name: str) -> Column:
    """The value of a ``Name: value`` line; NULL if there is none."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*[:=]\s*(.+)$", 1)), F.lit(""))


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind, identifier) of every identifier that a document names, once."""
    kinds = [F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(1)), lambda x, k=k: F.struct(F.lit(k).alias("kind"), normal_identifier(x).alias("identifier"))) for k, p in IDENTIFIERS]
    return docs.select(id_col, F.inline(F.concat(*kinds))).distinct()


def shared_identifiers(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(hub, id, kind, identifier): documents tied to the smallest one that names the same identifier.

    A star for each identifier, not all pairs: as many rows as mentions.
    """
    hub = found.groupBy("kind", "identifier").agg(F.min(id_col).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return found.join(hub.select("kind", "identifier", "hub"), ["kind", "identifier"]).filter(F.col(id_col) != F.col("hub")).select("hub", F.col(id_col).alias("id"), "kind", "identifier")


def link_status(shared: Column, conflicting: Column, similarity: Column, least: float = 0.5) -> Column:
    """EXPLICIT by a shared identifier, CONFLICTING if other fields then differ, WEAK by similarity alone, else UNRESOLVED."""
    return F.when(shared & conflicting, "CONFLICTING").when(shared, "EXPLICIT").when(similarity >= least, "WEAK").otherwise("UNRESOLVED")


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-case words."""
    x, y = (F.array_distinct(F.split(S.normal_text(t), " ")) for t in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double"))


def missing_references(references: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    return references.join(supplied.select(key).distinct(), key, "left_anti")


def _shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The table, with its lineage cut in the folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is set if everything runs in one
    process, as in tests; on a cluster that raises ``RuntimeError``.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like ``cut``, as Parquet, which takes less room; how rows were dealt out and sorted is lost."""
    path = f"{_shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def traverse(edges: DataFrame, seeds: DataFrame, max_hops: int = 5) -> DataFrame:
    """(root, id, hop): what each seed reaches over directed edges (src, dst), at the least number of hops.

    Breadth first: a hop joins the frontier with the edges and drops what the
    root has reached already, and is stored, so that plans stay short. Filter
    edges that must not be followed before.
    """
    reached = seeds.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, max_hops + 1):
        step = frontier.join(edges, frontier["id"] == edges["src"]).select("root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(reached.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
    return reached


def amount_contradiction(stated: Column, paid: Column, says_partial: Column, tolerance: float = 0.01) -> Column:
    """CONSISTENT within the tolerance or for a stated part payment, UNRESOLVED for less without a word, MAJOR for more, MISSING_EVIDENCE if either is unknown."""
    gap = paid - stated
    return F.when(gap.isNull(), "MISSING_EVIDENCE").when(F.abs(gap) <= tolerance, "CONSISTENT").when(gap > tolerance, "MAJOR").when(says_partial, "CONSISTENT").otherwise("UNRESOLVED")


def field_contradiction(a: Column, b: Column, field: str) -> Column:
    """MAJOR where two claims differ as text (a pending approval: UNRESOLVED), MISSING_EVIDENCE if either is unknown."""
    same = S.normal_text(a) == S.normal_text(b)
    pending = F.lit(field == "approval_status") & (F.lower(a).contains("pending") | F.lower(b).contains("pending"))
    return F.when(same.isNull(), "MISSING_EVIDENCE").when(same, "CONSISTENT").when(pending, "UNRESOLVED").otherwise("MAJOR")


_SIMPLE_RULE = r"(?i)^\s*(FORBID|REQUIRE)\s+TRANSACTION\s+(<=|>=|<|>)\s+([A-Z]{3})\s+([\d,]+(?:\.\d+)?)(?:\s+severity=(\w+))?\s*$"
_KEYWORD_RULE = r'(?i)^\s*(FORBID|REQUIRE)\s+KEYWORD\s+"([^"]+)"\s*$'


def parse_simple_rule(line: Column) -> Column:
    """struct(kind, mode, op, currency, amount, keyword) of a one-line rule; kind UNEVALUATED for any other text."""
    amount, word = line.rlike(_SIMPLE_RULE), line.rlike(_KEYWORD_RULE)
    mode = F.upper(F.when(amount, F.regexp_extract(line, _SIMPLE_RULE, 1)).when(word, F.regexp_extract(line, _KEYWORD_RULE, 1)))
    kind = F.when(amount, "AMOUNT").when(word, "KEYWORD").when(line.rlike(r"(?i)^\s*transaction amounts must match\.?\s*$"), "AMOUNT_MATCH").when(line.rlike(r"(?i)^\s*REQUIRE GOVID VALID\s*$"), "GOVID").otherwise("UNEVALUATED")
    return F.struct(
        kind.alias("kind"), mode.alias("mode"), F.when(amount, F.regexp_extract(line, _SIMPLE_RULE, 2)).alias("op"), F.when(amount, F.upper(F.regexp_extract(line, _SIMPLE_RULE, 3))).alias("currency"),
        F.when(amount, S.as_number(F.regexp_extract(line, _SIMPLE_RULE, 4))).alias("amount"), F.when(word, F.regexp_extract(line, _KEYWORD_RULE, 2)).alias("keyword"),
    )


def _compare(x: Column, op: Column, limit: Column) -> Column:
    return F.when(op == ">", x > limit).when(op == ">=", x >= limit).when(op == "<", x < limit).when(op == "<=", x <= limit)


def amount_verdict(mode: Column, op: Column, limit: Column, currency: Column, amount: Column, amount_currency: Column) -> Column:
    """NOT_APPLICABLE without an amount, UNEVALUATED in another currency, else VIOLATION or SATISFIED."""
    holds = _compare(amount, op, limit)
    return F.when(amount.isNull(), "NOT_APPLICABLE").when(amount_currency != currency, "UNEVALUATED").when(F.when(mode == "FORBID", holds).otherwise(~holds), "VIOLATION").otherwise("SATISFIED")


def keyword_verdict(mode: Column, found_anywhere: Column, all_have_text: Column) -> Column:
    """A missing keyword counts only if every document gave text."""
    return F.when(mode == "FORBID", F.when(found_anywhere, "VIOLATION").when(all_have_text, "SATISFIED").otherwise("INCONCLUSIVE")).otherwise(F.when(found_anywhere, "SATISFIED").when(all_have_text, "VIOLATION").otherwise("INCONCLUSIVE"))


def amounts_match(transactions: DataFrame, reference: str, amount: str) -> DataFrame:
    """(reference, verdict): SATISFIED if the amounts of a reference agree, VIOLATION if not, INCONCLUSIVE for a single one."""
    g = transactions.groupBy(reference).agg(F.count(amount).alias("n"), F.min(amount).alias("lo"), F.max(amount).alias("hi"))
    return g.select(reference, F.when(F.col("n") < 2, "INCONCLUSIVE").when(F.col("lo") == F.col("hi"), "SATISFIED").otherwise("VIOLATION").alias("verdict"))


def approval_evidence(text: Column, role: str | None = None) -> Column:
    """A text's evidence of written approval (type, timing: before_payment, after_payment or unstated); NULL if it has none.

    With ``role`` the approval must be that person's: named after it (``approval
    from the ...``) or before it (``... approved in writing``) in one sentence.
    A bare "approved" is no written approval, and a sentence that denies it or
    says that nobody gave it is none; timing is that sentence's.
    """
    who = r"[^.;]{0,60}?" if role is None else rf"(?:the\s+)?{re.escape(role)}\b"
    given = rf"\bwritten\s+approval\s+(?:from|by|of)\s+{who}" if role else r"\bwritten\s+approval\b"
    wrote = rf"\b{re.escape(role)}\s+(?:has\s+)?approved\b[^.;]*\bin\s+writing\b" if role else r"\bapproved\b[^.;]*\bin\s+writing\b"
    denied = r"(?i)\b(no|not|nobody|none|never|without|pending|refused|denied|rejected|missing|lacks?)\b"
    said = F.filter(F.split(text, r"(?<=[.;])\s+|\n"), lambda s: s.rlike(f"(?i)({given}|{wrote})") & ~s.rlike(denied))
    first = F.get(said, 0)
    timing = F.when(first.rlike(r"(?i)\b(before|prior to) (the )?payment\b"), "before_payment").when(first.rlike(r"(?i)\bafter (the )?payment\b"), "after_payment").otherwise("unstated")
    return F.when(first.isNotNull(), F.struct(F.lit("written_approval").alias("type"), timing.alias("timing")))


def grounding(claim: Column, evidence: Column, located: Column, heuristic: Column) -> Column:
    """GROUNDED where the evidence states the claim at a known place, WEAK without a place or by a heuristic only, else UNSUPPORTED."""
    said = F.contains(S.normal_text(evidence), S.normal_text(claim))
    return F.when(F.coalesce(said, F.lit(False)), F.when(located & ~heuristic, "GROUNDED").otherwise("WEAK")).otherwise("UNSUPPORTED")


def verification(unsupported: Column, weak: Column, major: Column, claims: Column) -> Column:
    """FAILED beats ESCALATE beats VERIFIED; NOT_VERIFIED without claims."""
    return F.when(claims == 0, "NOT_VERIFIED").when(unsupported > 0, "FAILED").when((weak > 0) | major, "ESCALATE").otherwise("VERIFIED")


def applicability(verified: Column, mismatches: Column, unknown: Column) -> Column:
    return F.when(verified == "FAILED", "NOT_CHECKED").when(mismatches > 0, "MISMATCH").when(unknown > 0, "UNESTABLISHED").otherwise("VERIFIED")


def outcome(verified: Column, verdict: Column) -> Column:
    undecided = verdict.isin("INCONCLUSIVE", "UNEVALUATED", "NOT_APPLICABLE")
    return F.when(verified == "FAILED", "NO_CONCLUSION").when(verified == "ESCALATE", "ESCALATE").when(undecided, "NO_CONCLUSION").otherwise(verdict)


def merge_verdicts(compiled: Column, legacy: Column) -> Column:
    """A determinate compiled verdict decides, else the legacy one."""
    return F.coalesce(F.when(compiled.isin("VIOLATION", "COMPLIANT", "SATISFIED"), compiled), legacy)


def counterfactual(mode: Column, op: Column, limit: Column, amount: Column) -> Column:
    """What amount would satisfy an amount rule: struct(status, region_op, delta, direction, target).

    A rule that forbids asks for the negated comparison. A strict bound has no
    nearest target, so that is NULL.
    """
    negated = F.element_at(F.create_map(*[F.lit(x) for pair in NEGATED.items() for x in pair]), op)
    region = F.when(mode == "FORBID", negated).otherwise(op)
    ok = _compare(amount, region, limit)
    delta = limit - amount
    return F.struct(
        F.when(amount.isNull() | limit.isNull(), "UNRESOLVED").when(ok, "NOT_REQUIRED").otherwise("ESTABLISHED").alias("status"),
        region.alias("region_op"),
        F.when(~ok, delta).alias("delta"),
        F.when(~ok, F.when(region.isin("<", "<="), "decrease").otherwise("increase")).alias("direction"),
        F.when(~ok & region.isin("<=", ">="), limit).alias("target"),
    )


def uncertainty_state(verified: Column, verdict: Column, missing_critical: Column, applicable: Column, major_open: Column) -> Column:
    """INSUFFICIENT_EVIDENCE, then CONDITIONAL, then what the verdict says."""
    return (
        F.when((verified == "FAILED") | verdict.isin("INCONCLUSIVE", "NOT_APPLICABLE") | missing_critical, "INSUFFICIENT_EVIDENCE")
        .when((applicable != "VERIFIED") | (verdict == "UNEVALUATED") | major_open, "CONDITIONAL")
        .when(verdict == "VIOLATION", "NON_COMPLIANT")
        .otherwise("COMPLIANT")
    )


def escalation_reasons(missing_critical: Column, applicable: Column, contradiction_open: Column, low_confidence: Column, high_risk: Column) -> Column:
    """Why a case is to be escalated; nothing where it needn't be."""
    return F.array_compact(
        F.array(
            F.when(missing_critical, F.lit("CRITICAL_EVIDENCE_MISSING")),
            F.when(applicable != "VERIFIED", F.lit("POLICY_APPLICABILITY_UNESTABLISHED")),
            F.when(contradiction_open, F.lit("UNRESOLVED_CONTRADICTION")),
            F.when(low_confidence, F.lit("LOW_CONFIDENCE")),
            F.when(high_risk, F.lit("HIGH_RISK")),
        )
    )


def merged_decision(label: Column) -> Column:
    """Over a group: NON_COMPLIANT, else INSUFFICIENT_EVIDENCE, else COMPLIANT."""
    return F.when(F.count_if(label == "NON_COMPLIANT") > 0, "NON_COMPLIANT").when(F.count_if(label == "INSUFFICIENT_EVIDENCE") > 0, "INSUFFICIENT_EVIDENCE").when(F.count_if(label == "COMPLIANT") > 0, "COMPLIANT")


def lineage(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """(decision, evidence, document) over SUPPORTS and DERIVED_FROM edges."""
    support = edges.filter("relation = 'SUPPORTS'").select(F.col("target_id").alias("decision"), F.col("source_id").alias("evidence"))
    source = edges.filter("relation = 'DERIVED_FROM'").select(F.col("source_id").alias("evidence"), F.col("target_id").alias("document"))
    return decisions.select("decision").join(support, "decision").join(source, "evidence", "left").select("decision", "evidence", "document")


def disputing_documents(claims: DataFrame, basis: DataFrame) -> DataFrame:
    """Documents of contradicting claims that a decision's own evidence does not rest on."""
    return claims.join(basis, ["decision", "document"], "left_anti")


def stages(*steps) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Run (name, function of the tables so far) in order; a step that fails is noted, and the others go on."""
    tables: dict[str, DataFrame] = {}
    failed: list[tuple[str, str]] = []
    for name, step in steps:
        try:
            tables[name] = step(tables)
        except Exception as why:
            failed.append((name, str(why)))
    return tables, failed


def trace_record(tables: dict[str, DataFrame], key: str, value: object) -> dict[str, DataFrame]:
    """Each stage's rows about one record."""
    return {n: t.filter(F.col(key) == value) for n, t in tables.items() if key in t.columns}


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has."""
    return reduce(DataFrame.unionByName, [a.exceptAll(b).withColumn("side", F.lit("a")), b.exceptAll(a).withColumn("side", F.lit("b"))])
