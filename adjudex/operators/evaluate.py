"""Verdicts of rules over fact rows, and decisions over their verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudex.functions import scalars as S

from .rules import OPERATORS, ORDERING, SEVERITIES, Evidence, Facts, Leaf, Rule, absent_facts, condition_column, is_date, leaf_column, leaves, render, sorted_names, temporal_column

#: Of a policy's decision, the verdict that decides first.
DECISIONS = (("VIOLATION", "NON_COMPLIANT"), ("ACTION_REQUIRED", "ACTION_REQUIRED"), ("INDETERMINATE", "INDETERMINATE"), ("COMPLIANT", "COMPLIANT"))

#: Nodes of a rule table that is broadcast to facts.
MAX_RULE_NODES = 200_000


def count_evidence(evidence: DataFrame, key: str, needs: Mapping[str, Evidence]) -> DataFrame:
    """A row for each subject with, for each need, the number of items of its type whose attributes match.

    ``evidence`` has the key, ``type`` and ``attrs`` (map). One aggregation with
    map-side combine serves all needs, however many items a subject has.
    """
    kind = S.snake_case(F.col("type"))
    counts = []
    for name, need in needs.items():
        fits = kind == need.type
        for attribute, value in need.match:
            found = F.element_at("attrs", attribute)
            fits = fits & F.coalesce(S.normal_text(found) == S.normal_text(F.lit(value)), F.lit(False))
        counts.append(F.count_if(fits).alias(name))
    return evidence.groupBy(key).agg(*counts)


def evidence_status(rule: Rule, counts: Sequence[Column], supplied: Column) -> Column:
    """OK, MISSING (a mandatory need is not met) or NOT_SUPPLIED."""
    mandatory = [n < e.min_count for n, e in zip(counts, rule.evidence) if e.mandatory]
    if not mandatory:
        return F.lit("OK")
    lacking = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(True)) for x in mandatory])
    return F.when(~supplied, "NOT_SUPPLIED").when(lacking, "MISSING").otherwise("OK")


def base_verdict(rule: Rule, predicate: Column, status: Column) -> Column:
    """The rule type's verdict before exceptions; an unknown predicate comes first."""
    by_evidence = F.when(status == "MISSING", "VIOLATION").when(status == "NOT_SUPPLIED", "INDETERMINATE")
    if rule.rule_type == "PROHIBIT":
        verdict = F.when(predicate, "VIOLATION").otherwise("COMPLIANT")
    elif rule.rule_type == "REQUIRE":
        verdict = F.when(~predicate, "VIOLATION").otherwise(by_evidence.otherwise("COMPLIANT"))
    else:
        verdict = F.when(~predicate, "NOT_APPLICABLE").otherwise(by_evidence.otherwise("COMPLIANT" if rule.evidence else "ACTION_REQUIRED"))
    return F.when(predicate.isNull(), "INDETERMINATE").otherwise(verdict)


def with_exceptions(verdict: Column, exceptions: Sequence[Column]) -> Column:
    if not exceptions:
        return verdict
    some = reduce(lambda a, b: a | b, exceptions)
    return F.when(verdict.isin("VIOLATION", "ACTION_REQUIRED"), F.when(some, "EXEMPT").when(some.isNull(), "INDETERMINATE").otherwise(verdict)).otherwise(verdict)


def verdict_column(rule: Rule, predicate: Column, evidence_counts: Sequence[Column], supplied: Column, exceptions: Sequence[Column], include_needs_review: bool = False) -> Column:
    """The verdict of a rule: unknown predicates first, then the rule type's table, then exceptions."""
    if rule.status != "VALID" and not include_needs_review:
        return F.lit("INDETERMINATE")
    return with_exceptions(base_verdict(rule, predicate, evidence_status(rule, evidence_counts, supplied)), exceptions)


def _reasons(rule: Rule, predicate: Column, status: Column, base: Column, verdict: Column) -> Column:
    """Codes of why a rule came to its verdict."""
    fired = rule.rule_type == "TRIGGER"
    found = [
        F.when(predicate.isNull(), "condition_unknown"),
        F.when(~predicate, "trigger_not_met" if fired else "condition_false" if rule.rule_type == "REQUIRE" else None),
        F.when(predicate & (base == "VIOLATION") & (status == "MISSING"), "evidence_missing"),
        F.when(predicate & (base == "INDETERMINATE") & (status == "NOT_SUPPLIED"), "evidence_not_supplied"),
        F.when(F.lit(fired) & (base == "COMPLIANT"), "action_evidenced"),
        F.when(base == "ACTION_REQUIRED", "action_required"),
        F.when(verdict == "EXEMPT", "exception_applies"),
        F.when(base.isin("VIOLATION", "ACTION_REQUIRED") & (verdict == "INDETERMINATE"), "exception_unknown"),
    ]
    return F.array_compact(F.array(*[x.cast("string") for x in found]))


def evaluate(subjects: DataFrame, rules: Sequence[Rule], facts: Facts, evidence: DataFrame | None = None, key: str = "subject_id", include_needs_review: bool = False, details: bool = False) -> DataFrame:
    """A row for each subject row and rule: rule_id, verdict, severity, action, exception_applied, missing_facts.

    Compiled mode: facts are bound to the columns' types; one projection gives
    each distinct leaf once, further ones combine them, and one ``inline`` makes
    rows of the rules. Evidence is aggregated by subject first and joined once;
    without an ``evidence`` table it counts as not supplied, unless the subjects
    say so row by row in ``evidence_supplied``. Absent facts of exceptions are
    missing only where the exceptions were looked at, and a rule that needs
    review misses nothing.

    With ``details`` there are also ``reasons`` (codes), ``missing_evidence``
    (type, required, found), ``evidence_satisfied`` (types), ``notes`` (facts
    without a unit that were taken in the rule's) and ``trace`` (test, result).
    """
    facts = facts.bind(subjects)
    needs = {f"__n{i}_{j}": e for i, r in enumerate(rules) for j, e in enumerate(r.evidence)}
    rows = subjects
    if evidence is not None and needs:
        rows = rows.join(count_evidence(evidence, key, needs), key, "left")
    run = [r.status == "VALID" or include_needs_review for r in rules]

    # Every distinct test and fact once.
    tests: dict[str, tuple[str, Column]] = {}
    there: dict[tuple[str, str], tuple[str, Column]] = {}

    def leaf(x: Leaf) -> Column:
        name, _ = tests.setdefault(repr(x), (f"__t{len(tests)}", leaf_column(x, facts)))
        return F.col(name)

    def present(entity: str, path: str) -> Column:
        name, _ = there.setdefault((entity, path), (f"__p{len(there)}", facts.present(entity, path)))
        return F.col(name)

    first, second, third, out = {}, {}, {}, []
    first["__s"] = F.coalesce(F.col("evidence_supplied"), F.lit(False)) if "evidence_supplied" in subjects.columns else F.lit(evidence is not None)
    for i, rule in enumerate(rules):
        if not run[i]:
            continue
        parts = [condition_column(rule.condition, facts, leaf)] if rule.condition is not None else []
        if rule.temporal is not None:
            first[f"__m{i}"] = temporal_column(rule.temporal, facts)
            parts.append(F.col(f"__m{i}"))
        counts = [F.coalesce(F.col(f"__n{i}_{j}"), F.lit(0)) if evidence is not None else F.lit(0) for j in range(len(rule.evidence))]
        second[f"__h{i}"] = reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
        second[f"__e{i}"] = evidence_status(rule, counts, F.col("__s"))
        third[f"__b{i}"] = base_verdict(rule, F.col(f"__h{i}"), F.col(f"__e{i}"))
        exceptions = [condition_column(x.condition, facts, leaf) for x in rule.exceptions]
        for j, x in enumerate(exceptions):
            second[f"__x{i}_{j}"] = x
    verdicts = {f"__v{i}": with_exceptions(F.col(f"__b{i}"), [F.col(f"__x{i}_{j}") for j in range(len(r.exceptions))]) if run[i] else F.lit("INDETERMINATE") for i, r in enumerate(rules)}

    for i, rule in enumerate(rules):
        verdict, none = F.col(f"__v{i}"), F.lit(None).cast("string")
        acts = verdict.isin("VIOLATION", "ACTION_REQUIRED")
        hit, missing = none, []
        if run[i]:
            tried = [F.when(F.col(f"__x{i}_{j}"), F.lit(x.description)) for j, x in enumerate(rule.exceptions)]
            hit = F.coalesce(*tried) if tried else none
            missing = absent_facts([rule.condition] if rule.condition else [], rule.temporal, facts, present)
            looked = F.col(f"__b{i}").isin("VIOLATION", "ACTION_REQUIRED")
            missing += [F.when(looked, x) for x in absent_facts([x.condition for x in rule.exceptions], None, facts, present)]
        fields = [
            F.lit(rule.rule_id).alias("rule_id"),
            verdict.alias("verdict"),
            F.when(acts, F.lit(rule.severity)).alias("severity"),
            F.when(acts, F.lit(rule.action).cast("string")).alias("action"),
            F.when(verdict == "EXEMPT", hit).alias("exception_applied"),
            sorted_names(missing).alias("missing_facts"),
        ]
        if details:
            fields += _details(rule, i, run[i], evidence is not None, facts, leaf)
        out.append(F.struct(*fields))

    kept = subjects.columns
    counted = [F.col(n) for n in needs] if evidence is not None else []
    rows = rows.select(*kept, *counted, *[c.alias(n) for n, c in tests.values()], *[c.alias(n) for n, c in there.values()], *[c.alias(n) for n, c in first.items()])
    for made in (second, third, verdicts):
        rows = rows.withColumns(made) if made else rows
    return rows.select(*kept, F.inline(F.array(*out)))


def _details(rule: Rule, i: int, run: bool, supplied: bool, facts: Facts, leaf) -> list[Column]:
    need = "struct<type:string,required:int,found:bigint>"
    if not run:
        empty = {"reasons": "array<string>", "missing_evidence": f"array<{need}>", "evidence_satisfied": "array<string>", "notes": "array<string>", "trace": "array<struct<test:string,result:boolean>>"}
        return [(F.array(F.lit("needs_review")) if n == "reasons" else F.array().cast(t)).alias(n) for n, t in empty.items()]
    holds, status, base, verdict = (F.col(f"__{c}{i}") for c in "hebv")
    engaged = F.lit(rule.rule_type == "REQUIRE") | (F.lit(rule.rule_type == "TRIGGER") & F.coalesce(holds, F.lit(False)))
    asked = engaged & F.col("__s")
    counts = [F.coalesce(F.col(f"__n{i}_{j}"), F.lit(0)).cast("long") if supplied else F.lit(0).cast("long") for j in range(len(rule.evidence))]
    lacking = [F.when(asked & (n < e.min_count), F.struct(F.lit(e.type).alias("type"), F.lit(e.min_count).alias("required"), n.alias("found"))) for n, e in zip(counts, rule.evidence) if e.mandatory]
    met = [F.when(asked & (n >= e.min_count), F.lit(e.type)) for n, e in zip(counts, rule.evidence)]
    looked = base.isin("VIOLATION", "ACTION_REQUIRED")
    bare = []
    for when, tree in [(F.lit(True), rule.condition), *((looked, x.condition) for x in rule.exceptions)]:
        bare += [F.when(when & facts.without_unit(x), F.lit(f"{x.entity}.{x.path} taken in {x.unit}")) for x in leaves(tree) if x.unit and not facts.strict_units]
    trace = [F.when(when, F.struct(F.lit(render(x)).alias("test"), leaf(x).alias("result"))) for when, tree in [(F.lit(True), rule.condition), *((looked, x.condition) for x in rule.exceptions)] for x in leaves(tree)]
    return [
        _reasons(rule, holds, status, base, verdict).alias("reasons"),
        (F.array_compact(F.array(*lacking)) if lacking else F.array().cast(f"array<{need}>")).alias("missing_evidence"),
        (F.array_compact(F.array(*met)) if met else F.array().cast("array<string>")).alias("evidence_satisfied"),
        sorted_names(bare).alias("notes"),
        (F.array_compact(F.array(*trace)) if trace else F.array().cast("array<struct<test:string,result:boolean>>")).alias("trace"),
    ]


def decision(verdict: Column) -> Column:
    """The decision over a group of verdicts, by priority; NOT_APPLICABLE where nothing else is (exempt alone included)."""
    out = F.when(F.lit(False), "")
    for name, decided in DECISIONS:
        out = out.when(F.count_if(verdict == name) > 0, decided)
    return out.otherwise("NOT_APPLICABLE")


def decide(results: DataFrame, *keys: str) -> DataFrame:
    """A row for each group: decision, verdict counts, highest severity of violations and required actions, sorted."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("VIOLATION", "ACTION_REQUIRED", "INDETERMINATE", "COMPLIANT", "NOT_APPLICABLE", "EXEMPT")]
    return results.groupBy(*keys).agg(
        decision(F.col("verdict")).alias("decision"),
        *counts,
        F.max_by("severity", F.when(F.col("verdict") == "VIOLATION", rank)).alias("highest_severity"),
        F.array_sort(F.collect_set("action")).alias("actions"),
    )


def confirm_violations(results: DataFrame, key: str, base_rules: Sequence[str]) -> DataFrame:
    """(key, confirmed) facts for escalation rules: any base violation, or NULL unless all base verdicts are determinate."""
    base = results.filter(F.col("rule_id").isin(*base_rules))
    sure = F.count_if(F.col("verdict") == "INDETERMINATE") == 0
    return base.groupBy(key).agg(F.when(sure, F.count_if(F.col("verdict") == "VIOLATION") > 0).alias("confirmed"))


def fan_out(subjects: DataFrame, records: str, index: str = "record_index", record: str = "record") -> DataFrame:
    """A row for each record of a list fact; an empty or NULL list gives one row with a NULL record."""
    return subjects.select("*", F.posexplode_outer(records).alias(index, record)).drop(records)


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values of parents from their children's rows (value, fallback, negate and the parent's logic, n, n_true, n_false).

    A child without a row has its fallback, the value that it has without any
    fact; how many of these are true or false comes from the rule table.
    """
    v = F.when(F.col("negate"), ~F.col("value")).otherwise(F.col("value"))
    f = F.when(F.col("negate"), ~F.col("fallback")).otherwise(F.col("fallback"))
    held = rows.groupBy(*keys, "logic", "n", "n_true", "n_false").agg(F.count_if(v).alias("t"), F.count_if(~v).alias("f"), F.count_if(f).alias("ft"), F.count_if(~f).alias("ff"))
    yes, no = F.col("t") + F.col("n_true") - F.col("ft"), F.col("f") + F.col("n_false") - F.col("ff")
    every = F.when(no > 0, F.lit(False)).when(yes == F.col("n"), F.lit(True))
    some = F.when(yes > 0, F.lit(True)).when(no == F.col("n"), F.lit(False))
    return held.select(*keys, F.when(F.col("logic").isin("AND", "NOT"), every).otherwise(some).alias("value"))


def _leaf_values(met: DataFrame) -> Column:
    """The value of a leaf row of text ``raw`` against op, number, text, items, low, high and inclusive."""
    raw, op, n, x = F.col("raw"), F.col("op"), F.col("number"), S.as_number(F.col("raw"))

    def same(value: Column) -> Column:
        number = S.as_number(value)
        close = F.abs(x - number) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(number)), F.lit(1e-9))
        return F.coalesce(close, S.normal_text(raw) == S.normal_text(value))

    equal = F.when(n.isNotNull(), F.abs(x - n) <= F.greatest(1e-9 * F.greatest(F.abs(x), F.abs(n)), F.lit(1e-9))).otherwise(same(F.col("text")))
    listed = F.exists("items", same)
    inside = F.when(F.coalesce(F.col("inclusive"), F.lit(True)), (x >= F.col("low")) & (x <= F.col("high"))).otherwise((x > F.col("low")) & (x < F.col("high")))
    held = F.contains(S.normal_text(raw), S.normal_text(F.col("text")))
    there = S.present(raw)
    # A threshold that is no number is a date's text (``_rule_table`` sees to it).
    at, limit = S.as_timestamp(raw), S.as_timestamp(F.col("text"))

    def than(number: Column, moment: Column) -> Column:
        return F.when(n.isNotNull(), number).otherwise(moment)

    tests = {">": than(x > n, at > limit), ">=": than(x >= n, at >= limit), "<": than(x < n, at < limit), "<=": than(x <= n, at <= limit), "==": equal, "!=": ~equal, "in": listed, "not_in": ~listed, "between": inside, "not_between": ~inside, "contains": held, "not_contains": ~held}
    value = reduce(lambda a, kv: a.when(op == kv[0], F.when(there, kv[1])), tests.items(), F.when(op == "exists", there).when(op == "not_exists", ~there))
    return value


def _rule_table(nodes: DataFrame) -> tuple[list[tuple], str]:
    """The rule table's rows, bounded by ``MAX_RULE_NODES``, with what each node is worth without any fact."""
    kept = "rule_id, node_id, parent_id, depth, logic, path, op, number, text, items, low, high, inclusive".split(", ")
    rows = [r.asDict() for r in nodes.limit(MAX_RULE_NODES + 1).collect()]
    if len(rows) > MAX_RULE_NODES:
        raise ValueError(f"more than {MAX_RULE_NODES} rule nodes")
    children: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        children.setdefault((r["rule_id"], r["parent_id"]), []).append(r)
        if r["logic"] is None and r["op"] not in OPERATORS:
            raise ValueError(f"unknown operator {r['op']}")
        if r["op"] in ORDERING and r["number"] is None and not is_date(r["text"]):
            raise ValueError(f"{r['text']!r} is neither a number nor a date")
        own = sorted(children.get((r["rule_id"], r["node_id"]), []), key=lambda c: c["node_id"])
        worth = []
        for i, c in enumerate(own):
            c["negate"] = r["logic"] == "NOT" or (r["logic"] == "IMPLIES" and i == 0)
            worth.append(None if c["fallback"] is None else c["fallback"] != c["negate"])
        r |= {"n": len(own), "n_true": worth.count(True), "n_false": worth.count(False), "negate": False}
        decides = r["logic"] not in ("AND", "NOT")
        r["fallback"] = {"exists": False, "not_exists": True}.get(r["op"]) if r["logic"] is None else decides if decides in worth else None if None in worth else not decides
    schema = "rule_id string, node_id long, parent_id long, depth int, logic string, path string, op string, number double, text string, items array<string>, low double, high double, inclusive boolean, negate boolean, fallback boolean, n long, n_true long, n_false long"
    return [(*(r.get(c) for c in kept), r["negate"], r["fallback"], r["n"], r["n_true"], r["n_false"]) for r in rows], schema


def evaluate_tabular(facts: DataFrame, nodes: DataFrame, key: str = "subject_id", max_depth: int = 6, subjects: DataFrame | None = None) -> DataFrame:
    """Data-driven mode: conditions as a table of nodes, facts as a long table.

    ``nodes``: rule_id, node_id, parent_id (NULL at the root), depth (root 1),
    logic (AND, OR, NOT, IMPLIES; NULL for a leaf; an implication's first child
    is that of the smaller id), path, op (all of the rule language's), number,
    text (for an ordering, a date's, if there is no number), and where used items
    (array of text), low, high, inclusive. Typed rules with units, booleans and
    evidence are ``ruletables``. ``facts``:
    key, path, raw. Facts meet leaves in an equi join on the path, so a subject's
    rows are its facts, not all leaves; each depth is folded into its parents by
    a Kleene aggregate, at most ``max_depth`` times, where children that a
    subject has no fact for count by what they are worth without facts.

    Returns (key, rule_id, result) for every row of ``subjects`` (by default
    those that have a fact) and every rule.
    """
    own = ["rule_id", "node_id", "parent_id", "depth"]
    table = facts.sparkSession.createDataFrame(*_rule_table(nodes))
    # Rows that repeat a subject's path count once; of unlike values the least text is taken.
    met = facts.groupBy(key, "path").agg(F.min("raw").alias("raw")).join(F.broadcast(table.filter("logic is null")), "path")
    level = met.select(key, *own, "negate", "fallback", _leaf_values(met).alias("value"))
    roots = level.filter("parent_id is null").select(key, "rule_id", "value")
    inner = F.broadcast(table.filter("logic is not null").select("rule_id", F.col("node_id").alias("parent_id"), "logic", "n", "n_true", "n_false"))
    placed = F.broadcast(table.filter("logic is not null").select(*own, "negate", "fallback"))
    for d in range(max_depth, 1, -1):
        up = _fold(level.filter(F.col("depth") == d).join(inner, ["rule_id", "parent_id"]), [key, "rule_id", "parent_id"])
        up = up.withColumnRenamed("parent_id", "node_id").join(placed, ["rule_id", "node_id"]).select(key, *own, "negate", "fallback", "value")
        roots = roots.unionByName(up.filter("parent_id is null").select(key, "rule_id", "value"))
        level = level.filter(F.col("depth") < d).unionByName(up.filter("parent_id is not null"))
    every = (subjects if subjects is not None else facts).select(key).distinct()
    listed = table.filter("parent_id is null").agg(F.collect_list(F.struct("rule_id", "fallback")).alias("r"))
    wanted = every.select(key, F.inline(listed.scalar()))
    result = F.when(F.col("seen"), F.col("value")).otherwise(F.col("fallback"))
    return wanted.join(roots.withColumn("seen", F.lit(True)), [key, "rule_id"], "left").select(key, "rule_id", result.alias("result"))
