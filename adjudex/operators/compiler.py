"""From a model's answer to checked rules: parsing, rewrites, grounding and status, as column expressions.

A policy row has an id, its text and the answer of whatever model was asked
(``adjudex.sources.files.cached_by_prompt`` asks an injected function once for
each prompt). Rules come out of the answer's JSON by one explode; condition
trees are flattened level by level, as far as trees may be deep.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudex.functions import scalars as S
from adjudex.functions import textlint

from .graph import stored
from .rules import LOGIC, MAX_DEPTH, MAX_NODES, OPERATORS, ORDERING, RULE_TYPES, SEVERITIES, TIME_UNITS

MAX_POLICY_CHARS = 20_000
MIN_CONFIDENCE, CAPPED_CONFIDENCE = 0.7, 0.49
_NEGATED = ("!=", "not_in", "not_between", "not_contains", "not_exists")
_EVIDENCE = "array<struct<type:string,description:string,mandatory:boolean,min_count:int,match:map<string,string>>>"
_EXCEPTIONS = "array<struct<description:string,condition:variant>>"
_TEMPORAL = "struct<kind:string,entity:string,field:string,reference:string,amount:double,unit:string,direction:string,start:string,end:string>"
# Wordings that two rewrites look for.
_APPROVAL_BEFORE_PAYMENT = r"(?i)\bapproval\b[^.\n]{0,180}\bbefore\s+(?:the\s+)?payment\b"
_CONFIRMED_VIOLATION = r"(?i)\bconfirmed\s+violations?\b"
_NAME, _PATH = r"^[a-z][a-z0-9_]*$", r"^[a-z][a-z0-9_]*(\.[a-z0-9_]+)*$"


def policy_id(text: Column) -> Column:
    """An id made from a policy's text, white space and case aside."""
    return F.concat(F.lit("POL-"), F.upper(F.left(F.sha1(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).cast("binary")), F.lit(10))))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s\-]+", "_")


def _any(items: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in items])


def _levels(root: Column) -> list[Column]:
    """The nodes of a tree by depth, one level more than is allowed."""
    out = [F.when(root.isNotNull() & (F.schema_of_variant(root) != "VOID"), F.array(root)).otherwise(F.array().cast("array<variant>"))]
    for _ in range(MAX_DEPTH):
        children = F.transform(out[-1], lambda n: F.coalesce(_get(n, "$.children", "array<variant>"), F.array().cast("array<variant>")))
        out.append(F.flatten(children))
    return out


def node_levels(root: Column) -> Column:
    """All nodes of a tree as (node, parent, depth, negate, variant), a child's name being its parent's and its place.

    ``negate``: the parent is NOT, or an implication of which it is the first.
    """

    def made(node: Column, parent: Column, depth: int, negate: Column, variant: Column) -> Column:
        return F.struct(node.alias("node"), parent.alias("parent"), F.lit(depth).alias("depth"), negate.alias("negate"), variant.alias("variant"))

    top = made(F.lit("0"), F.lit(None).cast("string"), 1, F.lit(False), root)
    levels = [F.when(root.isNotNull() & (F.schema_of_variant(root) != "VOID"), F.array(top)).otherwise(F.filter(F.array(top), lambda _: F.lit(False)))]

    def below(depth: int):
        def children_of(n: Column) -> Column:
            logic = F.coalesce(_get(n["variant"], "$.logic", "string"), F.lit(""))
            children = F.coalesce(_get(n["variant"], "$.children", "array<variant>"), F.array().cast("array<variant>"))
            return F.transform(children, lambda c, i: made(F.concat(n["node"], F.lit("."), i.cast("string")), n["node"], depth, (logic == "NOT") | ((logic == "IMPLIES") & (i == 0)), c))

        return children_of

    for depth in range(2, MAX_DEPTH + 1):
        levels.append(F.flatten(F.transform(levels[-1], below(depth))))
    return F.concat(*levels)


def _is_group(n: Column) -> Column:
    return _get(n, "$.logic", "variant").isNotNull() | _get(n, "$.children", "variant").isNotNull()


def _leaf(n: Column) -> Column:
    return F.struct(
        _name(_get(n, "$.entity", "string")).alias("entity"), _name(_get(n, "$.field", "string")).alias("field"), F.trim(_get(n, "$.operator", "string")).alias("op"),
        _get(n, "$.value", "variant").alias("value"), F.nullif(F.trim(_get(n, "$.unit", "string")), F.lit("")).alias("unit"),
    )


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_number(v: Column) -> Column:
    return _kind(v).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")


def _bad_leaf(x: Column) -> Column:
    """Whether a leaf's names, operator or value are no good."""
    kind, op, value = _kind(x["value"]), x["op"], x["value"]
    text = _get(value, "$", "string")
    items = _get(value, "$", "array<string>")
    number, moment = S.as_number(text), S.as_timestamp(text)
    numbers, moments = F.transform(items, lambda i: S.as_number(i)), F.transform(items, lambda i: S.as_timestamp(i))
    scalar = ~kind.rlike("^(ARRAY|OBJECT|VOID)")
    in_order = F.coalesce(F.get(numbers, F.lit(0)) <= F.get(numbers, F.lit(1)), F.get(moments, F.lit(0)) <= F.get(moments, F.lit(1)), F.lit(False))
    fits = (
        F.when(op.isin("exists", "not_exists"), kind == "VOID")
        .when(op.isin("in", "not_in"), F.size(items) > 0)
        .when(op.isin("between", "not_between"), (F.size(items) == 2) & in_order)
        .when(op.isin(*ORDERING), scalar & (kind != "BOOLEAN") & (number.isNotNull() | moment.isNotNull()))
        .otherwise(scalar)
    )
    return ~F.coalesce(x["entity"].rlike(_NAME) & x["field"].rlike(_PATH) & op.isin(*OPERATORS) & fits, F.lit(False))


def _bad_group(n: Column) -> Column:
    logic, size = _get(n, "$.logic", "string"), F.size(_get(n, "$.children", "array<variant>"))
    wanted = F.when(logic == "NOT", size == 1).when(logic == "IMPLIES", size == 2).otherwise(size >= 2)
    mixed = _get(n, "$.operator", "variant").isNotNull() | _get(n, "$.field", "variant").isNotNull()
    return ~F.coalesce(logic.isin(*LOGIC) & wanted & ~mixed, F.lit(False))


def extract(policies: DataFrame) -> DataFrame:
    """(policy_id, policy_text, rule_id, raw) of (policy_id, policy_text, answer) rows: a row for each rule of the answers, numbered by place."""
    parsed = policies.withColumn("__v", S.json_object_in(F.col("answer")))
    rules = parsed.select("policy_id", "policy_text", F.posexplode(F.try_variant_get("__v", "$.rules", "array<variant>")).alias("__at", "raw"))
    return rules.select("policy_id", "policy_text", F.format_string("%s-R%03d", F.col("policy_id"), F.col("__at") + 1).alias("rule_id"), "raw")


def _confirmation(leaf: Column) -> Column:
    """Whether a leaf says just that a violation is confirmed."""
    violation = leaf["entity"].rlike(r"^([a-z][a-z0-9_]*_)?violation$")
    yes = (_kind(leaf["value"]) == "BOOLEAN") & _get(leaf["value"], "$", "boolean")
    flagged = yes & ((leaf["field"] == "violation_confirmed") | ((leaf["field"] == "confirmed") & violation))
    stated = (F.lower(F.trim(_get(leaf["value"], "$", "string"))) == "confirmed") & violation & leaf["field"].isin("status", "state")
    return F.coalesce((leaf["op"] == "==") & leaf["unit"].isNull() & (flagged | stated), F.lit(False))


def check(rules: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules of ``extract`` with their parts and what is found about them.

    status is REJECTED (``errors`` tells why), NEEDS_REVIEW (``ambiguities``;
    confidence is capped) or VALID. Two rewrites come first: an approval that
    must precede payment becomes a match on its evidence's timing, and a
    requirement that a violation be confirmed becomes a trigger.
    """
    v = F.col("raw")
    rows = rules.withColumns(
        {
            "source_text": F.coalesce(_get(v, "$.source_text", "string"), F.lit("")),
            "rule_type": F.upper(F.trim(_get(v, "$.rule_type", "string"))),
            "__temporal": _get(v, "$.temporal", _TEMPORAL),
            "__evidence": F.coalesce(_get(v, "$.required_evidence", _EVIDENCE), F.array().cast(_EVIDENCE)),
            "__exceptions": F.coalesce(_get(v, "$.exception", _EXCEPTIONS), F.array().cast(_EXCEPTIONS)),
            "__stated_severity": _get(v, "$.severity", "variant"),
            "__confidence": F.when(is_number(_get(v, "$.confidence", "variant")), _get(v, "$.confidence", "double")),
            "action": F.btrim(F.regexp_replace(F.lower(F.trim(_get(v, "$.action", "string"))), "[^a-z0-9]+", "_"), F.lit("_")),
            "__said": _get(v, "$.ambiguities", "variant"),
            "__entity": _name(_get(v, "$.entity", "string")),
        }
    )
    # Trees, level by level.
    levels = _levels(_get(v, "$.condition", "variant"))
    rows = rows.withColumn("__nodes", F.concat(*levels[:MAX_DEPTH])).withColumn("__deep", F.size(levels[MAX_DEPTH]) > 0)
    outer = F.transform("__exceptions", lambda e: F.concat(*_levels(e["condition"])[:MAX_DEPTH]))
    rows = rows.withColumn("__exception_nodes", F.flatten(outer))

    def leaves_of(nodes: str) -> Column:
        return F.transform(F.filter(nodes, lambda n: ~_is_group(n)), _leaf)

    rows = rows.withColumns({"leaves": leaves_of("__nodes"), "exception_leaves": leaves_of("__exception_nodes")})

    # Rewrites.
    clause, t = F.col("source_text"), F.col("__temporal")
    about = F.transform("__evidence", lambda e: F.concat_ws(" ", e["type"], e["description"]).rlike(r"(?i)\bapproval\b"))
    pays = F.lower(F.trim(t["entity"])).isin("payment", "payments", "the_payment")
    date_field = F.lower(F.trim(t["field"]))
    on_payment = date_field.isin("payment_date", "date_of_payment") | (pays & (date_field == "date"))
    reference = F.lower(F.trim(t["reference"]))
    no_other = reference.isin("now", "today", "evaluation_date", "payment_date", "date_of_payment") | reference.rlike(r"^(the_)?payments?(\.(payment_)?date)?$")
    misread = F.coalesce(on_payment & (F.lower(F.trim(t["kind"])) == "before") & no_other, F.lit(False))
    timing = clause.rlike(_APPROVAL_BEFORE_PAYMENT) & F.coalesce(F.exists(about, lambda x: x), F.lit(False)) & (t.isNull() | misread)
    only = F.get("leaves", F.lit(0))
    own = F.col("__entity").isNull() | (F.col("__entity") == "") | (F.col("__entity") == only["entity"])
    retype = (
        (F.col("rule_type") == "REQUIRE") & t.isNull() & clause.rlike(_CONFIRMED_VIOLATION) & (F.length(F.coalesce("action", F.lit(""))) > 0)
        & (F.size("__nodes") == 1) & (F.size("leaves") == 1) & F.coalesce(_confirmation(only), F.lit(False)) & F.coalesce(own, F.lit(False))
    )
    rows = rows.withColumns({"__timing": timing, "__retype": retype})

    def timed(e: Column) -> Column:
        is_it = F.col("__timing") & F.concat_ws(" ", e["type"], e["description"]).rlike(r"(?i)\bapproval\b")
        kept = F.map_filter(F.coalesce(e["match"], F.create_map().cast("map<string,string>")), lambda k, _: k != "timing")
        match = F.when(is_it, F.map_concat(kept, F.create_map(F.lit("timing"), F.lit("before_payment")))).otherwise(e["match"])
        return F.struct(S.snake_case(F.trim(e["type"])).alias("type"), e["description"].alias("description"), F.coalesce(e["mandatory"], F.lit(True)).alias("mandatory"), F.coalesce(e["min_count"], F.lit(1)).alias("min_count"), match.alias("match"))

    rows = rows.withColumns(
        {
            "rule_type": F.when(F.col("__retype"), "TRIGGER").otherwise(F.col("rule_type")),
            "temporal": F.when(~F.col("__timing"), t),
            "evidence": F.transform("__evidence", timed),
        }
    )

    # Severity.
    stated = F.when(_kind(F.col("__stated_severity")) == "STRING", _get(F.col("__stated_severity"), "$", "string")).otherwise(F.when(_kind(F.col("__stated_severity")) != "VOID", F.lit("?")))
    rows = rows.withColumn("__severity", stated).withColumn("severity_source", textlint.severity_grounding(F.col("__severity"), clause, F.col("policy_text")))
    rows = rows.withColumn("severity", F.when(F.col("severity_source").isin("policy_stated", "ambiguous"), F.col("__severity")).otherwise("medium"))

    # What makes a rule unusable.
    t = F.col("temporal")
    span = t["kind"].isin("within", "older_than")
    unit = F.lower(F.trim(t["unit"]))
    unit = F.when(F.endswith(unit, F.lit("s")), unit).otherwise(F.concat(unit, F.lit("s")))
    start, end = S.as_timestamp(t["start"]), S.as_timestamp(t["end"])
    bad_span = span & ~F.coalesce((t["amount"] > 0) & unit.isin(*TIME_UNITS) & (~unit.isin("months", "years") | (t["amount"] == F.floor(t["amount"]))), F.lit(False))
    bad_between = (t["kind"] == "between") & ~F.coalesce(start <= end, F.lit(False))
    bad_reference = (t["kind"] != "between") & (F.length(F.trim(F.coalesce(t["reference"], F.lit("")))) == 0)
    bad_temporal = t.isNotNull() & (~F.coalesce(t["kind"].isin("within", "older_than", "before", "after", "between") & _name(t["entity"]).rlike(_NAME) & _name(t["field"]).rlike(_PATH), F.lit(False)) | bad_span | bad_between | bad_reference)
    nothing = (F.size("__nodes") == 0) & t.isNull()
    every = F.concat("leaves", "exception_leaves")
    groups = F.filter(F.concat("__nodes", "__exception_nodes"), _is_group)
    said_list = F.when(_kind(F.col("__said")) == "VOID", F.array().cast("array<variant>")).otherwise(_get(F.col("__said"), "$", "array<variant>"))
    entity = F.coalesce(F.get("leaves", F.lit(0))["entity"], _name(t["entity"]), F.col("__entity"))
    errors = {
        "rule_type": ~F.coalesce(F.col("rule_type").isin(*RULE_TYPES), F.lit(False)),
        "condition": F.exists(every, _bad_leaf) | F.exists(groups, _bad_group) | F.col("__deep") | (F.size("__nodes") > MAX_NODES),
        "temporal": bad_temporal,
        "evidence": F.exists("evidence", lambda e: F.coalesce(F.length(e["type"]), F.lit(0)) == 0) | F.exists("evidence", lambda e: ~e["min_count"].between(1, 1000)),
        "exception": F.exists("__exceptions", lambda e: (F.length(F.coalesce(e["description"], F.lit(""))) == 0) | e["condition"].isNull()),
        "severity": F.col("severity_source") == "invalid",
        "action": ~F.coalesce(F.col("action").rlike(r"^[a-z][a-z0-9_]{2,63}$"), F.lit(False)),
        "confidence": ~F.coalesce(F.col("__confidence").between(0, 1), F.lit(False)),
        "ambiguities": F.coalesce(said_list.isNull() | F.exists(said_list, lambda x: _kind(x) != "STRING"), F.lit(True)),
        "nothing_to_execute": nothing & (F.size("evidence") == 0),
        "always_fires": F.col("rule_type").isin("PROHIBIT", "TRIGGER") & nothing,
        "evidence_of_prohibition": (F.col("rule_type") == "PROHIBIT") & (F.size("evidence") > 0),
        "entity": ~F.coalesce(entity.rlike(_NAME), F.col("__deep")),
    }
    rows = rows.withColumns({"entity": entity, "errors": F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in errors.items()]))})

    # Numbers that a rule uses must be stated.
    def numbers(x: Column) -> Column:
        one = F.when(is_number(x["value"]), F.array(_get(x["value"], "$", "double")))
        several = F.transform(F.filter(F.coalesce(_get(x["value"], "$", "array<variant>"), F.array().cast("array<variant>")), is_number), lambda i: _get(i, "$", "double"))
        return F.coalesce(one, several)

    counts = F.transform(F.filter("evidence", lambda e: e["min_count"] > 1), lambda e: e["min_count"].cast("double"))
    rows = rows.withColumn("numbers", F.concat(F.flatten(F.transform(F.concat("leaves", "exception_leaves"), numbers)), F.array_compact(F.array(t["amount"])), counts))
    trusted = textlint.quoted(clause, F.col("policy_text"))
    scope = F.when(F.trim(clause) != "", clause).otherwise(F.col("policy_text"))
    rows = rows.withColumn("__pool", textlint.numbers_in(F.when(trusted, clause).otherwise(F.col("policy_text"))))

    ops = F.transform("leaves", lambda x: x["op"])
    ends = lambda *which: F.transform(F.filter("leaves", lambda x: x["op"].isin(*which)), lambda x: F.concat(x["entity"], F.lit("."), x["field"]))
    time_unit = F.exists("leaves", lambda x: F.coalesce(F.regexp_replace(F.lower(x["unit"]), "s$", "").isin(*[u[:-1] for u in TIME_UNITS]), F.lit(False)))
    negated = (F.col("rule_type") == "PROHIBIT") | F.exists("__nodes", lambda n: F.coalesce(_get(n, "$.logic", "string") == "NOT", F.lit(False))) | F.arrays_overlap(ops, F.array(*map(F.lit, _NEGATED)))
    ranged = F.arrays_overlap(ops, F.array(F.lit("between"), F.lit("not_between"))) | F.arrays_overlap(ends(">", ">="), ends("<", "<="))
    flags = {"negated": negated, "excepted": F.size("__exceptions") > 0, "timed": t.isNotNull() | time_unit | F.col("__timing"), "ranged": ranged}
    found = textlint.crosschecks(scope, **{n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    unstated = F.transform(F.filter("numbers", lambda n: ~textlint.grounded(n, F.col("__pool"))), lambda n: F.concat(F.lit("number_not_stated: "), n.cast("string")))
    said = F.transform(F.coalesce(_get(F.col("__said"), "$", "array<string>"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("reported: "), x))
    vague = textlint.ambiguity(scope)
    more = {
        "no_quote": F.trim(clause) == "", "not_quoted": (F.trim(clause) != "") & ~trusted, "low_confidence": F.col("__confidence") < min_confidence,
        "severity_unclear": F.col("severity_source") == "ambiguous",
    }
    singles = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in more.items()], F.when(vague.isNotNull(), F.concat(F.lit("vague: "), vague))))
    unitless = F.transform(F.filter("leaves", lambda x: x["op"].isin(*ORDERING) & is_number(x["value"]) & x["unit"].isNull()), lambda x: F.concat(F.lit("no_unit: "), x["entity"], F.lit("."), x["field"]))
    discarded = F.col("__severity").isNotNull() & (F.col("severity_source") == "schema_default")
    issues = F.concat(unitless, F.array_compact(F.array(F.when(discarded, F.lit("severity_discarded")), F.when(F.col("__timing"), F.lit("timing_on_evidence")), F.when(F.col("__retype"), F.lit("retyped_as_trigger")))))
    rows = rows.withColumns({"ambiguities": F.array_distinct(F.concat(said, unstated, found, singles)), "issues": issues})
    rejected, review = F.size("errors") > 0, F.size("ambiguities") > 0
    status = F.when(rejected, "REJECTED").when(review, "NEEDS_REVIEW").otherwise("VALID")
    confidence = F.when(~rejected, F.when(review, F.round(F.least("__confidence", F.lit(CAPPED_CONFIDENCE)), 3)).otherwise(F.col("__confidence")))
    return rows.select(
        "policy_id", "rule_id", status.alias("status"), confidence.alias("confidence"), "rule_type", "entity", "leaves", "exception_leaves", "temporal", "evidence", "severity", "severity_source", "action", "numbers", "source_text", "errors",
        F.when(~rejected, F.col("ambiguities")).otherwise(F.array().cast("array<string>")).alias("ambiguities"), "issues", "raw",
    )


def compile_policies(policies: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules, summary) of (policy_id, policy_text, answer) rows; a null id is made from the text.

    The summary has a row for each policy: status FAILED (no text, a text over
    ``MAX_POLICY_CHARS``, or an answer without a list of rules), REJECTED (no
    rule left), COMPILED_WITH_REVIEW or COMPILED, the counts of rules, and the
    sentences of the policy that are vague without a number.
    """
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be between 0 and 1")
    known = policies.withColumn("policy_id", F.coalesce("policy_id", policy_id(F.col("policy_text"))))
    # Many short policies are one small file, whose checks would be one long task. A number that is given isn't lowered by their bytes.
    n = int(policies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("policy_text")
    answer = S.json_object_in(F.col("answer"))
    unparsed = F.size(F.filter(F.coalesce(_get(answer, "$.unparsed_statements", "array<variant>"), F.array().cast("array<variant>")), lambda u: F.length(F.coalesce(_get(u, "$.text", "string"), F.lit(""))) > 0))
    vague = F.filter(textlint.sentences(text), lambda s: textlint.ambiguity(s).isNotNull())
    said = [_get(answer, "$.rules", "array<variant>").isNotNull().alias("answered"), unparsed.alias("unparsed"), vague.alias("vague_sentences")]
    readable = F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) <= MAX_POLICY_CHARS), F.lit(False))
    named = F.coalesce(F.col("policy_id").rlike(r"^[A-Za-z0-9_.\-]{1,64}$"), F.lit(False))
    known = known.repartition(n, "policy_id")
    # Policies often say the same: a text with its answer is then checked once, however many policies have it.
    content = F.md5(F.to_json(F.struct("policy_text", "answer")).cast("binary"))
    size = policies.agg(F.count("*").alias("rows"), F.count_distinct(content).alias("contents")).first()
    if 2 * size["contents"] > size["rows"]:
        rules = check(extract(known.filter(readable & named)), min_confidence)
        own = known.select("policy_id", (readable & named).alias("fit"), *said)
    else:
        known = known.select("policy_id", content.alias("__content"), (readable & named).alias("fit"))
        contents = policies.select("policy_text", "answer").distinct().select(content.alias("policy_id"), "policy_text", "answer").repartition(n, "policy_id")
        checked = stored(check(extract(contents.filter(readable)), min_confidence), "checked").withColumnsRenamed({"policy_id": "__content", "rule_id": "__place"})
        rules = known.filter("fit").drop("fit").join(checked, "__content")
        place = F.expr("substr(__place, length(__content) + 1)")
        rules = rules.select("policy_id", F.concat("policy_id", place).alias("rule_id"), *[c for c in checked.columns if not c.startswith("__")])
        own = known.join(contents.select(F.col("policy_id").alias("__content"), *said), "__content")
    counts = rules.groupBy("policy_id").agg(F.count("*").alias("extracted"), *[F.count_if(F.col("status") == s).alias(c) for s, c in (("VALID", "valid"), ("NEEDS_REVIEW", "needs_review"), ("REJECTED", "rejected"))])
    both = own.join(counts, "policy_id", "left").na.fill(0, ["extracted", "valid", "needs_review", "rejected"])
    usable = F.col("valid") + F.col("needs_review")
    review = (F.col("needs_review") + F.col("rejected") + F.col("unparsed") + F.size("vague_sentences")) > 0
    status = F.when(~(F.col("fit") & F.col("answered")), "FAILED").when(usable == 0, "REJECTED").when(review, "COMPILED_WITH_REVIEW").otherwise("COMPILED")
    return rules, both.select("policy_id", status.alias("status"), "extracted", "valid", "needs_review", "rejected", "unparsed", "vague_sentences")
