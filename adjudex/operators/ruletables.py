"""Rules as data: what the policy compiler gives, evaluated as tables, without a ``Rule`` object.

A rule is one row that holds its trees' nodes; a subject is one row that holds
its facts, each read once. Thresholds of all rules on a fact are a sorted array
by fact and unit: a fact is placed in it once by binary search, and every
comparison with it is then one of two ranks. Rows of subjects meet rows of the
rules that apply to them in one join; a tree, which has ``MAX_NODES`` nodes at
most, is folded inside that row, so there is no shuffle by node or by depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudex.functions import scalars as S

from .compiler import is_number, node_levels
from .graph import stored
from .rules import ORDERING

#: Nodes of a rule table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Kinds of records whose amount may go by another name.
TRANSACTIONS = ("transaction", "expense", "payment", "invoice")
_NOW = ("now", "today", "evaluation_date")
_RANKED = (*ORDERING, "between", "not_between")
_LITERAL = "struct<kind:string,number:double,moment:timestamp_ntz,flag:boolean,norm:string,rank:int>"


@dataclass(frozen=True)
class RuleTables:
    """``policies``: policy_id, rule_id and form of each rule; ``rules``: a row for each form, with its trees; ``index``: for each fact and unit, the sorted thresholds; ``needs``: distinct evidence needs."""

    policies: DataFrame
    rules: DataFrame
    index: DataFrame
    needs: DataFrame
    n_nodes: int

    def small(self, df: DataFrame) -> DataFrame:
        """``df`` as a side to broadcast, if the forms of rules are few enough."""
        return F.broadcast(df) if self.few else df

    @property
    def few(self) -> bool:
        return self.n_nodes <= BROADCAST_NODES


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _nodes(checked: DataFrame) -> DataFrame:
    """(rule_id, tree, node, parent, depth, negate, logic, and a leaf's fact, unit, op, value, inclusive); tree 0 is the condition, others are exceptions."""
    exceptions = F.coalesce(F.try_variant_get("raw", "$.exception", "array<struct<condition:variant>>"), F.array().cast("array<struct<condition:variant>>"))
    conditions = F.concat(F.array(F.try_variant_get("raw", "$.condition", "variant")), F.transform(exceptions, lambda e: e["condition"]))
    trees = checked.select("rule_id", F.posexplode(conditions).alias("tree", "root"))
    rows = trees.select("rule_id", "tree", F.explode(node_levels(F.col("root"))).alias("n")).select("rule_id", "tree", "n.*")

    def part(path: str) -> Column:
        return F.try_variant_get("variant", path, "string")

    def name(c: Column) -> Column:
        return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")

    return rows.select(
        "rule_id", "tree", "node", "parent", "depth", "negate", part("$.logic").alias("logic"),
        F.concat_ws(".", name(part("$.entity")), name(part("$.field"))).alias("fact"),
        F.coalesce(S.unit_name(F.nullif(F.trim(part("$.unit")), F.lit(""))), F.lit("")).alias("unit"),
        F.trim(part("$.operator")).alias("op"),
        F.coalesce(F.try_variant_get("variant", "$.inclusive", "boolean"), F.lit(True)).alias("inclusive"),
        F.try_variant_get("variant", "$.value", "variant").alias("value"),
    )


def _literals(nodes: DataFrame) -> DataFrame:
    """Replace ``value`` by ``literals``, each read in its kind: number, moment, boolean, numeric (a number's text) or text."""
    kind = F.coalesce(F.schema_of_variant("value"), F.lit("VOID"))
    empty = F.array().cast("array<variant>")
    items = F.when(kind == "VOID", empty).when(kind.startswith("ARRAY"), F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))

    def read(v: Column) -> Column:
        text, own = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
        number, moment = S.as_number(text), F.when(text.rlike(r"\d{4}"), S.as_timestamp(text))
        ranked = F.col("op").isin(*_RANKED)
        which = (
            F.when(own == "BOOLEAN", "boolean").when(is_number(v) | (ranked & number.isNotNull()), "number").when(moment.isNotNull(), "moment").when(number.isNotNull(), "numeric").otherwise("text")
        )
        flag = F.when(own == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        return F.struct(which.alias("kind"), number.alias("number"), moment.alias("moment"), flag.alias("flag"), S.normal_text(text).alias("norm"), F.lit(None).cast("int").alias("rank"))

    return nodes.withColumn("literals", F.transform(items, read)).drop("value")


def amount_aliases(checked: DataFrame, records: DataFrame, entities: tuple[str, ...] = TRANSACTIONS) -> DataFrame:
    """(rule_id, entity, from_field, to_field): amounts that rules call by another name than the records of their entity.

    ``records``: entity, record_id, field, raw. ``total_amount``, ``total`` and
    the entity's own ``<entity>_amount`` stand for ``amount`` where the entity is
    one of ``entities``, all its records have an amount, none has the named field,
    and the rule doesn't read the entity's amount itself. Exceptions count as
    parts of their rule. A field with a null or blank text is not there.
    """
    leaves = _nodes(checked.filter("status <> 'REJECTED'")).filter("op is not null").select("rule_id", F.split_part("fact", F.lit("."), F.lit(1)).alias("entity"), F.expr("substr(fact, instr(fact, '.') + 1)").alias("field"))
    there = records.select("record_id", *[F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_").alias(c) for c in ("entity", "field")], S.present(F.col("raw")).alias("there"))
    each = there.groupBy("entity", "record_id").agg(F.bool_or((F.col("field") == "amount") & F.col("there")).alias("has"))
    grounded = each.groupBy("entity").agg(F.bool_and(F.coalesce("has", F.lit(False))).alias("all")).filter("all").select("entity")
    own = F.col("field").isin("total_amount", "total") | (F.col("field") == F.concat("entity", F.lit("_amount")))
    named = leaves.filter(F.col("entity").isin(*entities) & own).distinct()
    found = named.join(grounded, "entity").join(there.filter("there").select("entity", "field").distinct(), ["entity", "field"], "left_anti")
    found = found.join(leaves.filter("field = 'amount'").select("rule_id", "entity").distinct(), ["rule_id", "entity"], "left_anti")
    return found.select("rule_id", "entity", F.col("field").alias("from_field"), F.lit("amount").alias("to_field"))


def rule_tables(checked: DataFrame, aliases: DataFrame | None = None) -> RuleTables:
    """Tables of the rules of ``compiler.check`` that are not rejected; their leaves read what ``aliases`` (of ``amount_aliases``) name.

    Rules that say the same, in whatever policies, are one form, so that what is
    evaluated grows with what is said: ``policies`` has the form of each rule.
    ``rules`` keeps form, rule_type, severity, action and status, and has
    ``trees`` (nodes from the deepest up; the condition first),
    ``descriptions`` of the exceptions, ``temporal`` and ``evidence``.
    """
    usable = checked.filter("status <> 'REJECTED'")
    parts = ["rule_type", "severity", "action", "status", "temporal", "evidence", *[F.try_variant_get("raw", f"$.{c}", "variant").alias(c) for c in ("condition", "exception")]]
    if aliases is not None:
        named = aliases.groupBy("rule_id").agg(F.array_sort(F.collect_set(F.struct("entity", "from_field", "to_field"))).alias("aliases"))
        usable, parts = usable.join(named, "rule_id", "left"), [*parts, "aliases"]
    usable = usable.withColumn("form", F.unhex(F.md5(F.to_json(F.struct(*parts)).cast("binary"))))
    policies = stored(usable.select("policy_id", "rule_id", "form"), "rules")
    first = policies.groupBy("form").agg(F.min("rule_id").alias("rule_id"))
    forms = stored(usable.drop("policy_id").join(first, ["form", "rule_id"]).dropDuplicates(["form"]).drop("rule_id").withColumnRenamed("form", "rule_id"), "forms")
    nodes = _nodes(forms)
    if aliases is not None:
        renamed = forms.select("rule_id", F.inline("aliases")).select("rule_id", F.concat_ws(".", "entity", "from_field").alias("fact"), F.concat_ws(".", "entity", "to_field").alias("__fact"))
        nodes = nodes.join(renamed, ["rule_id", "fact"], "left").withColumn("fact", F.coalesce("__fact", "fact")).drop("__fact")
    nodes = stored(_literals(nodes), "nodes")
    n_nodes = nodes.count()

    # The predicate index: sorted thresholds of every fact, by unit.
    ranked = nodes.filter(F.col("op").isin(*_RANKED)).select("fact", "unit", F.explode("literals").alias("x"))
    index = ranked.groupBy("fact", "unit").agg(F.array_sort(F.collect_set("x.number")).alias("bounds"), F.array_sort(F.collect_set(F.when(F.col("x.number").isNull(), F.col("x.moment")))).alias("moments"))
    asked = nodes.filter("op is not null").select("fact", "unit").distinct().join(index, ["fact", "unit"], "left")
    whole = forms.select(F.explode(F.array(_temporal_fact(), _reference_fact())).alias("fact")).dropna().distinct().withColumn("unit", F.lit(""))
    index = asked.unionByName(whole.join(asked.select("fact", "unit"), ["fact", "unit"], "left_anti"), allowMissingColumns=True)
    # Powers of two down to one, for the search in either array.
    most = F.greatest(F.size(F.coalesce("bounds", F.array().cast("array<double>"))), F.size(F.coalesce("moments", F.array().cast("array<timestamp_ntz>"))))
    index = index.withColumn("steps", F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int")))

    both = nodes.join(index, ["fact", "unit"], "left")
    own = F.transform("literals", lambda x: x.withField("rank", F.when(x["number"].isNotNull(), F.array_position("bounds", x["number"])).otherwise(F.array_position("moments", x["moment"])).cast("int")))
    literals = F.when(F.col("op").isin(*_RANKED), own).otherwise(F.col("literals")).cast(f"array<{_LITERAL}>")
    key = F.concat_ws("|", "fact", "unit")
    node = F.struct((-F.col("depth")).alias("up"), "node", "parent", "negate", "logic", "fact", key.alias("key"), "op", "inclusive", literals.alias("literals"))
    trees = both.groupBy("rule_id", "tree").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    trees = trees.groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("tree", "nodes"))).alias("by_tree"))

    described = F.coalesce(F.try_variant_get("raw", "$.exception", "array<struct<description:string>>"), F.array().cast("array<struct<description:string>>"))
    need = lambda e: F.sha1(F.to_json(F.struct(e["type"].alias("t"), F.array_sort(F.map_entries(e["match"])).alias("m"))).cast("binary"))
    kept = forms.select(
        "rule_id", "rule_type", "severity", "action", "status", _temporal().alias("__temporal"), _temporal_fact().alias("own_fact"), _reference_fact().alias("reference_fact"),
        F.transform("evidence", lambda e: F.struct(need(e).alias("need"), e["type"].alias("type"), e["match"].alias("match"), e["mandatory"].alias("mandatory"), e["min_count"].alias("min_count"))).alias("evidence"),
        F.transform(described, lambda d: d["description"]).alias("descriptions"),
    )
    rules = kept.join(trees, "rule_id", "left")
    # A rule without a condition has no nodes.
    rules = rules.withColumn("trees", F.transform(F.sequence(F.lit(0), F.size("descriptions")), lambda i: F.element_at("by_tree", i))).drop("by_tree")
    needs = kept.select(F.explode("evidence").alias("e")).select("e.need", "e.type", "e.match").dropDuplicates(["need"])
    return RuleTables(policies, rules.withColumnRenamed("rule_id", "form"), index, needs, n_nodes)


def _fact_name(entity: Column, path: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.concat_ws(".", entity, path))), r"[\s\-]+", "_")


def _temporal_fact() -> Column:
    t = F.col("temporal")
    return F.when(t.isNotNull(), _fact_name(t["entity"], t["field"]))


def _temporal() -> Column:
    """The temporal constraint with its dates read."""
    t = F.col("temporal")
    unit = F.lower(F.trim(t["unit"]))
    return F.when(
        t.isNotNull(),
        F.struct(
            t["kind"].alias("kind"), F.coalesce(F.lower(F.trim(t["direction"])), F.lit("after")).alias("direction"), t["amount"].alias("amount"),
            F.when(unit.endswith("s"), unit).otherwise(F.concat(unit, F.lit("s"))).alias("unit"), F.coalesce(F.lower(F.trim(t["reference"])).isin(*_NOW), F.lit(False)).alias("is_now"),
            S.as_timestamp(t["reference"]).alias("fixed"), S.as_timestamp(t["start"]).alias("start"), S.as_timestamp(t["end"]).alias("end"),
        ),
    )


def _reference_fact() -> Column:
    """The fact that a temporal constraint refers to, if it is neither a date nor the evaluation date."""
    t = F.col("temporal")
    reference = F.lower(F.trim(t["reference"]))
    fixed = reference.isin(*_NOW) | (reference.rlike(r"\d{4}") & S.as_timestamp(t["reference"]).isNotNull())
    return F.when(t.isNotNull() & (t["kind"] != "between") & ~fixed, reference)


def _place(bounds: Column, steps: Column, x: Column) -> Column:
    """(below, upto): how many of the sorted, distinct ``bounds`` are less than ``x``, and at most ``x``, by binary search in falling ``steps``."""
    below = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(bounds, lo + step - 1) < x, lo + step).otherwise(lo))
    here = lambda n: F.struct(n.alias("below"), F.when(F.get(bounds, n) == x, n + 1).otherwise(n).alias("upto"))
    return F.when(x.isNotNull() & (F.size(bounds) > 0), _let(below, here))


def place_facts(facts: DataFrame, tables: RuleTables, key: str = "subject_id", rates: dict[str, float] | None = None, strict_units: bool = False) -> DataFrame:
    """(key, facts): a row for each subject, its facts read once and placed among the thresholds on them.

    ``facts``: key, ``fact`` (entity.path), ``raw`` text, and if wanted ``unit``; a null
    unit is looked for in the text. Rows that repeat a subject's fact count
    once; of unlike values the least text is taken. Facts that no rule reads go.
    """
    unit = F.col("unit") if "unit" in facts.columns else F.lit(None).cast("string")
    one = facts.select(key, F.lower("fact").alias("fact"), F.struct(F.col("raw").alias("raw"), unit.alias("unit")).alias("v")).groupBy(key, "fact").agg(F.min("v").alias("v"))
    index = tables.index.withColumnRenamed("unit", "wanted")
    rows = one.join(tables.small(index), "fact")
    raw, given, plain = F.col("v.raw"), F.col("v.unit"), F.col("plain")
    # Each text is taken apart once: a date has a year, and what is a plain number has no unit. What is long is read in a
    # lambda, as the method that is generated for all of a stage would otherwise be too long for the JVM to compile.
    rows = rows.withColumns({"plain": S.as_number(raw), "moment": _let(raw, lambda r: F.when(r.rlike(r"\d{4}"), S.as_timestamp(r)))})
    rows = rows.withColumn("__parts", _let(raw, lambda r: F.when(given.isNull() & plain.isNull(), S.quantity_parts(r))))
    rows = rows.withColumn("__amount", _let(F.col("__parts.number"), S.as_number))
    named = F.when(given.isNotNull(), given).when(F.col("__amount").isNotNull(), F.col("__parts.unit"))
    rows = rows.withColumns({"value": F.coalesce("plain", "__amount"), "has": _let(named, S.unit_name)})

    def in_unit(x: Column) -> Column:
        bare = F.lit(None).cast("double") if strict_units else x["value"]
        return F.when(x["wanted"] == "", x["value"]).when(x["has"].isNull(), bare).otherwise(S.convert(x["value"], x["has"], x["wanted"], rates or {}))

    rows = rows.withColumn("number", _let(F.struct("value", "has", "wanted"), in_unit))
    read = F.struct(
        S.present(raw).alias("there"), "number", "plain", "moment", S.as_boolean(raw).alias("flag"), S.normal_text(raw).alias("norm"),
        _place(F.col("bounds"), F.col("steps"), F.col("number")).alias("at"), _place(F.col("moments"), F.col("steps"), F.col("moment")).alias("when"),
    )
    return rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "fact", "wanted"), read))).alias("facts"))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))


def _same(f: Column, x: Column) -> Column:
    """Whether a fact equals a literal; NULL for an absent or unreadable one."""
    norm = f["norm"] == x["norm"]
    by_kind = (
        F.when(x["kind"] == "boolean", f["flag"] == x["flag"])
        .when(x["kind"] == "number", _close(f["number"], x["number"]))
        .when(x["kind"] == "moment", F.coalesce(f["moment"] == x["moment"], norm))
        .when(x["kind"] == "numeric", F.coalesce(_close(f["plain"], x["number"]), norm))
        .otherwise(norm)
    )
    return F.when(f["there"], by_kind)


def _leaf_value(n: Column, f: Column) -> Column:
    """True, false or NULL, of a leaf node and its fact (NULL if the subject has none)."""
    op, x = n["op"], F.get(n["literals"], 0)
    there = F.coalesce(f["there"], F.lit(False))
    at = F.when(x["kind"] == "number", f["at"]).otherwise(f["when"])
    low, high = x["rank"], F.get(n["literals"], 1)["rank"]
    inside = F.when(n["inclusive"], (at["upto"] >= low) & (at["below"] < high)).otherwise((at["below"] >= low) & (at["upto"] < high))
    items = F.transform(n["literals"], lambda i: _same(f, i))
    found = F.when(F.exists(items, lambda v: F.coalesce(v, F.lit(False))), F.lit(True)).when(F.exists(items, lambda v: v.isNotNull()), F.lit(False))
    held = F.when(there, F.contains(f["norm"], x["norm"]))
    tests = {
        ">": at["below"] >= low, ">=": at["upto"] >= low, "<": at["upto"] < low, "<=": at["below"] < low, "==": _same(f, x), "!=": ~_same(f, x), "in": found, "not_in": ~found,
        "between": inside, "not_between": ~inside, "contains": held, "not_contains": ~held, "exists": there, "not_exists": ~there,
    }
    return reduce(lambda a, t: a.when(op == t[0], t[1]), list(tests.items())[1:], F.when(op == ">", tests[">"]))


def tree_value(nodes: Column, facts: Column) -> Column:
    """A tree's value: its nodes from the deepest up, each after its children; a tree without nodes is true."""
    start = F.array().cast("array<struct<parent:string,v:boolean>>")

    def fold(done: Column, n: Column) -> Column:
        children = F.filter(done, lambda d: d["parent"] == n["node"])
        every, some = F.forall(children, lambda d: d["v"]), F.exists(children, lambda d: d["v"])
        group = F.when(n["logic"].isin("AND", "NOT"), every).otherwise(some)
        value = F.when(n["logic"].isNotNull(), group).otherwise(_let(F.element_at(facts, n["key"]), lambda f: _leaf_value(n, f)))
        return F.array_append(done, F.struct(n["parent"].alias("parent"), _let(value, lambda v: F.when(n["negate"], ~v).otherwise(v)).alias("v")))

    # Most trees are one leaf, which needs no fold.
    only = _let(F.get(nodes, F.lit(0)), lambda n: _let(F.element_at(facts, n["key"]), lambda f: _leaf_value(n, f)))
    lone = (F.size(nodes) == 1) & F.get(nodes, F.lit(0))["logic"].isNull() & ~F.get(nodes, F.lit(0))["negate"]
    return F.when(nodes.isNull(), F.lit(True)).when(lone, only).otherwise(F.aggregate(nodes, start, fold, lambda d: F.element_at(d, -1)["v"]))


def _absent(nodes: Column, facts: Column) -> Column:
    read = F.filter(nodes, lambda n: n["logic"].isNull() & ~n["op"].isin("exists", "not_exists"))
    gone = F.filter(read, lambda n: ~F.coalesce(F.element_at(facts, n["key"])["there"], F.lit(False)))
    return F.coalesce(F.transform(gone, lambda n: n["fact"]), F.array().cast("array<string>"))


def _temporal_value(facts: Column, now: Column) -> Column:
    """The constraint's value: its dates were read with the rule, its facts with the subject."""
    t = F.col("__temporal")
    own = F.element_at(facts, F.concat(F.col("own_fact"), F.lit("|")))["moment"]
    other = F.element_at(facts, F.concat(F.col("reference_fact"), F.lit("|")))["moment"]
    reference = F.when(F.col("reference_fact").isNotNull(), other).when(t["is_now"], now).otherwise(t["fixed"])
    struct = F.struct(own.alias("own"), reference.alias("at"))

    def held(x: Column) -> Column:
        back, on = S.shift_by(x["at"], t["amount"], t["unit"], -1), S.shift_by(x["at"], t["amount"], t["unit"], 1)
        low = F.when(t["direction"].isin("before", "either"), back).otherwise(x["at"])
        high = F.when(t["direction"] == "before", x["at"]).otherwise(on)
        return (
            F.when(t["kind"] == "between", x["own"].between(t["start"], t["end"]))
            .when(t["kind"] == "before", x["own"] < x["at"]).when(t["kind"] == "after", x["own"] > x["at"]).when(t["kind"] == "older_than", x["own"] < back).otherwise(x["own"].between(low, high))
        )

    return F.when(t.isNull(), F.lit(True)).otherwise(_let(struct, held))


def count_needs(evidence: DataFrame, tables: RuleTables, key: str) -> DataFrame:
    """(key, counts): for each subject, how many items meet each need, as a map."""
    kind = S.snake_case(F.col("type"))
    met = evidence.select(key, kind.alias("type"), "attrs").join(tables.small(tables.needs), "type")
    fits = F.forall(F.map_entries(F.coalesce("match", F.create_map().cast("map<string,string>"))), lambda m: F.coalesce(S.normal_text(F.element_at("attrs", m["key"])) == S.normal_text(m["value"]), F.lit(False)))
    counts = met.filter(fits).groupBy(key, "need").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("need", "n"))).alias("counts"))


def evaluate_rules(
    applies: DataFrame, tables: RuleTables, facts: DataFrame, evidence: DataFrame | None = None, key: str = "subject_id", now: Column | None = None,
    include_needs_review: bool = False, rates: dict[str, float] | None = None, strict_units: bool = False,
) -> DataFrame:
    """A row for each (subject, rule): policy_id, rule_id, verdict, severity, action, exception_applied, missing_facts.

    ``applies`` has the key and the policy_id of each policy that a subject is
    held against, so the work grows with these pairs. ``facts`` as in
    ``place_facts``; ``evidence``: key, ``type``, ``attrs`` (map), or None where
    none was supplied. Verdicts are those of ``evaluate`` on the same rules.
    """
    rows = applies.select(key, "policy_id").distinct().join(tables.policies, "policy_id")
    # Trees that are broadcast come after the facts, so that they do not shuffle.
    if not tables.few:
        rows = rows.join(tables.rules, "form")
    rows = rows.join(place_facts(facts, tables, key, rates, strict_units), key, "left")
    if evidence is not None:
        rows = rows.join(count_needs(evidence, tables, key), key, "left")
    if tables.few:
        rows = rows.join(F.broadcast(tables.rules), "form")
    own, run = F.col("facts"), F.lit(include_needs_review) | (F.col("status") == "VALID")
    trees = F.col("trees")
    today = now if now is not None else F.lit(None).cast("timestamp_ntz")
    held = F.transform(trees, lambda nodes: tree_value(nodes, own))
    rows = rows.withColumns({"__trees": held, "__in_time": _temporal_value(own, today)})
    rows = rows.withColumn("__holds", F.get("__trees", F.lit(0)) & F.col("__in_time"))

    # Evidence, then the rule type's table, then exceptions.
    found = lambda e: F.coalesce(F.element_at("counts", e["need"]), F.lit(0).cast("long")) if evidence is not None else F.lit(0).cast("long")
    lacking = F.exists("evidence", lambda e: e["mandatory"] & (found(e) < e["min_count"]))
    mandatory = F.exists("evidence", lambda e: e["mandatory"])
    rows = rows.withColumn("__proof", F.when(~mandatory, "OK").when(F.lit(evidence is None), "NOT_SUPPLIED").when(lacking, "MISSING").otherwise("OK"))
    by_evidence = F.when(F.col("__proof") == "MISSING", "VIOLATION").when(F.col("__proof") == "NOT_SUPPLIED", "INDETERMINATE")
    holds, kind = F.col("__holds"), F.col("rule_type")
    fired = by_evidence.otherwise(F.when(F.size("evidence") > 0, "COMPLIANT").otherwise("ACTION_REQUIRED"))
    base = (
        F.when(holds.isNull(), "INDETERMINATE")
        .when(kind == "PROHIBIT", F.when(holds, "VIOLATION").otherwise("COMPLIANT"))
        .when(kind == "REQUIRE", F.when(~holds, "VIOLATION").otherwise(by_evidence.otherwise("COMPLIANT")))
        .otherwise(F.when(~holds, "NOT_APPLICABLE").otherwise(fired))
    )
    rows = rows.withColumn("__base", base)
    exempt = F.slice("__trees", F.lit(2), F.greatest(F.size("__trees") - 1, F.lit(0)))
    looked = F.col("__base").isin("VIOLATION", "ACTION_REQUIRED")
    some = F.exists(exempt, lambda x: x)
    verdict = F.when(looked & (F.size(exempt) > 0), F.when(some, "EXEMPT").when(some.isNull(), "INDETERMINATE").otherwise(F.col("__base"))).otherwise(F.col("__base"))
    rows = rows.withColumn("verdict", F.when(run, verdict).otherwise("INDETERMINATE"))

    first = F.array_position(F.transform(exempt, lambda x: F.coalesce(x, F.lit(False))), True)
    there = lambda fact: F.coalesce(F.element_at(own, F.concat(fact, F.lit("|")))["there"], F.lit(False))
    moment = F.element_at(own, F.concat(F.col("own_fact"), F.lit("|")))["moment"]
    gaps = F.concat(
        _absent(F.get(trees, F.lit(0)), own),
        F.array_compact(F.array(F.when(~there(F.col("own_fact")), F.col("own_fact")), F.when(moment.isNotNull() & ~there(F.col("reference_fact")), F.col("reference_fact")))),
        F.when(looked, F.flatten(F.transform(F.slice(trees, F.lit(2), F.greatest(F.size(trees) - 1, F.lit(0))), lambda n: _absent(n, own)))).otherwise(F.array().cast("array<string>")),
    )
    acts = F.col("verdict").isin("VIOLATION", "ACTION_REQUIRED")
    return rows.select(
        key, "policy_id", "rule_id", "verdict", F.when(acts, F.col("severity")).alias("severity"), F.when(acts, F.col("action")).alias("action"),
        F.when(F.col("verdict") == "EXEMPT", F.get("descriptions", first.cast("int") - 1)).alias("exception_applied"),
        F.when(run, F.array_sort(F.array_distinct(gaps))).otherwise(F.array().cast("array<string>")).alias("missing_facts"),
    )


def decide_lines(verdicts: DataFrame, line: str, *keys: str) -> DataFrame:
    """(keys, line, verdict): the rules that one line of a policy was compiled to, merged into one verdict.

    A violation decides, then a required action; a rule that can't be judged
    keeps its siblings from making the line compliant, so the line has none
    (NULL). Exempt and inapplicable rules decide only where all others do so:
    EXEMPT if one is, else NOT_APPLICABLE.
    """
    v = F.col("verdict")
    has = lambda name: F.bool_or(v == name)
    merged = F.when(has("VIOLATION"), "VIOLATION").when(has("ACTION_REQUIRED"), "ACTION_REQUIRED").when(has("INDETERMINATE") | F.bool_or(v.isNull()), F.lit(None))
    return verdicts.groupBy(*keys, line).agg(merged.when(has("COMPLIANT"), "COMPLIANT").when(has("EXEMPT"), "EXEMPT").otherwise("NOT_APPLICABLE").alias("verdict"))
