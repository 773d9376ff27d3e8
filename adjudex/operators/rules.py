"""The policy rule language: conditions, temporal constraints, evidence and exceptions.

Rules are validated when they are made, then compiled to one nullable-boolean
column each, so that Catalyst sees plain expressions. Three-valued logic is
SQL's own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adjudex.functions import scalars as S

ORDERING = (">", ">=", "<", "<=")
OPERATORS = (*ORDERING, "==", "!=", "in", "not_in", "between", "not_between", "contains", "not_contains", "exists", "not_exists")
LOGIC = ("AND", "OR", "NOT", "IMPLIES")
RULE_TYPES = ("REQUIRE", "PROHIBIT", "TRIGGER")
SEVERITIES = ("low", "medium", "high", "critical")
TIME_UNITS = ("minutes", "hours", "days", "weeks", "months", "years")
MAX_DEPTH, MAX_NODES = 6, 50
_NOW = ("now", "today", "evaluation_date")


# Formats of dates with a month's name.
_NAMED = ("%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y")


def read_date(value: object) -> datetime | None:
    """A literal's date, read as the fact side is: ISO 8601 or with a month's name, in UTC without a zone."""
    text = value.strip() if isinstance(value, str) else ""
    found = None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        for form in _NAMED:
            try:
                found = datetime.strptime(text, form)
                break
            except ValueError:
                continue
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found is not None and found.tzinfo else found


def is_date(value: object) -> bool:
    """Whether a literal is a date's text."""
    return read_date(value) is not None and bool(re.search(r"\d{4}", str(value)))


def _moment(value: str) -> Column:
    return F.lit(read_date(value).isoformat(sep=" ")).cast("timestamp_ntz")


def _numeric(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and abs(value) < float("inf")


def _number(value: object) -> float | None:
    """The number of a literal, which may be text such as ``10,000``."""
    if isinstance(value, str):
        try:
            value = float(value.strip().replace(",", ""))
        except ValueError:
            return None
    return float(value) if _numeric(value) else None


@dataclass(frozen=True)
class Leaf:
    entity: str
    path: str
    op: str
    value: object = None
    unit: str | None = None
    inclusive: bool = True

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.entity) or not re.fullmatch(r"[a-z][a-z0-9_]*(\.[a-z0-9_]+)*", self.path):
            raise ValueError(f"bad fact name {self.entity}.{self.path}")
        v = self.value
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op in ("exists", "not_exists"):
            ok = v is None
        elif self.op in ("in", "not_in"):
            ok = isinstance(v, (list, tuple)) and len(v) > 0
        elif self.op in ("between", "not_between"):
            read = _number if isinstance(v, (list, tuple)) and all(_number(x) is not None for x in v) else read_date
            ok = isinstance(v, (list, tuple)) and len(v) == 2 and (read is _number or all(map(is_date, v))) and read(v[0]) <= read(v[1])
            if ok and read is _number:
                object.__setattr__(self, "value", [_number(x) for x in v])
        elif self.op in ORDERING:
            ok = _number(v) is not None or is_date(v)
            if ok and isinstance(v, str) and _number(v) is not None:
                object.__setattr__(self, "value", _number(v))
        else:
            ok = isinstance(v, (str, int, float, bool))
        if not ok:
            raise ValueError(f"{v!r} is no value for {self.op}")


@dataclass(frozen=True)
class Group:
    logic: str
    children: tuple[Leaf | Group, ...]

    def __post_init__(self) -> None:
        wanted = {"NOT": 1, "IMPLIES": 2}.get(self.logic)
        if self.logic not in LOGIC or not self.children or (wanted and len(self.children) != wanted):
            raise ValueError(f"bad group {self.logic} of {len(self.children)}")


Node = Leaf | Group


@dataclass(frozen=True)
class Temporal:
    kind: str
    entity: str
    path: str
    reference: str | None = None
    amount: float | None = None
    unit: str | None = None
    direction: str = "after"
    start: str | None = None
    end: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("within", "older_than", "before", "after", "between") or self.direction not in ("after", "before", "either"):
            raise ValueError(f"bad temporal constraint {self.kind} {self.direction}")
        if self.kind in ("within", "older_than") and not (self.amount and 0 < self.amount < float("inf") and self.unit in TIME_UNITS and (self.unit not in ("months", "years") or self.amount == int(self.amount))):
            raise ValueError(f"bad span {self.amount} {self.unit}")
        if self.kind == "between":
            if not (is_date(self.start) and is_date(self.end)) or read_date(self.start) > read_date(self.end):
                raise ValueError(f"bad interval {self.start} to {self.end}")
        elif not self.reference:
            raise ValueError("a reference is needed")


@dataclass(frozen=True)
class Evidence:
    type: str
    mandatory: bool = True
    min_count: int = 1
    match: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.min_count <= 1000:
            raise ValueError(f"min_count {self.min_count}")


@dataclass(frozen=True)
class Exemption:
    description: str
    condition: Node


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    condition: Node | None = None
    temporal: Temporal | None = None
    evidence: tuple[Evidence, ...] = ()
    exceptions: tuple[Exemption, ...] = ()
    severity: str = "medium"
    action: str | None = None
    status: str = "VALID"
    entity: str | None = None

    def __post_init__(self) -> None:
        if self.rule_type not in RULE_TYPES or self.severity not in SEVERITIES:
            raise ValueError(f"bad rule type or severity in {self.rule_id}")
        for tree in (self.condition, *(x.condition for x in self.exceptions)):
            if tree is not None and (depth(tree) > MAX_DEPTH or size(tree) > MAX_NODES):
                raise ValueError(f"the condition of {self.rule_id} is too large")


def leaves(node: Node | None) -> list[Leaf]:
    if node is None:
        return []
    return [node] if isinstance(node, Leaf) else [x for c in node.children for x in leaves(c)]


def depth(node: Node) -> int:
    return 1 if isinstance(node, Leaf) else 1 + max(map(depth, node.children))


def size(node: Node) -> int:
    return 1 if isinstance(node, Leaf) else 1 + sum(map(size, node.children))


def has_not(node: Node | None) -> bool:
    return isinstance(node, Group) and (node.logic == "NOT" or any(map(has_not, node.children)))


def render(node: Node) -> str:
    """The condition as infix text."""
    if isinstance(node, Leaf):
        parts = [f"{node.entity}.{node.path}", node.op, *([] if node.value is None else [repr(node.value)]), *([node.unit] if node.unit else [])]
        return " ".join(parts)
    if node.logic == "NOT":
        return f"NOT ({render(node.children[0])})"
    return "(" + f" {node.logic} ".join(map(render, node.children)) + ")"


@dataclass(frozen=True)
class Facts:
    """Where facts are: a column for each ``entity.path`` (names in lower case), with its unit where it has one.

    ``now`` is the evaluation date; there is no wall clock behind it. ``types``
    has the columns' types once the facts are bound to a table (``bind``): then
    numbers, dates and booleans are compared as they are, lists are searched
    item by item, and only text is parsed. A fact without a known type is read
    as text.
    """

    columns: dict[str, Column]
    units: dict[str, Column] = field(default_factory=dict)
    now: Column | None = None
    rates: dict[str, float] = field(default_factory=dict)
    strict_units: bool = False
    types: dict[str, T.DataType] = field(default_factory=dict)

    def bind(self, df: DataFrame) -> Facts:
        """These facts with the types that their columns have in ``df``."""
        schema = df.select(*[c.alias(f"c{i}") for i, c in enumerate(self.columns.values())]).schema
        return replace(self, types={n: f.dataType for n, f in zip(self.columns, schema)})

    def kind(self, entity: str, path: str) -> str:
        """number, moment, boolean, list or text."""
        found = self.types.get(f"{entity}.{path}".lower())
        kinds = {T.NumericType: "number", T.DateType: "moment", T.TimestampType: "moment", T.TimestampNTZType: "moment", T.BooleanType: "boolean", T.ArrayType: "list"}
        return next((k for t, k in kinds.items() if isinstance(found, t)), "text")

    def present(self, entity: str, path: str) -> Column:
        """Whether the fact is there and not blank; never NULL."""
        raw = self.of(entity, path)
        return S.present(raw) if self.kind(entity, path) == "text" else raw.isNotNull()

    def moment(self, entity: str, path: str) -> Column:
        raw, kind = self.of(entity, path), self.kind(entity, path)
        if kind == "text":
            return S.as_timestamp(raw)
        return raw.cast("timestamp_ntz") if kind == "moment" else F.lit(None).cast("timestamp_ntz")

    def plain_number(self, entity: str, path: str) -> Column:
        """The fact as a number, whatever its unit."""
        raw, kind = self.of(entity, path), self.kind(entity, path)
        if kind == "text":
            return S.as_number(raw)
        if kind != "number":
            return F.lit(None).cast("double")
        value = raw.cast("double")
        exact = isinstance(self.types[f"{entity}.{path}".lower()], (T.IntegralType, T.DecimalType))
        return value if exact else F.when(F.abs(value) < float("inf"), value)

    def of(self, entity: str, path: str) -> Column:
        found = self.columns.get(f"{entity}.{path}".lower())
        return F.lit(None).cast("string") if found is None else found

    def number(self, leaf: Leaf) -> Column:
        """The fact as a number in the rule's unit; NULL if it can't be."""
        name = f"{leaf.entity}.{leaf.path}".lower()
        raw, plain = self.of(leaf.entity, leaf.path), self.plain_number(leaf.entity, leaf.path)
        if name in self.units:
            value, unit = plain, S.unit_name(self.units[name])
        elif self.kind(leaf.entity, leaf.path) != "text":
            value, unit = plain, F.lit(None).cast("string")
        else:
            q = S.parse_quantity(raw)
            value, unit = F.coalesce(q["value"], plain), q["unit"]
        if not leaf.unit:
            return value
        wanted = S.unit_name(F.lit(leaf.unit))
        bare = F.lit(None).cast("double") if self.strict_units else value
        return F.when(unit.isNull(), bare).otherwise(S.convert(value, unit, wanted, self.rates))

    def without_unit(self, leaf: Leaf) -> Column:
        """Whether the fact is a number without a unit of its own; never NULL."""
        name = f"{leaf.entity}.{leaf.path}".lower()
        unit = F.lit(None).cast("string")
        if name in self.units:
            unit = S.unit_name(self.units[name])
        elif self.kind(leaf.entity, leaf.path) == "text":
            unit = S.parse_quantity(self.of(leaf.entity, leaf.path))["unit"]
        return F.coalesce(unit.isNull() & self.plain_number(leaf.entity, leaf.path).isNotNull(), F.lit(False))


def _close(a: Column, b: float) -> Column:
    return F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.lit(abs(float(b)))), F.lit(1e-9))


def _equal(leaf: Leaf, value: object, facts: Facts) -> Column:
    raw, kind = facts.of(leaf.entity, leaf.path), facts.kind(leaf.entity, leaf.path)
    there = facts.present(leaf.entity, leaf.path)
    if isinstance(value, bool):
        own = raw if kind == "boolean" else S.as_boolean(raw) if kind == "text" else F.lit(None).cast("boolean")
        return F.when(there, own == value)
    if _numeric(value):
        return F.when(there, _close(facts.number(leaf), value))
    same = S.normal_text(raw) == S.normal_text(F.lit(value))
    if is_date(value) and kind in ("text", "moment"):
        same = F.coalesce(facts.moment(leaf.entity, leaf.path) == _moment(value), same)
    elif _number(value) is not None and kind in ("text", "number"):
        same = F.coalesce(_close(facts.plain_number(leaf.entity, leaf.path), _number(value)), same)
    return F.when(there, same)


def _any(items: list[Column]) -> Column:
    """An item is true: true; all unknown: NULL; else false."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in items])
    unknown = reduce(lambda a, b: a & b, [x.isNull() for x in items])
    return F.when(hit, F.lit(True)).when(unknown, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def leaf_column(leaf: Leaf, facts: Facts) -> Column:
    """True, false or, for a missing or unreadable fact, NULL."""
    raw, op, v = facts.of(leaf.entity, leaf.path), leaf.op, leaf.value
    there = facts.present(leaf.entity, leaf.path)
    if op in ("exists", "not_exists"):
        return there if op == "exists" else ~there
    if op in ORDERING or op in ("between", "not_between"):
        first = v[0] if isinstance(v, (list, tuple)) else v
        if _numeric(first):
            x, ends = facts.number(leaf), [F.lit(float(e)) for e in (v if isinstance(v, (list, tuple)) else [v])]
        else:
            x, ends = facts.moment(leaf.entity, leaf.path), [_moment(e) for e in (v if isinstance(v, (list, tuple)) else [v])]
        if op in ORDERING:
            return {">": x > ends[0], ">=": x >= ends[0], "<": x < ends[0], "<=": x <= ends[0]}[op]
        inside = (x >= ends[0]) & (x <= ends[1]) if leaf.inclusive else (x > ends[0]) & (x < ends[1])
        return inside if op == "between" else ~inside
    if op in ("==", "!="):
        same = _equal(leaf, v, facts)
        return same if op == "==" else ~same
    if op in ("in", "not_in"):
        found = _any([_equal(leaf, x, facts) for x in v])
        return found if op == "in" else ~found
    kind = facts.kind(leaf.entity, leaf.path)
    if kind == "list":
        held = list_contains(raw, str(v))
    elif kind == "text":
        held = F.when(there, F.contains(S.normal_text(raw), S.normal_text(F.lit(str(v)))))
    else:
        held = F.lit(None).cast("boolean")
    return held if op == "contains" else ~held


def list_contains(items: Column, value: str) -> Column:
    """``contains`` of a list fact: any element equal as text; NULL for a NULL list."""
    return F.exists(F.filter(items, lambda x: x.isNotNull()), lambda x: S.normal_text(x) == S.normal_text(F.lit(value)))


def condition_column(node: Node, facts: Facts, leaf=None) -> Column:
    """A tree's column; ``leaf`` gives a leaf's, by default ``leaf_column``."""
    if isinstance(node, Leaf):
        return leaf(node) if leaf else leaf_column(node, facts)
    parts = [condition_column(c, facts, leaf) for c in node.children]
    if node.logic == "NOT":
        return ~parts[0]
    if node.logic == "IMPLIES":
        return (~parts[0]) | parts[1]
    return reduce(lambda a, b: (a & b) if node.logic == "AND" else (a | b), parts)


def reference_fact(t: Temporal) -> tuple[str, str] | None:
    """(entity, path) of a reference that is another fact."""
    if t.kind == "between" or t.reference.lower() in _NOW or is_date(t.reference):
        return None
    entity, _, path = t.reference.lower().partition(".")
    return entity, path


def temporal_column(t: Temporal, facts: Facts) -> Column:
    moment, other = facts.moment(t.entity, t.path), reference_fact(t)
    if t.kind == "between":
        return moment.between(_moment(t.start), _moment(t.end))
    if other is not None:
        reference = facts.moment(*other)
    elif t.reference.lower() not in _NOW:
        reference = _moment(t.reference)
    elif facts.now is None:
        raise ValueError("an evaluation date is needed")
    else:
        reference = facts.now
    if t.kind == "before":
        return moment < reference
    if t.kind == "after":
        return moment > reference
    back, on = S.shift(reference, t.amount, t.unit, -1), S.shift(reference, t.amount, t.unit, 1)
    if t.kind == "older_than":
        return moment < back
    return moment.between(*{"after": (reference, on), "before": (back, reference), "either": (back, on)}[t.direction])


def predicate_column(rule: Rule, facts: Facts) -> Column:
    """Condition and temporal constraint; true where a rule has neither."""
    parts = [condition_column(rule.condition, facts)] if rule.condition is not None else []
    parts += [temporal_column(rule.temporal, facts)] if rule.temporal is not None else []
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def absent_facts(nodes: Sequence[Node], temporal: Temporal | None, facts: Facts, present=None) -> list[Column]:
    """A column for each fact that the trees and the temporal constraint read: its name where it is absent, else NULL.

    A value that is there but unreadable is unknown, not absent. The fact that a
    temporal constraint refers to counts where its own date is readable.
    """
    there = present or (lambda e, p: facts.present(e, p))
    names = {(x.entity, x.path): None for n in nodes for x in leaves(n) if x.op not in ("exists", "not_exists")}
    gaps = [F.when(~there(e, p), F.lit(f"{e}.{p}")) for e, p in names]
    if temporal is not None:
        gaps.append(F.when(~there(temporal.entity, temporal.path), F.lit(f"{temporal.entity}.{temporal.path}")))
        if (other := reference_fact(temporal)) is not None:
            gaps.append(F.when(facts.moment(temporal.entity, temporal.path).isNotNull() & ~there(*other), F.lit(temporal.reference)))
    return gaps


def sorted_names(items: Sequence[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*items)))) if items else F.array().cast("array<string>")
