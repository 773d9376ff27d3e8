"""Checks on policy text: numbers stated, vague wording, cues and severity labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_number

# Words for numbers, multipliers and minutes of a unit.
NUMBER_WORDS = {
    "one": 1.0, "two": 2.0, "three": 3.0, "four": 4.0, "five": 5.0, "six": 6.0, "seven": 7.0, "eight": 8.0, "nine": 9.0, "ten": 10.0,
    "eleven": 11.0, "twelve": 12.0, "fifteen": 15.0, "twenty": 20.0, "thirty": 30.0, "forty": 40.0, "fifty": 50.0, "sixty": 60.0,
    "ninety": 90.0, "hundred": 100.0, "thousand": 1000.0,
}
MULTIPLIERS = {
    "%": 0.01, "k": 1e3, "thousand": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7,
    "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9,
}
UNIT_MINUTES = {"minute": 1.0, "hour": 60.0, "day": 1440.0, "week": 10080.0}
# Patterns of wording.
NUMBER = r"(?i)(?<![\w.])(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%|k\b|thousand|lakhs?|lacs?|crores?|million|mn|billion|bn)?"
SPAN = r"(?i)\b(\d+(?:\.\d+)?|a|an|one)\s*-?\s*(minute|hour|day|week|month|year)s?\b"
VAGUE = (
    r"(?i)\b(large|small|big|significant(?:ly)?|substantial(?:ly)?|reasonabl[ey]|appropriate(?:ly)?|excessive(?:ly)?|adequate(?:ly)?|sufficient(?:ly)?|"
    r"material(?:ly)?|prompt(?:ly)?|timely|soon|as soon as possible|asap|frequent(?:ly)?|high|low|unusual|suspicious|as needed|where possible|"
    r"if (?:necessary|possible)|etc\.?|at (?:its|their|the manager'?s?) discretion|generally|normally|typically|usually|approximately|"
    r"around|some|several|many|few|acceptable|proper(?:ly)?|good|bad)\b"
)
ADVISORY = r"(?i)\b(should|might|ideally|encouraged|recommended|advisable|preferably|may(?!\s+not))\b"
ORDER_PHRASES = r"(?i)\b(?:no|not)\s+(?:later|more|less|earlier|fewer|greater|longer|shorter|higher|lower)\s+than\b|\bnot\s+(?:to\s+)?exceed(?:ing)?\b|\bno\s+(?:more|less)\b"
NEGATION = r"(?i)\b(not|no|never|cannot|can't|without|prohibit(?:ed|s)?|forbid(?:den|s)?|neither|nor|disallow(?:ed|s)?|banned?)\b"
EXCEPTION = r"(?i)\b(unless|except(?:ion)?s?|other than|excluding|exempt(?:ed|s|ion)?|save for|apart from)\b"
TIME_LIMIT = (
    r"(?i)\b(within\s+(?:the\s+)?(?:\d+|a|an|one|two|three|four|five|six|seven|ten|fifteen|thirty|sixty|ninety)\s*-?\s*(?:minute|hour|day|week|month|year)s?|"
    r"older than|no later than|not later than|later than|before\s+\d|after\s+\d|last\s+\d+\s*(?:minute|hour|day|week|month|year)s?|"
    r"(?:minute|hour|day|week|month|year)s?\s+(?:of|from|after|before|since)\b)"
)
RANGE = r"(?i)\bbetween\b[^.;]{0,60}?\band\b|\bfrom\b[^.;]{0,40}?\bto\b[^.;]{0,40}?\d"
LEVEL = r"(low|medium|high|critical)"
SEVERITY_LABELS = (
    rf"(?i)\b{LEVEL}[\s-]+(?:severity|priority)\b",
    rf"(?i)\b(?:severity|priority)(?:\s+level)?(?:\s+(?:is|as)\s+|\s*[=:]\s*){LEVEL}\b",
    rf"(?i)\b(?:classified|rated|marked|labell?ed|categori[sz]ed|designated)\s+as\s+(?:an?\s+)?{LEVEL}\b",
)
SEVERITY_WORDS = {"critical": ("critical",), "minor": ("low",), "moderate": ("medium",), "major": ("high", "critical"), "severe": ("high", "critical"), "serious": ("high", "critical")}


def _lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def sentences(text: Column) -> Column:
    parts = F.split(text, r"(?<=[.;!?])\s+|\n+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def numbers_in(text: Column) -> Column:
    """All numbers that a text states, as an array of doubles.

    Digits as they are and with their multiplier (a percentage also as a part
    of 1), number words, and spans of time in every exact unit.
    """
    text = F.coalesce(text, F.lit(""))
    digits, suffixes = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2))
    plain = F.transform(digits, lambda d: as_number(d))
    multiplied = F.zip_with(plain, suffixes, lambda n, s: n * F.element_at(_lookup(MULTIPLIERS), F.lower(s)))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.element_at(_lookup(NUMBER_WORDS), w))
    amounts = F.transform(F.regexp_extract_all(text, F.lit(SPAN), F.lit(1)), lambda a: F.when(F.lower(a).isin("a", "an", "one"), F.lit(1.0)).otherwise(a.try_cast("double")))
    minutes = F.zip_with(amounts, F.regexp_extract_all(text, F.lit(SPAN), F.lit(2)), lambda a, u: a * F.element_at(_lookup(UNIT_MINUTES), F.lower(u)))
    spans = F.flatten(F.transform(minutes, lambda m: F.array(*[m / f for f in UNIT_MINUTES.values()])))
    return F.array_compact(F.concat(plain, multiplied, words, amounts, spans))


def states_number(text: Column) -> Column:
    return text.rlike(r"(?i)\d|\b(" + "|".join(NUMBER_WORDS) + r")\b")


def grounded(value: Column, pool: Column) -> Column:
    """Whether a number is one of the pool, up to a relative or absolute difference of 1e-9."""
    return F.exists(pool, lambda p: F.abs(p - value) <= F.greatest(1e-9 * F.greatest(F.abs(p), F.abs(value)), F.lit(1e-9)))


def quoted(clause: Column, policy: Column) -> Column:
    """Whether a clause is in the policy, white space and case aside; false for a blank one."""

    def plain(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))

    return (plain(clause) != "") & F.contains(plain(policy), plain(clause))


def mask_severity(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), SEVERITY_LABELS, text)


def ambiguity(sentence: Column) -> Column:
    """The first vague or else advisory word of a sentence that states no number; NULL if there is none."""
    plain = mask_severity(sentence)
    found = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in (VAGUE, ADVISORY)])
    return F.when(~states_number(sentence), found)


def crosschecks(clause: Column, *, negated: Column, excepted: Column, timed: Column, ranged: Column) -> Column:
    """What a clause says and its rule lacks, or the other way round: names of findings."""
    without_order = F.regexp_replace(clause, ORDER_PHRASES, " ")
    return F.array_compact(
        F.array(
            F.when(without_order.rlike(NEGATION) & ~negated, F.lit("negation_dropped")),
            F.when(clause.rlike(EXCEPTION) & ~excepted, F.lit("exception_dropped")),
            F.when(clause.rlike(TIME_LIMIT) & ~timed, F.lit("time_limit_dropped")),
            F.when(clause.rlike(RANGE) & ~ranged, F.lit("range_dropped")),
            F.when(excepted & ~clause.rlike(EXCEPTION), F.lit("exception_invented")),
        )
    )


def severity_grounding(returned: Column, clause: Column, policy: Column) -> Column:
    """policy_stated, ambiguous, schema_default (the returned level is dropped) or invalid.

    Only a clause quoted from the policy is trusted.
    """
    text = F.when(quoted(clause, policy), clause).otherwise("")
    stated = F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: F.lower(x)) for p in SEVERITY_LABELS])))
    hinted = [F.when(F.lower(text).rlike(rf"\b{w}\b") & returned.isin(*levels), F.lit(True)) for w, levels in SEVERITY_WORDS.items()]
    plausible = F.coalesce(*hinted, F.lit(False))
    return (
        F.when(returned.isNull(), "schema_default")
        .when(~returned.isin("low", "medium", "high", "critical"), "invalid")
        .when(F.size(stated) > 1, "ambiguous")
        .when(F.size(stated) == 1, F.when(F.array_contains(stated, returned), "policy_stated").otherwise("schema_default"))
        .when(plausible, "ambiguous")
        .otherwise("schema_default")
    )


def compile_status(issues: Sequence[Column], ambiguities: Column, confidence: Column, minimum: float = 0.7, cap: float = 0.49) -> Column:
    """struct(status, confidence): REJECTED without a valid structure, NEEDS_REVIEW with findings (confidence capped) or low confidence, else VALID."""
    found = F.size(F.array_compact(F.array(*issues))) + F.size(ambiguities)
    level = F.when(found > 0, F.least(confidence, F.lit(cap))).otherwise(confidence)
    return F.struct(F.when(confidence.isNull(), "REJECTED").when((found > 0) | (level < minimum), "NEEDS_REVIEW").otherwise("VALID").alias("status"), level.alias("confidence"))
