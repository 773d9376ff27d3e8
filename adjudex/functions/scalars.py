"""Typed readings of loosely typed values, as column expressions that give NULL instead of failing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, currencies and conversion factors.
UNIT_ALIASES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR", "rupees": "INR",
    "$": "USD", "usd": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP",
    "%": "percent", "percent": "percent", "pct": "percent",
    "second": "seconds", "sec": "seconds", "secs": "seconds", "minute": "minutes", "min": "minutes", "mins": "minutes",
    "hour": "hours", "hr": "hours", "hrs": "hours", "day": "days", "week": "weeks", "wk": "weeks",
    "month": "months", "year": "years", "yr": "years", "yrs": "years",
    "byte": "b", "bytes": "b", "kilobyte": "kb", "megabyte": "mb", "gigabyte": "gb", "terabyte": "tb",
    "gram": "g", "grams": "g", "kilogram": "kg", "kilograms": "kg", "lbs": "lb", "pound": "lb", "pounds": "lb",
    "meter": "m", "metre": "m", "meters": "m", "metres": "m", "kilometer": "km", "kilometre": "km", "kilometers": "km",
}
CURRENCIES = ("INR", "USD", "EUR", "GBP", "AED", "JPY", "CAD", "AUD", "SGD", "CNY", "CHF")
UNIT_FACTORS = {
    "time": {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0, "months": 2592000.0, "years": 31536000.0},
    "data": {"b": 1.0, "kb": 1024.0, "mb": 1024.0**2, "gb": 1024.0**3, "tb": 1024.0**4},
    "mass": {"mg": 1e-3, "g": 1.0, "kg": 1000.0, "lb": 453.59237, "oz": 28.349523},
    "length": {"mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1000.0},
}

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?$"
_ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)$"
# Formats of dates with a month's name.
_NAMED_DATES = ("d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy")


def _map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def as_number(value: Column) -> Column:
    """A finite number from text with optional thousands commas; not from ``nan``, ``inf`` or a type suffix."""
    text = F.replace(F.trim(value.cast("string")), F.lit(","), F.lit(""))
    read = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(F.abs(read) < float("inf"), read)


def as_timestamp(value: Column) -> Column:
    """TIMESTAMP_NTZ, in UTC where a zone is given, from ISO 8601 (extended, basic or week date) or a day with a month's name.

    A numeric day and month order is never guessed; a bare year or unpadded parts give NULL.
    """
    text = F.trim(value.cast("string"))
    local = F.when(text.rlike(_ISO), F.replace(F.when(F.length(text) == 13, F.concat(text, F.lit(":00"))).otherwise(text), F.lit(","), F.lit(".")).try_cast("timestamp_ntz"))
    zoned = F.when(text.rlike(_ISO_ZONED), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))
    basic = F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("timestamp_ntz"))
    year, week, day = (F.regexp_extract(text, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", i) for i in (1, 2, 3))
    first = F.concat(year, F.lit("-01-04")).try_cast("date")
    number = F.coalesce(day.try_cast("int"), F.lit(1))
    monday = F.date_sub(first, F.weekday(first))
    at = F.date_add(monday, (F.coalesce(week.try_cast("int"), F.lit(0)) - 1) * 7 + number - 1)
    by_week = F.when(text.rlike(r"^\d{4}-?W(0[1-9]|[1-4]\d|5[0-3])(-?[1-7])?$") & (F.weekofyear(at) == week.try_cast("int")), at.cast("timestamp_ntz"))
    spelled = F.regexp_replace(F.initcap(text), r"\s+", " ")
    named = F.coalesce(*[F.try_to_timestamp(F.when(spelled.rlike(r"^(\d{1,2} [A-Z][a-z]+ \d{4}|[A-Z][a-z]+ \d{1,2},? \d{4})$"), spelled), F.lit(f)).cast("timestamp_ntz") for f in _NAMED_DATES])
    return F.coalesce(local, utc, basic, by_week, named)


def is_date_text(value: Column) -> Column:
    return as_timestamp(value).isNotNull() & value.cast("string").rlike(r"\d{4}")


def normal_text(value: Column) -> Column:
    """Trimmed, white space collapsed, lower case, with ß as ss (as case folding has it)."""
    return F.replace(F.lower(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def snake_case(value: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), F.lit("_"))


def as_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin("true", "yes", "y"), F.lit(True)).when(word.isin("false", "no", "n"), F.lit(False))


def present(value: Column) -> Column:
    """Whether a value is there and not blank; never NULL."""
    return F.coalesce(value.cast("string").rlike(r"\S"), F.lit(False))


def unit_name(unit: Column) -> Column:
    """Aliases to their unit, currency codes to upper case; NULL for an empty name."""
    name = F.lower(F.trim(unit))
    code = F.upper(F.trim(unit))
    return F.when(F.length(name) > 0, F.coalesce(F.element_at(_map(UNIT_ALIASES), name), F.when(code.isin(*CURRENCIES), code), name))


def unit_dimension(unit: Column) -> Column:
    """currency, percent, time, data, mass, length or other, of a name that ``unit_name`` gave."""
    known = {u: d for d, units in UNIT_FACTORS.items() for u in units}
    return F.when(unit.isin(*CURRENCIES), "currency").when(unit == "percent", "percent").otherwise(F.coalesce(F.element_at(_map(known), unit), F.lit("other")))


def check_rates(rates: Mapping[str, float]) -> dict[str, float]:
    """Exchange rates keyed ``SRC->DST`` with alias names resolved; raises ValueError for a bad key or a rate that isn't positive."""
    out = {}
    for key, rate in rates.items():
        parts = [p.strip() for p in key.split("->")]
        if len(parts) != 2 or not all(parts) or not rate > 0:
            raise ValueError(f"bad exchange rate {key}: {rate}")
        src, dst = (UNIT_ALIASES.get(p.lower(), p.upper() if p.upper() in CURRENCIES else p.lower()) for p in parts)
        out[f"{src}->{dst}"] = float(rate)
    return out


def convert(value: Column, src: Column, dst: Column, rates: Mapping[str, float] | None = None) -> Column:
    """``value`` in another unit of the same dimension; currencies by a given rate or its inverse; NULL if there is none."""
    factors = _map({u: f for units in UNIT_FACTORS.values() for u, f in units.items()})
    kind = unit_dimension(src)
    linear = F.when((kind == unit_dimension(dst)) & kind.isin(*UNIT_FACTORS), value * F.element_at(factors, src) / F.element_at(factors, dst))
    money = F.lit(None).cast("double")
    if rates:
        table = _map(check_rates(rates))
        money = F.coalesce(value * F.element_at(table, F.concat(src, F.lit("->"), dst)), value / F.element_at(table, F.concat(dst, F.lit("->"), src)))
    return F.when(src == dst, value).when((kind == "currency") & (unit_dimension(dst) == "currency"), money).otherwise(linear)


# Fixed value: the pattern of an amount with its unit.
_QUANTITY = r"(?i)^\s*(₹|rs\.?|inr|\$|usd|€|eur|£|gbp)?\s*(-?[\d,]+(?:\.\d+)?)\s*(%|[A-Za-z]+\.?)?\s*$"


def quantity_parts(value: Column) -> Column:
    """struct(number, unit) of the texts that ``parse_quantity`` reads, for a projection before it; NULL for other text."""
    text = value.cast("string")
    named = F.coalesce(*[F.nullif(F.regexp_extract(text, _QUANTITY, i), F.lit("")) for i in (1, 3)])
    return F.when(text.rlike(_QUANTITY), F.struct(F.regexp_extract(text, _QUANTITY, 2).alias("number"), named.alias("unit")))


def parse_quantity(value: Column) -> Column:
    """struct(value, unit) of ``12``, ``$1,200`` or ``30 days``; NULL for other text."""
    text = value.cast("string")
    number = as_number(F.regexp_extract(text, _QUANTITY, 2))
    named = F.coalesce(*[F.nullif(F.regexp_extract(text, _QUANTITY, i), F.lit("")) for i in (1, 3)])
    return F.when(text.rlike(_QUANTITY) & number.isNotNull(), F.struct(number.alias("value"), unit_name(named).alias("unit")))


def shift_by(moment: Column, amount: Column, unit: Column, sign: int = 1) -> Column:
    """``shift`` where amount and unit (one of the time units) are columns too."""
    months = (F.when(unit == "years", 12).when(unit == "months", 1) * amount * sign).cast("int")
    seconds = F.element_at(_map(UNIT_FACTORS["time"]), unit) * amount * sign
    by_time = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(months.isNull(), seconds).cast("decimal(18,6)"))
    return F.coalesce(moment + F.make_ym_interval(F.lit(0), months), moment + by_time)


def shift(moment: Column, amount: float, unit: str, sign: int = 1) -> Column:
    """A calendar-aware shift; months and years keep the day or take the month's last."""
    if unit in ("months", "years"):
        return moment + F.make_ym_interval(F.lit(0), F.lit(sign * int(amount) * (12 if unit == "years" else 1)))
    seconds = sign * amount * UNIT_FACTORS["time"][unit]
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def kleene_all(value: Column) -> Column:
    """AND over the rows of a group: false if any is, else NULL if any is, else true."""
    return F.when(F.count_if(value == F.lit(False)) > 0, F.lit(False)).when(F.count(value) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(F.lit(True))


def kleene_any(value: Column) -> Column:
    return F.when(F.count_if(value) > 0, F.lit(True)).when(F.count(value) < F.count(F.lit(1)), F.lit(None).cast("boolean")).otherwise(F.lit(False))


def strip_html(html: Column, limit: int = 3000) -> Column:
    """Tags to spaces, then the first ``limit`` characters."""
    return F.substring(F.regexp_replace(html, "<[^>]+>", " "), 1, limit)


def html_of_markdown(text: Column) -> Column:
    """Escaped text with line breaks as ``<br>``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_object_in(text: Column) -> Column:
    """The variant of the outermost ``{...}`` (or ``[...]``, as ``{"rules": ...}``) in a model's answer, fences and reasoning removed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    whole = F.try_parse_json(F.trim(plain))
    braced = F.try_parse_json(F.regexp_extract(plain, r"(?s)(\{.*\})", 1))
    listed = F.try_parse_json(F.concat(F.lit('{"rules":'), F.regexp_extract(plain, r"(?s)(\[.*\])", 1), F.lit("}")))
    return F.when(F.substring(F.trim(plain), 1, 1) == "[", F.coalesce(listed, braced)).otherwise(F.coalesce(whole, braced))


def strip_reasoning(text: Column, intros: str = r"(?i)^(sure|certainly|of course|okay)[,!.: ]+") -> Column:
    """Reasoning blocks and opening phrases off, the first letter in upper case."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")), intros, "")
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, F.lit(2), F.length(plain)))


def phase_of_text(text: Column, turn: Column, turns: int = 15, overlap: int = 400) -> Column:
    """The third of a text that a conversation has come to, with some of what is before and after."""
    third = F.floor(F.length(text) / 3).cast("int")
    at = F.when(turn < turns / 3, F.lit(1)).when(turn < 2 * turns / 3, F.greatest(F.lit(1), third - overlap + 1)).otherwise(F.greatest(F.lit(1), 2 * third - overlap + 1))
    upto = F.when(turn < turns / 3, third + overlap).when(turn < 2 * turns / 3, 2 * third + overlap).otherwise(F.length(text))
    return F.substring(text, at, upto - at + 1)
