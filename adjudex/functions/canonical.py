"""Canonical JSON of nested values as columns, and fingerprints of rows and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Escapes of JSON that have a letter.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(char: Column) -> Column:
    code = F.ascii(char)
    above = code - 0x10000
    pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(code > 0xFFFF, pair)
    for c, e in _SHORT.items():
        out = out.when(char == c, e)
    return out.when((code < 0x20) | (code > 0x7E), _unit(code)).otherwise(char)


def quoted(text: Column) -> Column:
    """A JSON string in ASCII; texts without anything to escape are not taken apart."""
    plain = ~text.rlike(r'[^\x20-\x7E]|["\\]')
    parts = F.transform(F.split(text, ""), _escaped)
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(parts, "")), F.lit('"'))


def _double(x: Column) -> Column:
    """The shortest text that reads back as the number, as Python writes it: an exponent below -4 or from 16 on."""
    text = x.cast("string")
    sign, rest = F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(text, F.lit("-"))
    exponent = F.split_part(rest, F.lit("E"), F.lit(2)).try_cast("int")
    digits = F.regexp_replace(F.replace(F.split_part(rest, F.lit("E"), F.lit(1)), F.lit("."), F.lit("")), "0+$", "")
    point = exponent + 1
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    whole = F.concat(F.rpad(digits, point, "0"), F.lit(".0"))
    mixed = F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    plain = F.when(point <= 0, small).when(F.length(digits) <= point, whole).otherwise(mixed)
    tail = F.concat(F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    head = F.when(F.length(digits) > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(digits)
    scaled = F.when((exponent < -4) | (exponent >= 16), F.concat(head, tail)).otherwise(plain)
    return F.when(text.contains("E"), F.concat(sign, scaled)).otherwise(text)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """``value`` of type ``kind`` as JSON: keys in order of their code points, no spaces, ASCII only; null is ``null``.

    Texts, numbers, booleans, arrays, structs and maps with keys of text come
    out as Python's ``json.dumps`` with sorted keys writes them. Decimals are
    numbers in plain digits; dates and timestamps texts as Spark casts them (in
    the session's time zone), binary is base64. Other types raise ``TypeError``.
    """
    if isinstance(kind, T.StringType):
        out = quoted(value)
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, T.DecimalType):
        out = F.to_json(F.struct(value.alias("x")))
        out = F.substring(out, F.lit(6), F.length(out) - 6)
    elif isinstance(kind, T.DoubleType | T.FloatType):
        out = _double(value.cast("double"))
    elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        out = quoted(value.cast("string"))
    elif isinstance(kind, T.BinaryType):
        out = quoted(F.base64(value))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        items = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(items, ","), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        items = [F.concat(quoted(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.when(value.isNull(), "null").otherwise(out)


def row_json(df: DataFrame, *columns: str) -> Column:
    """The canonical JSON object of the named columns of a row, of all if none is named."""
    names = columns or df.columns
    return canonical_json(F.struct(*names), df.select(F.struct(*names).alias("x")).schema["x"].dataType)


def fingerprint(df: DataFrame, *by: str) -> DataFrame:
    """(by, n_rows, fingerprint): a digest of the rows of a table, or of each group, in any order.

    Each row's canonical JSON is hashed with SHA-256; four 64-bit parts of it
    are added up, with map-side combine, and the sums and the number of rows
    hashed again. Repeated rows count, the order of rows and columns doesn't.
    """
    digest = F.sha2(row_json(df), 256)
    parts = {f"__{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)}
    hashed = df.select(*by, *[c.alias(n) for n, c in parts.items()])
    sums = [F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in parts]
    return hashed.groupBy(*by).agg(F.count("*").alias("n_rows"), *sums).select(*by, "n_rows", F.sha2(F.concat_ws(",", F.col("n_rows").cast("string"), *[F.col(n).cast("string") for n in parts]), 256).alias("fingerprint"))
