"""Chat formatting by schema fingerprint, DataFrame functions only.

A record's layout is recognised by the SHA-256 of its nested field paths and
converted by a declarative mapping into canonical turns; turns become segments
of one template, with control strings escaped reversibly and a loss mask over
what the assistant says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping.

    ``paths`` are the nested field paths the layout consists of. Either
    ``turns`` names an array of records with ``role`` and ``text`` fields, or
    ``parts`` lists (role, path) in the order spoken; a row-per-turn layout has
    ``row`` = (turn, role, text) instead.
    """

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    row: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("rows", ("role", "text", "turn"), row=("turn", "role", "text")),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), turns="messages", role="role", text="content"),
    Layout("turns", ("turns", "turns[].role", "turns[].text"), turns="turns", role="role", text="text"),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Layout("prompt_response", ("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), parts=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), parts=(("user", "instruction\ninput"), ("assistant", "output"))),
)

#: Names under which layouts give the speakers.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Control strings of common chat templates and of the one below; escaped inside texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>")
_ESCAPED = "(?:" + "|".join(sorted({c[1:].replace("[", r"\[").replace("]", r"\]").replace("|", r"\|") for c in CONTROL})) + ")"


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _vocabulary(layouts: Iterable[Layout]) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The nested field paths of a schema, ``[]`` marking array elements."""
    found = []
    for f in schema.fields:
        path, kind = f"{prefix}{f.name}", f.dataType
        found.append(path)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            found += schema_paths(kind.elementType, f"{path}[].")
        elif isinstance(kind, T.StructType):
            found += schema_paths(kind, f"{path}.")
    return found


def _by_precedence(layouts: Iterable[Layout]) -> list[tuple[str, Layout]]:
    """(fingerprint, layout), those of more paths first, then as listed."""
    return [(fingerprint(x.paths), x) for x in sorted(layouts, key=lambda x: -len(x.paths))]


def _said(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role, F.lit("")).cast("string").alias("role"), F.coalesce(text, F.lit("")).cast("string").alias("text"))


def _canonical_role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(named, role), role)


def turns_of_frame(df: DataFrame, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of typed records.

    The fingerprint is that of the schema's field paths which some layout uses.
    If no layout has it, as further columns have names that layouts use too, the
    layout of most paths decides among those whose paths are all there (the
    first listed, if several have as many). Other columns do not matter. Raises
    ``ValueError`` if none fits. Null role or text counts as empty; a null list
    of turns gives no rows.
    """
    known = set(_vocabulary(layouts))
    found = {p for p in schema_paths(df.schema) if p in known and p != id_col}
    ordered = _by_precedence(layouts)
    exact = [x for mark, x in ordered if mark == fingerprint(found)]
    fitting = exact or [x for _, x in ordered if found.issuperset(x.paths)]
    if not fitting:
        raise ValueError(f"no layout has the fingerprint {fingerprint(found)} of {schema_paths(df.schema)}")
    layout = fitting[0]
    record_id = F.col(id_col).alias("conv_id")
    if layout.row:
        turn, role, text = (F.col(c) for c in layout.row)
        said = _said(role, text)
        return df.select(record_id, turn.cast("long").alias("turn"), said["role"].alias("role"), said["text"].alias("text"))
    if layout.turns:
        turns = F.transform(F.col(layout.turns), lambda x: _said(_canonical_role(x[layout.role].cast("string")), x[layout.text]))
    else:
        turns = F.array(*[_said(role, F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in path.split("\n")])) for role, path in layout.parts])
    return df.select(record_id, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def turns_of_json(df: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Canonical turns of JSON records of any mix of layouts, and the records that fit none.

    Each record's fingerprint is the hash of those known paths that it has (a
    path inside an array counts if any element has it). A record without a
    layout of its own is read by the layout of most paths whose paths it has,
    the first listed among equals. Row-per-turn layouts need typed columns and
    are not looked for. Text that is not JSON fits no layout.
    """
    layouts = tuple(x for x in layouts if not x.row)
    record = F.try_parse_json(F.col(json_col))

    def has(path: str) -> Column:
        outer, _, inner = path.partition("[].")
        if not inner:
            return F.try_variant_get(F.col("v"), f"$.{path}", "variant").isNotNull()
        items = F.try_variant_get(F.col("v"), f"$.{outer}", "array<variant>")
        return F.coalesce(F.exists(items, lambda x: F.try_variant_get(x, f"$.{inner}", "variant").isNotNull()), F.lit(False))

    paths = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in _vocabulary(layouts)]))
    marked = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json"), record.alias("v"))
    marked = marked.withColumn("paths", paths).withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))

    def at(path: str) -> Column:
        return F.try_variant_get(F.col("v"), f"$.{path}", "string")

    def listed(x: Layout) -> Column:
        items = F.try_variant_get(F.col("v"), f"$.{x.turns}", f"array<struct<`{x.role}`:string,`{x.text}`:string>>")
        return F.transform(items, lambda t: _said(_canonical_role(t[x.role]), t[x.text]))

    turns = F.lit(None).cast(TURN)
    ordered = _by_precedence(layouts)
    fits = [(F.col("fingerprint") == mark, x) for mark, x in ordered] + [(F.size(F.array_except(F.array(*map(F.lit, x.paths)), "paths")) == 0, x) for _, x in ordered]
    for fit, x in reversed(fits):
        if x.turns:
            own = listed(x)
        else:
            own = F.array(*[_said(role, F.concat_ws("\n", *[F.nullif(at(p), F.lit("")) for p in path.split("\n")])) for role, path in x.parts])
        turns = F.when(fit, own).otherwise(turns)
    mapped = marked.withColumn("turns", turns)
    fitting = mapped.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
    return fitting, mapped.filter("turns is null").select("conv_id", "json", "fingerprint")


def escape(text: Column) -> Column:
    """Double every backslash, then put one into every control string after its first character."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={_ESCAPED})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """One template segment for every turn: ``<|turn|>role<|text|>text<|end|>``.

    Adds ``segment`` and the loss mask ``loss_start`` (from 0) and ``loss_chars``
    in code points of the segment: the text of assistant turns; null and 0 for
    other turns. A conversation's string is its segments by turn, nothing
    between. No shuffle is needed, however long a conversation is.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit("<|turn|>"), role, F.lit("<|text|>"))
    spoken = F.col("role") == "assistant"
    return turns.withColumns(
        {
            "segment": F.concat(head, text, F.lit("<|end|>")),
            "loss_start": F.when(spoken, F.length(head)),
            "loss_chars": F.when(spoken, F.length(text)).otherwise(0),
        }
    )


def read_segments(segments: DataFrame) -> DataFrame:
    """Read ``role``, ``text`` and the unescaped text under the loss mask back from segments."""
    whole = r"(?s)^<\|turn\|>(.*?)<\|text\|>(.*)<\|end\|>$"
    return segments.select(
        "conv_id",
        "turn",
        unescape(F.regexp_extract("segment", whole, 1)).alias("role"),
        unescape(F.regexp_extract("segment", whole, 2)).alias("text"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.substring(F.col("segment"), F.col("loss_start") + 1, F.col("loss_chars")))).alias("loss"),
        F.length("segment").alias("chars"),
    )


def conversation_digests(segments: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its segments.

    Only here does a conversation come together, since a digest needs its whole
    string. Rows with equal turn numbers are ordered by role, then text.
    """
    back = read_segments(segments)
    item = F.struct("turn", "role", "text", "loss", "chars")
    all_turns = back.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    return all_turns.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
