"""Chat formatting by schema fingerprints.

A record is a JSON text or a struct of any known layout.  The fingerprint of a
record is a digest of its nested field paths without their types; it selects a
declarative mapping from that layout to canonical turns.  A template then writes the turns
into one string in which control strings that occur inside texts are escaped
reversibly, and records which spans count for the loss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this template and of common chat templates.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
#: First character, backslashes, rest.  No control string starts inside another, so matches never overlap.
_BODY = "|".join(sorted({c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROL}))
PATTERN = rf"([<\[])(\\*)({_BODY})"
ESCAPED = rf"([<\[])\\(\\*)({_BODY})"

#: Other names of the three roles, in layouts that have names of their own.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

_TURNS = "array<struct<role:string,text:string>>"

#: SQL that reads a field of a record as a type.
Read = Callable[[str, str], str]


@dataclass(frozen=True)
class Layout:
    """Records whose field paths select a mapping, and the mapping: SQL of the turns."""

    examples: list[dict]
    turns: Callable[[Read], str]
    renames: bool = True  # roles by other names are told by ``ROLES``


def _list(path: str, role: str, text: str) -> Callable[[Read], str]:
    kind = f"array<struct<{role}:string,{text}:string>>"
    return lambda read: f"transform({read(path, kind)}, m -> named_struct('role', m.{role}, 'text', m.{text}))"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


def _fields(*pairs: tuple[str, str]) -> Callable[[Read], str]:
    def turns(read: Read) -> str:
        parts = ", ".join(_turn(role, read(field, "string")) for role, field in pairs)
        return f"filter(array({parts}), m -> m.text is not null)"

    return turns


def _ask_with_input(read: Read) -> str:
    return _turn("user", f"concat_ws('\\n\\n', {read('instruction', 'string')}, nullif({read('input', 'string')}, ''))")


#: The declarative mappings.
LAYOUTS = {
    "messages": Layout([{"messages": [{"role": "", "content": ""}]}, {"id": 0, "messages": [{"role": "", "content": ""}]}], _list("messages", "role", "content")),
    "conversations": Layout([{"conversations": [{"from": "", "value": ""}]}, {"id": 0, "conversations": [{"from": "", "value": ""}]}], _list("conversations", "from", "value")),
    "turns": Layout([{"turns": [{"turn": 0, "role": "", "text": ""}]}, {"conv_id": 0, "turns": [{"turn": 0, "role": "", "text": ""}]}], _list("turns", "role", "text"), renames=False),
    "instruction": Layout([{"instruction": "", "output": ""}], _fields(("user", "instruction"), ("assistant", "output"))),
    "instruction_input": Layout([{"instruction": "", "input": "", "output": ""}], lambda read: f"array({_ask_with_input(read)}, {_turn('assistant', read('output', 'string'))})"),
    "instruction_system": Layout(
        [{"system": "", "instruction": "", "input": "", "output": ""}],
        lambda read: f"array({_turn('system', read('system', 'string'))}, {_ask_with_input(read)}, {_turn('assistant', read('output', 'string'))})",
    ),
    "prompt_completion": Layout([{"prompt": "", "completion": ""}], _fields(("user", "prompt"), ("assistant", "completion"))),
    "prompt_response": Layout([{"prompt": "", "response": ""}], _fields(("user", "prompt"), ("assistant", "response"))),
    "question_answer": Layout([{"question": "", "answer": ""}], _fields(("user", "question"), ("assistant", "answer"))),
}


def _paths(x: object) -> str:
    """Nested field paths of an example record or of a column type, as ``fingerprint`` sees those of a variant."""
    if isinstance(x, T.StructType):
        x = {f.name: f.dataType for f in x.fields}
    if isinstance(x, dict):
        return "OBJECT<" + ", ".join(f"{k}: {_paths(x[k])}" for k in sorted(x)) + ">"
    if isinstance(x, list | T.ArrayType):
        return f"ARRAY<{_paths(x[0] if isinstance(x, list) else x.elementType)}>"
    return "?"


def _digest(x: object) -> str:
    return hashlib.md5(_paths(x).encode()).hexdigest()


def fingerprint(variant: Column) -> Column:
    """Digest of the nested field paths of a variant; types and values play no part."""
    paths = F.regexp_replace(F.schema_of_variant(variant), r"\b(STRING|VOID|BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP(_NTZ)?|BINARY|VARIANT)\b", "?")
    return F.md5(paths)


def _clean(turns: str, renames: bool) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def of_turn(turn: Column) -> Column:
        role = F.coalesce(F.element_at(names, turn["role"]), turn["role"]) if renames else turn["role"]
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(turn["text"], F.lit("")).alias("text"))

    return F.transform(F.expr(turns).cast(_TURNS), of_turn)


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout string``, ``fingerprint string`` and ``turns array<struct<role,text>>``.

    ``record`` is a JSON text or a struct; a struct's fingerprint is that of
    its type, so all its rows have one layout and texts of any length stay as
    they are.  ``layout`` and ``turns`` are null where the record is null, is
    not JSON, is a JSON text of more than 16 MiB (which no variant holds) or has
    a layout that no mapping knows; such rows are kept.  Turns stand in the
    record's order; null roles and texts are empty; repeated rows stay.
    Columns of ``df`` with the added names are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("layout", "fingerprint", "turns")]
    kind = df.schema[record].dataType
    known = {_digest(x): name for name, layout in LAYOUTS.items() for x in layout.examples}
    none = F.lit(None).cast(_TURNS)
    if isinstance(kind, T.StructType):
        name = known.get(_digest(kind))
        turns = none
        if name:
            layout = LAYOUTS[name]
            mapped = layout.turns(lambda field, _: f"`{record}`.`{field}`")
            turns = F.when(F.col(f"`{record}`").isNotNull(), _clean(mapped, layout.renames))
        there = F.col(f"`{record}`").isNotNull()
        return df.select(*kept, F.when(there, F.lit(_digest(kind))).alias("fingerprint"), F.when(there, F.lit(name).cast("string")).alias("layout"), turns.alias("turns"))

    df = df.select(*kept, F.try_parse_json(F.col(f"`{record}`").cast("string")).alias("__v"))
    df = df.select("*", fingerprint(F.col("__v")).alias("fingerprint"))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    df = df.select("*", F.element_at(names, F.col("fingerprint")).alias("layout"))
    turns = none
    for name, layout in LAYOUTS.items():
        mapped = layout.turns(lambda field, as_type: f"variant_get(__v, '$.{field}', '{as_type}')")
        turns = F.when(F.col("layout") == name, _clean(mapped, layout.renames)).otherwise(turns)
    return df.select(*kept, "fingerprint", "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PATTERN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    r"""A role on one line: ``\s`` for a backslash and ``\n`` for a line feed, then as a text."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """Add ``formatted string`` and ``loss_spans array<struct<start,length>>``.

    A turn is written as ``<|turn|>role``, a line feed, the escaped text,
    ``<|end|>`` and a line feed.  Spans count code points from 0 and cover the
    escaped texts of ``loss_role``.  No turns give an empty string.
    """
    head = lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n"))
    parts = F.transform(F.col(turns), lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("formatted", "loss_spans")]
    df = df.select(*kept, parts.alias("__parts"))
    tail = F.lit(f"{END}\n")
    written = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], tail)), "")
    start = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,length:bigint>>))")

    def step(acc: Column, p: Column) -> Column:
        at, length = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        span = F.array(F.struct(at.alias("start"), length.alias("length")))
        return F.struct((at + length + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("__parts", start, step, lambda acc: acc["spans"])
    return df.select(*kept, F.coalesce(written, F.lit("")).alias("formatted"), F.coalesce(spans, F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns that ``format_turns`` wrote, read back from its string alone."""

    def of_part(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - len(END) - 2)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    parts = F.split(formatted, r"<\|turn\|>")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), of_part)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records_of_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and one ``record`` of layout ``turns`` per conversation from rows by turn.

    Rows of a conversation are ordered by turn, equal turns by role and text;
    null roles and texts are empty, a null key is a conversation too, and other
    columns are ignored.  A conversation is one row of the result, so its rows
    meet in one task.
    """
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    row = F.struct(F.col(f"`{turn}`").alias("turn"), cell(role).alias("role"), cell(text).alias("text"))
    grouped = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return grouped.select(key, F.struct("turns").alias("record"))
