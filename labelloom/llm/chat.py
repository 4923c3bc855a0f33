"""Chat formatting: heterogeneous layouts into canonical turns, by schema fingerprint.

A record's layout is recognised by a hash of its nested field paths (those
that some layout knows; others are ignored). The hash selects a declarative
mapping, and the mapping gives canonical turns ``array<struct<role, text>>``.
Typed tables are fingerprinted by their schema, JSON lines row by row. All of
it is DataFrame expressions.

The template writes a turn as ``<turn ROLE>TEXT</turn>``. Inside roles and
texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes
``\\g``: no control string can appear in a text, and each backslash of the
output starts an escape, so reading back is exact. The loss mask is the list of
(start, length) of the assistant texts in the output, in code points.

Defined results: null texts and roles are empty; turns are in order of their
number (null first), ties by role, then text; repeated rows are repeated turns;
a record of unknown layout, or a null or unreadable one, has layout null and no
turns; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import query, table

TURNS = "array<struct<role:string,text:string>>"

# Layouts by name: the field paths that make them up, and how they become turns.
# rows: a row is a turn (key, order, role, text). list: an array of turns (path, role field, text field).
# fields: one record is one exchange, (role, field) in order; empty fields give no turn.
LAYOUTS: dict[str, dict] = {
    "rows": {"paths": ("conv_id", "turn", "role", "text"), "rows": ("conv_id", "turn", "role", "text")},
    "messages": {"paths": ("messages[].role", "messages[].content"), "list": ("messages", "role", "content")},
    "shares": {"paths": ("conversations[].from", "conversations[].value"), "list": ("conversations", "from", "value")},
    "turns": {"paths": ("turns[].role", "turns[].text"), "list": ("turns", "role", "text")},
    "instruction": {"paths": ("instruction", "output"), "fields": (("user", "instruction"), ("assistant", "output"))},
    "instruction_input": {"paths": ("instruction", "input", "output"),
                          "fields": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    "prompt_response": {"paths": ("prompt", "response"), "fields": (("user", "prompt"), ("assistant", "response"))},
    "prompt_completion": {"paths": ("prompt", "completion"), "fields": (("user", "prompt"), ("assistant", "completion"))},
    "system_prompt_response": {"paths": ("system", "prompt", "response"),
                               "fields": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
    "question_answer": {"paths": ("question", "answer"), "fields": (("user", "question"), ("assistant", "answer"))},
}
# Other names of the roles in published layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


def known_paths(layouts: dict[str, dict] = LAYOUTS) -> tuple[str, ...]:
    return tuple(sorted({p for layout in layouts.values() for p in layout["paths"]}))


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(layouts: dict[str, dict] = LAYOUTS) -> dict[str, str]:
    """Name of the layout by fingerprint; two layouts of the same paths are an error."""
    out: dict[str, str] = {}
    for name, layout in layouts.items():
        mark = fingerprint(layout["paths"])
        if mark in out:
            raise ValueError(f"layouts {out[mark]} and {name} have the same paths")
        out[mark] = name
    return out


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Nested field paths of a typed table; ``[]`` stands for the elements of an array."""
    out: list[str] = []
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out += schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return out


def _role(role: Column, names: dict[str, str]) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for other, canonical in names.items():
        out = F.when(out == other, canonical).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: dict, get, names: dict[str, str]) -> Column:
    """Canonical turns of one record; ``get`` reads a top-level field."""
    if "list" in layout:
        field, role, text = layout["list"]
        return F.coalesce(F.transform(get(field), lambda t: _turn(_role(t[role], names), t[text])), F.array().cast(TURNS))
    turns = F.array(*[F.when(F.coalesce(F.length(get(f)), F.lit(0)) > 0, _turn(F.lit(role), get(f))) for role, f in layout["fields"]])
    return F.filter(turns, lambda t: t.isNotNull())


def canonical_table(df: DataFrame, keep: tuple[str, ...] = (), *, layouts: dict[str, dict] = LAYOUTS,
                    role_names: dict[str, str] = {}) -> DataFrame:
    """``conv_id, turns`` of a table whose rows are turns, or ``keep`` columns, layout and turns of one whose rows are records."""
    paths = set(schema_paths(df.schema)) & set(known_paths(layouts))
    name = fingerprints(layouts).get(fingerprint(paths))
    if name is None:
        raise ValueError(f"no layout has the paths {sorted(paths)}")
    layout = layouts[name]
    if "rows" in layout:
        key, order, role, text = (F.col(f"`{c}`") for c in layout["rows"])
        turn = F.struct(order.alias("turn"), _role(role, role_names).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        grouped = df.groupBy(key.alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("found"))
        return grouped.select("conv_id", F.transform("found", lambda t: _turn(t["role"], t["text"])).alias("turns"))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.lit(name).alias("layout"),
                     _mapped(layout, lambda f: F.col(f"`{f}`"), role_names).alias("turns"))


def json_paths(record: Column) -> Column:
    """Field paths of a JSON object, down to the objects in its arrays; an empty array for no object."""
    fields = F.from_json(record, "map<string,string>")
    entries = F.coalesce(F.map_entries(fields), F.array().cast("array<struct<key:string,value:string>>"))

    def below(entry: Column) -> Column:
        items = F.from_json(entry["value"], "array<map<string,string>>")
        inner = F.array_distinct(F.flatten(F.transform(items, lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        listed = F.transform(inner, lambda k: F.concat(entry["key"], F.lit("[]."), k))
        is_list = F.ltrim(entry["value"]).startswith("[")
        return F.when(is_list & (F.size(inner) > 0), listed).otherwise(F.array(entry["key"]))

    return F.array_distinct(F.flatten(F.transform(entries, below)))


def canonical_json(df: DataFrame, record: str, keep: tuple[str, ...] = (), *, layouts: dict[str, dict] = LAYOUTS,
                   role_names: dict[str, str] = ROLE_NAMES) -> DataFrame:
    """``keep`` columns, ``layout`` and ``turns`` of JSON records that may differ in layout from row to row."""
    known = F.array(*map(F.lit, known_paths(layouts)))
    text = F.col(f"`{record}`").cast("string")
    marked = df.select(*[F.col(f"`{c}`") for c in keep], text.alias("_record"),
                       F.array_sort(F.array_intersect(json_paths(text), known)).alias("_paths"))
    mark = F.sha2(F.array_join("_paths", "\n"), 256)
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for print_, name in fingerprints(layouts).items():
        how = layouts[name]
        if "rows" in how:
            continue  # a JSON record is never a single turn
        if "list" in how:
            field, role, body = how["list"]
            shape = f"`{field}` array<struct<`{role}`:string,`{body}`:string>>"
        else:
            shape = ", ".join(f"`{f}` string" for _, f in how["fields"])
        # The record is parsed by the layout that its fingerprint selects, and by that alone.
        parsed = F.from_json(F.when(mark == print_, F.col("_record")), shape)
        turns = F.when(mark == print_, _mapped(how, lambda f, p=parsed: p[f], role_names)).otherwise(turns)
        layout = F.when(mark == print_, F.lit(name)).otherwise(layout)
    return marked.select(*[F.col(f"`{c}`") for c in keep], layout.alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Each backslash starts an escape, so the one for the backslash itself can go last."""
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_turns(df: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """All columns but ``turns``, with ``formatted`` and ``loss``, the (start, length) of what is learned from."""
    written = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == loss_role).alias("learn")))
    other = [F.col(f"`{c}`") for c in df.columns if c != turns]
    rows = df.select(*other, written.alias("_written"))
    formatted = F.array_join(F.transform("_written", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>"))), "")
    # One pass: the place reached, and the spans so far.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["head"])
        span = F.array(F.struct(begin.alias("start"), F.length(t["body"]).alias("length")))
        return F.struct((begin + F.length(t["body"]) + F.lit(len("</turn>"))).alias("at"),
                        F.when(t["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    loss = F.aggregate("_written", start, step, lambda s: s["spans"])
    return rows.select(*other, formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Canonical turns from the text of the template."""
    pieces = F.filter(F.split(formatted, "</turn>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ">", 1)
        return F.struct(unescape(F.substr(head, F.lit(len("<turn ") + 1))).alias("role"),
                        unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped, one span after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def format_digests(canonical: DataFrame) -> DataFrame:
    """What the contract asks of ``conv_id, turns``, read back from the formatted text."""
    rows = format_turns(canonical.select("conv_id", "turns"))
    back = rows.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                       read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_TRICKY = "\\### Assistant: </turn> ok"
_ESC = "replace(replace(replace({}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '>', chr(92) || 'g')"
OP9_SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(14 + length({_ESC.format('role')}) + length({_ESC.format('text')})) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id"""


@query("op9_chat_format", OP9_SQL)
def op9(spark, sf_dir):
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.to_json(F.struct(F.array(
        *[F.struct(F.lit(r).alias("role"), F.lit(_TRICKY).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"))
    added = canonical_json(one, "record", ("conv_id",)).select("conv_id", F.posexplode("turns").alias("turn", "said"))
    # As rows of turns, so that a stored conversation of the same id and the added one are one conversation.
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        added.select("conv_id", "turn", "said.role", "said.text"))
    return format_digests(canonical_table(rows))
