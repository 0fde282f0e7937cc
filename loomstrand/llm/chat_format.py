"""Chat formatting: layouts told by a hash of their field paths, mapped to turns.

A layout is a set of nested field paths (``messages[].role``). Its fingerprint
is a hash of the sorted paths. A frame's fingerprint comes from its schema, a
JSON record's from its own fields, so records of many layouts can share a
table. The fingerprint picks a declarative mapping, which is compiled into
column functions; fields that no mapping knows are left alone.

The template puts ``<|im_start|>role``, a line end, the text and
``<|im_end|>`` around each turn. Control strings inside roles and texts are
escaped: the backslash becomes ``\\e``, the first character of a control
string ``\\l`` (<) or ``\\b`` ([), and in roles the line end ``\\w``. Escaped
text has a backslash only before one of these letters, so it reads back
unchanged. The loss mask is a list of code point ranges, one for each
assistant text.

Defined results: null roles and texts are empty; turns stay in their given
order; a JSON record of an unknown layout, or that is not JSON, has null turns
and null output; a conversation without turns gives an empty string.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters that begin a control string there: of this template and of the other common ones.
ANGLE = r"<(?=\||/?s>|/?SYS>>)"
SQUARE = r"\[(?=/?INST\])"

#: Layouts. A part is (role, path) for a text, or (role field, array path, text field) for a list of turns.
LAYOUTS: dict[str, tuple] = {
    "messages": (("role", "messages", "content"),),
    "messages_text": (("role", "messages", "text"),),
    "sharegpt": (("from", "conversations", "value"),),
    "system_messages": (("system", "system"), ("role", "messages", "content")),
    "prompt_completion": (("user", "prompt"), ("assistant", "completion")),
    "prompt_response": (("user", "prompt"), ("assistant", "response")),
    "system_prompt_response": (("system", "system"), ("user", "prompt"), ("assistant", "response")),
    "instruction_output": (("user", "instruction"), ("assistant", "output")),
    "instruction_input_output": (("user", "instruction", "input"), ("assistant", "output")),
    "question_answer": (("user", "question"), ("assistant", "answer")),
    "nested_prompt": (("user", "data.prompt"), ("assistant", "data.response")),
}
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant"}
#: Layouts whose role names are translated.
TRANSLATED = {"sharegpt"}
#: Layouts that append their second text to the first, after a blank line, where it isn't empty.
APPENDED = {"instruction_input_output"}


def _parts(name: str) -> list[tuple]:
    """("text", role, paths) or ("list", role field, path, text field)."""
    out = []
    for part in LAYOUTS[name]:
        if len(part) == 3 and name not in APPENDED:
            out.append(("list", *part))
        else:
            out.append(("text", part[0], part[1:]))
    return out


def paths_of_layout(name: str) -> list[str]:
    paths = []
    for part in _parts(name):
        paths += [f"{part[2]}[].{part[1]}", f"{part[2]}[].{part[3]}"] if part[0] == "list" else list(part[2])
    return sorted(paths)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {fingerprint(paths_of_layout(n)): n for n in LAYOUTS}
#: First fields of all layouts; other fields don't count.
KNOWN = sorted({p.split(".")[0].split("[")[0] for n in LAYOUTS for p in paths_of_layout(n)})


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(schema: T.StructType) -> str | None:
    """The layout of a frame, by its fingerprint over known fields."""
    paths = [p for p in schema_paths(schema) if p.split(".")[0].split("[")[0] in KNOWN]
    return FINGERPRINTS.get(fingerprint(paths))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _translated(name: str, role: Column) -> Column:
    if name not in TRANSLATED:
        return role
    return F.coalesce(_looked_up(role), role)


def _looked_up(role: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, to in ROLES.items():
        out = F.when(role == name, F.lit(to)).otherwise(out)
    return out


def _mapped(name: str, text_at, list_at) -> Column:
    """The turns of layout ``name``; text_at(path) and list_at(path, role, text) read the record."""
    arrays = []
    for part in _parts(name):
        if part[0] == "list":
            items = F.coalesce(list_at(part[2], part[1], part[3]), F.array().cast("array<struct<role:string,text:string>>"))
            arrays.append(F.transform(items, lambda m: _turn(_translated(name, m["role"]), m["text"])))
        else:
            first, *more = [text_at(p) for p in part[2]]
            for extra in more:
                first = F.concat(F.coalesce(first, F.lit("")), F.when(F.coalesce(extra, F.lit("")) != "", F.concat(F.lit("\n\n"), extra)).otherwise(F.lit("")))
            turn = F.array(_turn(F.lit(part[1]), first))
            arrays.append(F.when(F.coalesce(first, F.lit("")) != "", turn).otherwise(F.slice(turn, 1, 0)) if part[1] == "system" else turn)
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def turns_of_frame(df: DataFrame) -> Column:
    """Canonical turns of a frame whose schema has a known layout."""
    name = layout_of(df.schema)
    if name is None:
        raise ValueError(f"no layout for the fields {sorted(schema_paths(df.schema))}")
    return _mapped(name, lambda p: F.col(p).cast("string"), lambda p, r, t: F.transform(p, lambda m: F.struct(m[r].cast("string").alias("role"), m[t].cast("string").alias("text"))))


def _holds(leaf: str):
    return lambda m: F.try_variant_get(m, f"$.{leaf}", "variant").isNotNull()


def _json_paths(variant: Column) -> Column:
    """Sorted field paths of a JSON record over the known fields, one a line."""
    paths = []
    for name in sorted(p for layout in LAYOUTS for p in paths_of_layout(layout)):
        head, _, leaf = name.partition("[].")
        if leaf:
            # of all elements: a list of mixed layouts has the fingerprint of none
            items = F.try_variant_get(variant, f"$.{head}", "array<variant>")
            found = F.exists(items, _holds(leaf))
        else:
            here = F.try_variant_get(variant, f"$.{head}", "variant")
            # a list or an object there is another layout
            found = F.when(~F.schema_of_variant(here).rlike("^(ARRAY|OBJECT)"), here).isNotNull()
        paths.append(F.when(found, F.lit(name)))
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*paths)))), "\n")


def turns_of_json(record: Column) -> Column:
    """Canonical turns of JSON records of any of the layouts, by the fingerprint of each."""
    variant = F.try_parse_json(record)
    print_ = F.sha2(_json_paths(variant), 256)
    out = F.lit(None).cast("array<struct<role:string,text:string>>")

    def list_at(path: str, role: str, text: str) -> Column:
        items = F.try_variant_get(variant, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))

    for found, name in FINGERPRINTS.items():
        out = F.when(print_ == found, _mapped(name, lambda p: F.try_variant_get(variant, f"$.{p}", "string"), list_at)).otherwise(out)
    return out


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\e")), ANGLE, r"\\l"), SQUARE, r"\\b")


def unescaped(text: Column) -> Column:
    for mark, char in (("\\w", "\n"), ("\\l", "<"), ("\\b", "["), ("\\e", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escaped(turn["role"]), F.lit("\n"), F.lit("\\w")), F.lit("\n"))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with ``formatted`` and ``loss_spans`` (array of first and last code point, the last exclusive)."""
    parts = F.transform(turns, lambda t: F.struct(_head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("trained")))
    df = df.withColumn("_parts", parts)
    df = df.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    steps = F.transform("_parts", lambda p: F.struct(F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body"), p["trained"].alias("trained")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        first = state["at"] + p["head"]
        span = F.array(F.struct(first.alias("first"), (first + p["body"]).alias("last")))
        return F.struct((first + p["body"] + len(END)).alias("at"), F.when(p["trained"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return df.withColumn("loss_spans", F.aggregate(steps, start, step)["spans"]).drop("_parts")


def read_back(formatted_: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted_, START.replace("|", r"\|")), lambda p, i: i > 0)
    turn = lambda p: F.struct(unescaped(F.substring_index(p, "\n", 1)).alias("role"), unescaped(F.substring(p, F.instr(p, "\n") + 1, F.char_length(p) - F.instr(p, "\n") - len(END))).alias("text"))
    return F.transform(pieces, turn)


def masked(formatted_: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted_, s["first"] + 1, s["last"] - s["first"]))), "")


def conversations_of_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as (conv_id, messages), in order of the
    turn; equal turn numbers by role and text, null turn numbers last."""
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all")).select("conv_id", F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def report(conversations: DataFrame) -> DataFrame:
    """What is read back of each formatted conversation."""
    frame = conversations_of_rows(conversations)
    out = formatted(frame.select("conv_id", turns_of_frame(frame).alias("turns")))
    back = out.select("conv_id", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
