"""Chat formatting by schema fingerprints, with DataFrame functions only.

A layout is a set of nested field paths and a declarative mapping to canonical
turns.  The fingerprint of a layout is the SHA-256 of its sorted paths.  Data has
a layout if those of its own paths that the layout names have that fingerprint;
of several layouts the one with the most paths is taken.  The rule is the same
for a typed DataFrame, once, and for JSON text, row by row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: name: (paths beside the id, how turns arise).  ``turn rows``: a row is a turn.
#: ``list``: an array of (role field, text field).  ``fields``: one turn for each (role, fields joined by a blank line).
LAYOUTS: dict[str, tuple[tuple[str, ...], dict]] = {
    "turn_rows": (("role", "text", "turn"), {"turn rows": ("turn", "role", "text")}),
    "messages": (("messages", "messages.content", "messages.role"), {"list": ("messages", "role", "content")}),
    "exchanges": (("conversations", "conversations.from", "conversations.value"), {"list": ("conversations", "from", "value")}),
    "instruction": (("input", "instruction", "output"), {"fields": (("user", ("instruction", "input")), ("assistant", ("output",)))}),
    "instruction_only": (("instruction", "output"), {"fields": (("user", ("instruction",)), ("assistant", ("output",)))}),
    "prompt": (("prompt", "response"), {"fields": (("user", ("prompt",)), ("assistant", ("response",)))}),
    "system_prompt": (("prompt", "response", "system"), {"fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))}),
}
#: Role names that mean a canonical one, in list layouts.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: (fingerprint, paths, name, mapping) of the layouts, those with the most paths first.
MAPPINGS = sorted(((fingerprint(paths), paths, name, how) for name, (paths, how) in LAYOUTS.items()), key=lambda m: (-len(m[1]), m[0]))


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths; arrays are looked through."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix)
    if not isinstance(kind, T.StructType):
        return []
    out = []
    for f in kind.fields:
        name = f"{prefix}.{f.name}" if prefix else f.name
        out += [name, *field_paths(f.dataType, name)]
    return out


def mapping_of(schema: T.StructType) -> tuple[str, dict]:
    """(name, mapping) of the schema's layout; further fields do not matter."""
    have = field_paths(schema)
    for key, paths, name, how in MAPPINGS:
        if fingerprint(set(have) & set(paths)) == key:
            return name, how
    raise ValueError(f"no layout fits the fields {sorted(have)}")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    c = _text(c)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])[c], c)


def _turns(how: dict, field) -> Column:
    """array<struct<turn, role, text>> of a row in a layout with whole conversations."""
    if "list" in how:
        name, role, text = how["list"]
        return F.transform(field(name), lambda x, i: F.struct(i.cast("long").alias("turn"), _role(x[role]).alias("role"), _text(x[text]).alias("text")))
    out = []
    for i, (role, names) in enumerate(how["fields"]):
        parts = F.filter(F.array(*[_text(field(n)) for n in names]), lambda x: x != "")
        out.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    return F.array(*out)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a DataFrame in any known layout; null roles and texts are empty."""
    _, how = mapping_of(df.schema)
    if "turn rows" in how:
        turn, role, text = how["turn rows"]
        return df.select(F.col(id_col).alias("conv_id"), F.col(turn).cast("long").alias("turn"), _text(F.col(role)).alias("role"), _text(F.col(text)).alias("text"))
    return df.select(F.col(id_col).alias("conv_id"), F.inline(_turns(how, F.col)))


def _among(paths):
    return lambda p: p.isin(*paths)


def canonical_from_json(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """As ``canonical_turns`` for JSON objects of mixed layouts, told apart row by row.

    The paths of a row are its keys and, for arrays of objects, the keys of all
    elements together; an empty array counts as one whose elements have every
    key, and has no turns.  An element without the role or the text has an empty
    one.  Rows of no known layout (null, broken or other JSON) give one turn with
    a null role and their text, so nothing is lost.
    """
    lists = sorted({how["list"][0] for _, _, _, how in MAPPINGS if "list" in how})
    top = F.from_json(F.col(json_col), "map<string,string>")
    df = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("_json"), top.alias("_top"), *[F.from_json(top[n], "array<map<string,string>>").alias(f"_l_{n}") for n in lists])
    no_keys = F.array().cast("array<string>")

    def below(name):
        every = [p for _, paths, _, _ in MAPPINGS for p in paths if p.startswith(f"{name}.")]
        found = F.array_distinct(F.flatten(F.transform(F.filter(F.col(f"_l_{name}"), lambda x: x.isNotNull()), lambda x: F.map_keys(x))))
        found = F.transform(found, lambda k: F.concat(F.lit(f"{name}."), k))
        return F.when(F.size(f"_l_{name}") == 0, F.array(*[F.lit(p) for p in every])).otherwise(F.coalesce(found, no_keys))

    df = df.withColumn("_paths", F.array_sort(F.array_distinct(F.concat(F.coalesce(F.map_keys("_top"), no_keys), *[below(n) for n in lists]))))
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for key, paths, _, how in reversed(MAPPINGS):
        if "turn rows" in how:
            one = F.struct(F.col("_top")["turn"].cast("long").alias("turn"), _text(F.col("_top")["role"]).alias("role"), _text(F.col("_top")["text"]).alias("text"))
            made = F.array(one)
        else:
            made = _turns(how, lambda n: F.col(f"_l_{n}") if n in lists else F.col("_top")[n])
        own = F.sha2(F.array_join(F.filter("_paths", _among(paths)), "\n"), 256)
        turns = F.when(own == key, made).otherwise(turns)
    rest = F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("_json").alias("text")))
    return df.select("conv_id", F.inline(F.coalesce(turns, rest)))


def escaped(c: Column) -> Column:
    """Backslashes doubled and ``<|`` broken up, so no control string can occur; ``unescaped`` undoes it."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask.

    ``turns`` is canonical.  Turns follow ``turn``, ties (and repeated rows)
    follow role and text; null turns come first; all rows with a null conv_id
    are one conversation.  ``loss_mask`` has a struct (before, take, after) of
    code points for each turn: under the mask are the ``take`` ones.  An empty
    table gives no rows.
    """
    role, text = escaped(_text(F.col("role"))), escaped(_text(F.col("text")))
    head = F.concat(F.lit(START), role, F.lit(SEP))
    tail = F.lit(END + "\n")
    size = F.when(F.col("role") == loss_role, F.length(text)).otherwise(0)
    piece = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.concat(head, text, tail).alias("piece"), F.struct(F.length(head).alias("before"), size.alias("take"), (F.length(text) - size + len(END) + 1).alias("after")).alias("mask"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    return rows.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.mask").alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>> and loss_texts array<string>, read from ``formatted`` and ``loss_mask``."""
    parts = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(parts, F.lit(2), F.size(parts))

    def turn(p):
        body = F.substring_index(p, END, 1)
        return F.struct(unescaped(F.substring_index(body, SEP, 1)).alias("role"), unescaped(F.substr(body, F.length(F.substring_index(body, SEP, 1)) + len(SEP) + 1)).alias("text"))
    masked = F.filter(F.zip_with(pieces, F.col("loss_mask"), lambda p, m: F.when(m["take"] > 0, unescaped(F.substring(p, m["before"] - len(START) + 1, m["take"])))), lambda x: x.isNotNull())
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"))
