"""Chat formatting by schema fingerprints (DataFrame functions only).

Training chats come as prompt and completion, as instruction, input and output, as message lists or
as one row per turn. The nested field paths of a schema (or of each JSON record) are hashed; the
hash selects a declarative mapping into canonical turns (conv_id, turn, role, text). Turns are then
formatted by one template, with the loss mask as segments of the output, and can be read back.

Template, per turn: OPEN, role, newline, text, CLOSE. ``&``, ``<`` and ``[`` inside roles and texts
become entities, so that no control string of this or of the usual other templates can come out of
a text; replacing the entities in reverse order, the ampersand's last, gives the text again.

Defined results: a null role or text counts as empty; rows of one conversation that share a turn
number are ordered by role, then text; repeated rows are turns of their own; a null ``conv_id`` is a
conversation of its own; an empty table gives no conversations; columns that no mapping names are
ignored. A conversation is one output value and so has to fit into one task, as any row does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: In the order of escaping.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
NEWLINE = ("\n", "&#10;")
#: Names that other layouts give to the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Declarative mappings: the nested paths a layout has, and where its turns come from. "rows" has a
#: turn in each row; "list" names an array and its role and text fields; "fields" lists (role,
#: fields joined by a blank line), a turn whose fields are all null or empty being left out.
MAPPINGS: dict[str, dict] = {
    "turn_rows": {"paths": ["conv_id", "role", "text", "turn"], "rows": ("turn", "role", "text")},
    "messages": {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    "from_value": {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "instruction": {"paths": ["input", "instruction", "output"], "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction_only": {"paths": ["instruction", "output"], "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "system_prompt": {"paths": ["completion", "prompt", "system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "completion": {"paths": ["completion", "prompt"], "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "response": {"paths": ["prompt", "response"], "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "question": {"paths": ["answer", "question"], "fields": [("user", ["question"]), ("assistant", ["answer"])]},
}
KNOWN = sorted({p for m in MAPPINGS.values() for p in m["paths"]})
#: A record of any layout but turn rows.
ANY = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, system string, prompt string, completion string, response string, question string, answer string"


def paths(schema: T.StructType, before: str = "") -> list[str]:
    """Nested field paths of a schema; a step into an array is written []."""
    found: list[str] = []
    for f in schema.fields:
        kind, name = f.dataType, before + f.name
        while isinstance(kind, T.ArrayType):
            kind, name = kind.elementType, name + "[]"
        found += paths(kind, f"{name}.") if isinstance(kind, T.StructType) else [name]
    return found


def fingerprint(found: list[str]) -> str:
    """The hash of those paths that any mapping knows, whatever else a schema has."""
    return hashlib.sha256("\n".join(sorted({p for p in found if p in KNOWN})).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(m["paths"]): name for name, m in MAPPINGS.items()}


def layout(schema: T.StructType) -> str:
    """The mapping that a schema's fingerprint selects."""
    found = paths(schema)
    if name := BY_FINGERPRINT.get(fingerprint(found)):
        return name
    # Columns of other layouts beside a whole one, such as an id named conv_id: the longest layout that is all there.
    whole = sorted((len(m["paths"]), n) for n, m in MAPPINGS.items() if set(m["paths"]) <= set(found))
    if not whole or len(whole) > 1 and whole[-1][0] == whole[-2][0]:
        raise ValueError(f"no single mapping for the field paths {sorted(found)}")
    return whole[-1][1]


def _role(role: Column) -> Column:
    role = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = F.coalesce(role)
    for name, known in ROLES.items():
        out = F.when(role == name, known).otherwise(out)
    return out


def _turns(name: str, at: Callable[[str], Column]) -> Column:
    """The array of (role, text) that a mapping makes of one record; ``at`` finds a top-level field."""
    m = MAPPINGS[name]
    if "list" in m:
        field, role, text = m["list"]
        return F.transform(at(field), lambda x: F.struct(_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    some = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(at, fields)), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text")) for role, fields in m["fields"]]
    return F.filter(F.array(*some), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) from a table of any known layout."""
    name = layout(df.schema)
    if "rows" in MAPPINGS[name]:
        turn, role, text = (F.col(f"`{c}`") for c in MAPPINGS[name]["rows"])
        return df.select(F.col(id_col).alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    found = df.select(F.col(id_col).alias("conv_id"), F.posexplode(_turns(name, lambda c: F.col(f"`{c}`"))).alias("turn", "t"))
    return found.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def canonical_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, turn, role, text) from JSON records that may each have another layout.

    Each record's present paths are hashed by Spark, and the hash selects the mapping; a record of
    unknown layout, or text that is no JSON object, gives one turn of role ``unknown`` with the raw text.
    """

    def at(c: str) -> Column:
        return F.col(f"r.`{c}`")

    def there(path: str) -> Column:
        top, _, leaf = path.partition("[].")
        return F.exists(at(top), lambda x: x[leaf].isNotNull()) if leaf else at(top).isNotNull()

    present = [F.when(there(p), F.lit(p)) for p in KNOWN if p not in MAPPINGS["turn_rows"]["paths"]]
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("raw"), F.from_json(F.col(json_col), ANY).alias("r"))
    rows = rows.withColumn("mark", F.sha2(F.concat_ws("\n", *present), 256))
    turns = F.array(F.struct(F.lit("unknown").alias("role"), F.coalesce("raw", F.lit("")).alias("text")))
    for mark, name in BY_FINGERPRINT.items():
        if "rows" not in MAPPINGS[name]:
            turns = F.when(F.col("mark") == mark, _turns(name, at)).otherwise(turns)
    return rows.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments): the text of each conversation, and the same text in segments with their loss flag.

    A turn has three segments: its header, its escaped text, under the loss if the role is
    assistant, and its end.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    chats = turns.groupBy("conv_id").agg(ordered.alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of(t: Column) -> Column:
        header = F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit(NEWLINE[0]), F.lit(NEWLINE[1])), F.lit("\n"))
        return F.array(segment(header, F.lit(False)), segment(escape(t["text"]), t["role"] == "assistant"), segment(F.lit(CLOSE), F.lit(False)))

    chats = chats.select("conv_id", F.flatten(F.transform("turns", of)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): what the formatted text holds, and all text under the loss mask, unescaped."""
    pieces = F.split("formatted", f"\\Q{CLOSE}\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(rest, "\n", 1)
        name = F.replace(role, F.lit(NEWLINE[1]), F.lit(NEWLINE[0]))
        return F.struct(unescape(name).alias("role"), unescape(F.substr(rest, F.char_length(role) + 2)).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return chats.select("conv_id", F.transform(pieces, turn).alias("turns"), loss.alias("loss_text"))


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted`` and ``segments``."""
    parsed = parse_chats(chats.withColumn("conv_id", F.struct("conv_id", F.char_length("formatted").cast("long").alias("n"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id.conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("conv_id.n").alias("formatted_chars"),
    )
