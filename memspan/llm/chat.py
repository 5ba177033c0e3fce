"""Chat formatting: heterogeneous conversation layouts into one reversible template.

Layouts are chosen by *schema fingerprint*: the SHA-256 of the sorted nested field paths of
a frame (or of each JSON row) that any registered layout knows. A fingerprint selects one
declarative mapping from paths to canonical turns ``(conv_id, pos, role, text)``. Everything
runs as DataFrame expressions; there is no Python on the executors.

Defined cases
* null text or null role: the empty string; null position: before all others;
* ties in position: ordered by role, then text; repeated rows are repeated turns;
* extra columns: ignored; if they bring in paths of another layout so that no fingerprint
  matches exactly, the registered layout with the most paths among those present wins
  (first registered on a tie);
* a frame that no layout fits: ``ValueError``; JSON rows that no layout fits give no turns and are
  returned by :func:`rows_without_layout`;
* an empty frame gives an empty result; a conversation without turns gives no row;
* very long texts are escaped and read back whole.
A conversation is one output row, so its text must fit a Spark string; conversations are
never gathered with one another.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURN_START, TURN_SEP, TURN_END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that mark structure in this template or in other common ones; never left intact inside a text.
CONTROL = (TURN_START, TURN_SEP, TURN_END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_CONTROL_HEAD = "(" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + ")"

TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """``paths`` this layout is recognised by; ``turns`` is a SQL expression over them for an
    array of (role, text), or None where each row is one turn with columns turn, role, text."""

    name: str
    paths: tuple[str, ...]
    turns: str | None


def _pair(first: str, second: str) -> str:
    return f"array(named_struct('role','user','text',string({first})), named_struct('role','assistant','text',string({second})))"


def _listed(column: str, role: str, text: str) -> str:
    said_by = f"string(m.`{role}`)"
    if role == "from":
        said_by = f"CASE lower({said_by}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {said_by} END"
    return f"transform({column}, m -> named_struct('role',{said_by},'text',string(m.`{text}`)))"


_INSTRUCT = "concat(string(instruction), if(coalesce(string(input),'') = '', '', concat('\\n\\n', string(input))))"

LAYOUTS = (
    Layout("rows", ("conv_id", "turn", "role", "text"), None),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Layout("shared", ("conv_id", "conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Layout("instruction", ("conv_id", "instruction", "input", "output"), _pair(_INSTRUCT, "output")),
    Layout("instruction_only", ("conv_id", "instruction", "output"), _pair("instruction", "output")),
    Layout("prompt_response", ("conv_id", "prompt", "response"), _pair("prompt", "response")),
    Layout("prompt_completion", ("conv_id", "prompt", "completion"), _pair("prompt", "completion")),
    Layout("question_answer", ("conv_id", "question", "answer"), _pair("question", "answer")),
)
KNOWN_PATHS = frozenset(p for layout in LAYOUTS for p in layout.paths)


def field_paths(kind: DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema: ``a``, ``a.b`` and ``a[].b``."""
    if isinstance(kind, StructType):
        return {p for f in kind for p in (field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name) or {f"{prefix}.{f.name}" if prefix else f.name})}
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]") or {f"{prefix}[]"}
    return {prefix}


def fingerprint(paths) -> str:
    """Hash of the known paths among ``paths``."""
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN_PATHS)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def choose_layout(paths) -> Layout:
    """The layout of a set of field paths: by fingerprint, else the most specific one contained in it."""
    found = BY_FINGERPRINT.get(fingerprint(paths))
    if found is None:
        fitting = [layout for layout in LAYOUTS if set(layout.paths) <= set(paths)]
        if not fitting:
            raise ValueError(f"no layout fits the fields {sorted(paths)}")
        found = max(fitting, key=lambda layout: len(layout.paths))
    return found


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) of a frame in any registered layout."""
    layout = choose_layout(field_paths(df.schema))
    if layout.turns is None:
        return df.select("conv_id", F.col("turn").cast("long").alias("pos"), F.col("role").cast("string"), F.col("text").cast("string"))
    turns = df.select("conv_id", F.expr(layout.turns).alias("turns"))
    return turns.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", F.col("pos").cast("long"), "t.role", "t.text")


def row_paths(payload: Column) -> Column:
    """Sorted known field paths of each JSON row, as an array."""
    def there(path: str) -> Column:
        head, _, rest = path.partition("[].")
        if not rest:
            return F.try_variant_get(payload, f"$.{head}", "variant").isNotNull()
        return F.exists(F.try_variant_get(payload, f"$.{head}", "array<variant>"), lambda m: F.try_variant_get(m, f"$.{rest}", "variant").isNotNull())

    return F.array_compact(F.array(*(F.when(there(p), F.lit(p)) for p in sorted(KNOWN_PATHS - {"conv_id"}))))


def _json_layout(paths: Column) -> Column:
    """The number of the layout of each row's paths: by fingerprint, else the most specific one contained in them
    (first registered on a tie); null if none fits."""
    known = [sorted(set(layout.paths) - {"conv_id"}) for layout in LAYOUTS]
    out = F.lit(None).cast("int")
    for k in sorted(range(len(LAYOUTS)), key=lambda k: (len(known[k]), -k)):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, known[k])), paths)) == 0, k).otherwise(out)
    print_ = F.sha2(F.concat_ws("\n", paths), 256)
    for k, names in enumerate(known):
        out = F.when(print_ == hashlib.sha256("\n".join(names).encode()).hexdigest(), k).otherwise(out)
    return out


def _json_turns(layout: Layout, payload: Column) -> Column:
    def text(path: str) -> Column:
        return F.try_variant_get(payload, f"$.{path}", "string")

    def turn(role: Column, said: Column) -> Column:
        return F.struct(role.alias("role"), said.alias("text"))

    paths = [p for p in layout.paths if p != "conv_id"]
    head, _, role = paths[0].partition("[].")
    if role:
        said = paths[1].partition("[].")[2]

        def one(m: Column) -> Column:
            name = F.try_variant_get(m, f"$.{role}", "string")
            plain = F.lower(name)
            name = F.when(plain == "human", "user").when(plain.isin("gpt", "bot"), "assistant").otherwise(name) if role == "from" else name
            return turn(name, F.try_variant_get(m, f"$.{said}", "string"))

        return F.transform(F.try_variant_get(payload, f"$.{head}", "array<variant>"), one)
    if layout.name == "rows":
        return F.array(turn(text("role"), text("text")))
    asked = text(paths[0])
    if layout.name == "instruction":
        asked = F.concat(asked, F.when(F.coalesce(text("input"), F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\n"), text("input"))))
    return F.array(turn(F.lit("user"), asked), turn(F.lit("assistant"), text(paths[-1])))


def _json_rows(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("conv_id"), F.col(payload_col).cast("string").alias("raw"), F.try_parse_json(F.col(payload_col).cast("string")).alias("payload"))
    return rows.withColumn("layout", _json_layout(row_paths(F.col("payload"))))


def canonical_turns_json(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Canonical turns of JSON rows whose layout may differ from row to row; each row's own
    fingerprint selects its mapping."""
    rows, chosen = _json_rows(df, id_col, payload_col), F.lit(None).cast(f"array<{TURN}>")
    for k, layout in enumerate(LAYOUTS):
        chosen = F.when(F.col("layout") == k, _json_turns(layout, F.col("payload")).cast(f"array<{TURN}>")).otherwise(chosen)
    single = next(k for k, layout in enumerate(LAYOUTS) if layout.turns is None)
    at = F.when(F.col("layout") == single, F.try_variant_get(F.col("payload"), "$.turn", "long"))
    rows = rows.select("conv_id", F.coalesce(at, F.lit(0)).alias("at"), chosen.alias("turns"))
    return rows.select("conv_id", "at", F.posexplode("turns").alias("pos", "t")).select("conv_id", (F.col("at") + F.col("pos")).alias("pos"), "t.role", "t.text")


def rows_without_layout(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """conv_id and payload of the JSON rows that no layout fits, those that are no JSON among them."""
    return _json_rows(df, id_col, payload_col).where(F.col("layout").isNull()).select("conv_id", F.col("raw").alias("payload"))


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_HEAD, r"$1\\")


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (spans of code points of the
    formatted string that hold the assistant's escaped text).

    One shuffle by conv_id; offsets are running sums in that partitioning's sort order.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    parts = turns.select("conv_id", "pos", role.alias("role"), text.alias("text")).select("*", escape(F.col("role")).alias("er"), escape(F.col("text")).alias("et"))
    head = F.concat(F.lit(TURN_START), "er", F.lit(TURN_SEP))
    parts = parts.select("conv_id", "pos", "role", "text", F.length(head).cast("long").alias("lead"), F.length("et").cast("long").alias("said"), F.concat(head, "et", F.lit(TURN_END)).alias("piece"))
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = parts.select("conv_id", before.alias("start"), "piece", (F.col("role") == "assistant").alias("learn"), "lead", "said")
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "piece", "learn", "lead", "said"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["learn"]), lambda x: F.struct((x["start"] + x["lead"]).alias("start"), x["said"].alias("length")))
    return gathered.select("conv_id", F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("formatted"), spans.alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and loss_text, parsed from formatted strings alone."""
    pieces = F.split("formatted", re.escape(TURN_END), -1)

    def turn(piece: Column) -> Column:
        body = F.split(piece, re.escape(TURN_SEP), 2)
        role = F.substr(body[0], F.lit(len(TURN_START) + 1))
        return F.struct(unescape(role).alias("role"), unescape(body[1]).alias("text"))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    loss = F.concat_ws("", F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    return chats.select("conv_id", "formatted", "loss_mask", turns.alias("turns"), loss.alias("loss_text"))
