r"""Chats in any known layout as canonical turns, and turns as one reversible text with a loss mask.

A layout is a set of nested field paths (``messages[].role``). The hash of a table's paths, or of a JSON record's own,
is its fingerprint; it selects one of the declared ``LAYOUTS``, whose expressions give the turns. The
template writes a turn as ``### role: text</turn>\n``; control strings inside roles and texts are escaped, so that
neither ``###`` nor ``</turn>`` stands in an escaped text and the first mark found is a mark. Everything is
DataFrame functions.

Defined results: turns come in their given order, for rows by turn (null first), then role, then text; a
null or empty role is an empty one, a null text an empty one; turns whose fields are all null in a fixed layout (an
absent input) are no turns. A chat without turns is an empty text. A null chat id is one chat of its own. A record
whose paths fit no layout has no chat: ``unknown_layouts`` returns it. Columns that no layout names are ignored; where an extra
column bears the name of a field of another layout, the first layout whose paths are all there is taken. Turns that
are equal are kept. A chat is one value, as it is one text in the output.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps the chat's id and its turns.

    ``turns`` names an array with ``role`` and ``text`` inside; ``fixed`` lists turns that are columns, as (role,
    columns whose texts are joined by a blank line); ``row`` names the columns of a layout with one row a turn.
    """

    name: str
    chat: str
    turns: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    row: tuple[str, str, str] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> list[str]:
        if self.row:
            return sorted([self.chat, *self.row])
        if self.turns:
            return sorted([self.chat, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"])
        return sorted([self.chat, *[c for _, columns in self.fixed for c in columns]])

    @property
    def fingerprint(self) -> str:
        return path_hash(self.paths)


#: The known layouts, in the order in which they are tried. Roles of other vocabularies are mapped.
SPOKEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = [
    Layout("turn rows", "conv_id", row=("turn", "role", "text")),
    Layout("messages", "id", "messages", "role", "content", roles=SPOKEN),
    Layout("messages by conversation", "conv_id", "messages", "role", "content", roles=SPOKEN),
    Layout("speakers", "id", "conversations", "from", "value", roles=SPOKEN),
    Layout("instruction with input and system", "id", fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction with input", "id", fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", "id", fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction and response", "id", fixed=(("user", ("instruction",)), ("assistant", ("response",)))),
    Layout("prompt and completion", "id", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", "id", fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", "id", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
]


def path_hash(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def nested_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves; ``[]`` steps into an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in nested_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return nested_paths(kind.elementType, prefix + "[]")
    return [prefix]


def _named(paths: list[str]) -> list[str]:
    """The paths that some layout names: the others say nothing about the layout."""
    known = {p for layout in LAYOUTS for p in layout.paths}
    return [p for p in paths if p in known]


def layout_of(schema: StructType) -> Layout | None:
    """The layout with the fingerprint of the table's paths, else the first whose paths are all there."""
    paths = _named(nested_paths(schema))
    found = {layout.fingerprint: layout for layout in LAYOUTS}.get(path_hash(paths))
    return found or next((layout for layout in LAYOUTS if set(layout.paths) <= set(paths)), None)


def _spoken(role: Column, roles: dict[str, str]) -> Column:
    return reduce(lambda c, kv: c.when(role == kv[0], F.lit(kv[1])), roles.items(), F.when(F.lit(False), role)).otherwise(role) if roles else role


def _turns(layout: Layout, at) -> Column:
    """The turns of a layout without rows; ``at`` gives a column by its name."""
    if layout.turns:
        return F.transform(at(layout.turns), lambda t: F.struct(F.coalesce(_spoken(t[layout.role], layout.roles).cast("string"), F.lit("")).alias("role"), F.coalesce(t[layout.text].cast("string"), F.lit("")).alias("text")))
    each = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(at(c).cast("string"), F.lit("")) for c in columns]).alias("text"), F.coalesce(*[at(c).cast("string") for c in columns]).isNotNull().alias("given")) for role, columns in layout.fixed]
    return F.transform(F.filter(F.array(*each), lambda t: t["given"]), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def chats(table: DataFrame) -> DataFrame:
    """``conv_id, turns`` of a table in a known layout; raises where its fingerprint and paths fit none."""
    layout = layout_of(table.schema)
    if layout is None:
        raise ValueError(f"no layout for {sorted(nested_paths(table.schema))}")
    if not layout.row:
        return table.select(F.col(layout.chat).alias("conv_id"), F.coalesce(_turns(layout, F.col), F.array().cast(TURNS)).cast(TURNS).alias("turns"))
    turn, role, text = layout.row
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return table.groupBy(F.col(layout.chat).alias("conv_id")).agg(ordered.cast(TURNS).alias("turns"))


def _shape(paths: list[str]) -> str:
    """Paths as ``schema_of_variant`` nests them, without the types of leaves."""
    tops: dict[str, list[str]] = {}
    for p in paths:
        top, _, rest = p.partition("[].")
        tops.setdefault(top, []).extend([rest] if rest else [])
    inner = lambda names: "OBJECT<" + ",".join(sorted(names)) + ">"
    return inner(f"{top}:ARRAY<{inner(rest)}>" if rest else top for top, rest in tops.items())


def json_fingerprint(json: Column) -> Column:
    """The hash of a JSON record's own nested names, whatever the types of their values; null where it is no JSON."""
    nested = F.schema_of_variant(F.try_parse_json(json))
    names = F.regexp_replace(F.regexp_replace(nested, r": (?!ARRAY<OBJECT|OBJECT)[A-Z]+(\([0-9,]+\)|<[A-Z]*(\([0-9,]+\))?>)?", ""), ", |: ", "\0")
    return F.sha2(F.regexp_replace(F.regexp_replace(names, "\0(ARRAY)", ":$1"), "\0", ","), 256)


def json_layout(json: Column) -> Column:
    """The place in ``LAYOUTS`` that a record's fingerprint selects, else null."""
    known = {hashlib.sha256(_shape(layout.paths).encode()).hexdigest(): i for i, layout in enumerate(LAYOUTS) if not layout.row}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.element_at(F.create_map(*pairs), json_fingerprint(json))


def json_chats(records: DataFrame, json: str) -> DataFrame:
    """``conv_id`` (text), ``turns`` of JSON records of several layouts; each record's fingerprint selects its mapping."""
    kind = lambda layout: StructType.fromDDL(_ddl(layout))
    value: Column | None = None
    for i, layout in enumerate(LAYOUTS):
        if layout.row:
            continue
        parsed = F.from_json(F.col(json), kind(layout))
        chat = F.struct(parsed[layout.chat].alias("conv_id"), F.coalesce(_turns(layout, lambda c, p=parsed: p[c]), F.array().cast(TURNS)).cast(TURNS).alias("turns"))
        value = F.when(F.col("_layout") == i, chat) if value is None else value.when(F.col("_layout") == i, chat)
    known = records.select(json, json_layout(F.col(json)).alias("_layout")).where("_layout IS NOT NULL")
    return known.select(value.alias("chat")).select("chat.*")


def unknown_layouts(records: DataFrame, json: str) -> DataFrame:
    """The records that ``json_chats`` has no mapping for."""
    return records.where(json_layout(F.col(json)).isNull())


def _ddl(layout: Layout) -> str:
    if layout.turns:
        return f"`{layout.chat}` string, `{layout.turns}` array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
    return ", ".join(f"`{p}` string" for p in layout.paths)


# The template. ESCAPES are applied in this order; a back slash is always followed by one of b, h, e, c.
BEGIN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
ESCAPES = [(r"\\", r"\\b"), (r"#(?=##)", r"\\h"), (r"<(?=/turn>)", r"\\e")]
UNESCAPES = [(r"\\e", "<"), (r"\\h", "#"), (r"\\c", ":"), (r"\\b", r"\\")]


def escaped(text: Column) -> Column:
    return reduce(lambda c, pair: F.regexp_replace(c, *pair), ESCAPES, text)


def unescaped(text: Column) -> Column:
    # After the others are gone, a back slash stands before b alone.
    return reduce(lambda c, pair: F.regexp_replace(c, *pair), UNESCAPES, text)


def _header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.regexp_replace(escaped(role), ":", r"\\c"), F.lit(AFTER_ROLE))


def _running(lengths: Column, chunk: int = 1000) -> Column:
    """What stands before each of ``lengths``; by chunks, as an array that grows is copied at every step."""

    def sums(xs: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    zero = F.lit(0).cast("bigint")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / chunk).cast("int")), lambda g: F.slice(lengths, g * chunk + 1, F.lit(chunk)))
    before = sums(F.transform(groups, lambda g: F.aggregate(g, zero, lambda a, x: a + x)), zero)
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(F.zip_with(groups, before, sums)))


def _chars(c: Column) -> Column:
    return F.char_length(c).cast("bigint")


def formatted(chats: DataFrame, learnt: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: one span of code points a turn, without length where the role is not ``learnt``."""
    piece = lambda t: F.struct((t["role"] == learnt).alias("learnt"), _header(t["role"]).alias("head"), escaped(t["text"]).alias("body"))
    pieces = chats.select("conv_id", F.transform("turns", piece).alias("_p"))
    before = pieces.select("conv_id", "_p", _running(F.transform("_p", lambda p: _chars(p["head"]) + _chars(p["body"]) + len(END))).alias("_at"))
    whole = F.array_join(F.transform("_p", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    span = lambda p, at: F.struct((at + _chars(p["head"])).alias("start"), F.when(p["learnt"], _chars(p["body"])).otherwise(0).alias("length"))
    return before.select("conv_id", whole.alias("formatted"), F.zip_with("_p", "_at", span).alias("loss_spans"))


def _pieces(text: Column) -> Column:
    """The formatted turns without their end marks."""
    cut = F.split(text, re.escape(END))
    return F.slice(cut, 1, F.size(cut) - 1)


def parsed_turns(text: Column) -> Column:
    """The turns that a formatted text holds."""
    cut = F.transform(_pieces(text), lambda t: F.struct(t.alias("t"), F.instr(t, AFTER_ROLE).alias("at")))
    role = lambda c: c["t"].substr(F.lit(len(BEGIN) + 1), c["at"] - len(BEGIN) - 1)
    body = lambda c: c["t"].substr(c["at"] + len(AFTER_ROLE), F.char_length(c["t"]))
    return F.transform(cut, lambda c: F.struct(unescaped(role(c)).alias("role"), unescaped(body(c)).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    pieces = _pieces(text)
    placed = F.arrays_zip(pieces.alias("t"), _running(F.transform(pieces, lambda t: _chars(t) + len(END))).alias("at"), spans.alias("s"))
    return F.array_join(F.transform(placed, lambda p: unescaped(p["t"].substr((p["s"]["start"] - p["at"] + 1).cast("int"), p["s"]["length"].cast("int")))), "")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what ``formatted``'s output holds: of its turns, and of the text under the mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = chats.select("conv_id", parsed_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), _chars(F.col("formatted")).alias("formatted_chars"))
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), _chars(F.col("loss")).alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
