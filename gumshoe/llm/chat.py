"""Chat records of many layouts as canonical turns, and turns as formatted text with a loss mask; DataFrame functions only.

A record is a variant. Its nested field paths (``messages``, ``messages[]``, ``messages[].role`` ...) are listed to a fixed depth,
sorted and hashed; the hash selects one of the declared layouts, and the layout says where roles and texts lie. Fields whose first
name no layout uses are metadata and do not count, nor do those in ``IGNORED``; any other path does, so that a layout which is not
declared is reported by :func:`unmapped` and never read by the wrong mapping.

The template puts a mark before and behind each turn. Marks inside texts and roles are escaped: one backslash is put behind
the bracket of a mark, also where backslashes already are there, and reading takes one away. The loss mask are the spans, in
code points, of the assistant's texts.

Nulls and ties: a null role or text is empty; turns are ordered by turn (nulls first), then role and text, and rows that repeat
are turns of their own. Turns with a null id make up one conversation. A field that an optional path names and that is null is
left out; required ones are empty then. A conversation becomes one string, so it has to fit in a row: that is the only bound on its
texts. Empty tables give an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 5
"""Lists and fields inside one another that paths are followed through."""
TURNS = "array<struct<turn: bigint, role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    ``each``: a list whose elements hold ``role`` and ``text``, after the fields of ``fixed``; ``parts`` says that a text may be a list
    of ``{type, text}``. ``fixed``: a turn for each (role, fields), its fields joined by an empty line. ``row``: the record is one turn
    of a conversation, ``turn`` its place.
    """

    name: str
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    parts: bool = False
    row: bool = False

    def paths(self) -> list[str]:
        found = [f for _, fields in self.fixed for f in fields]
        if self.row:
            found += ["turn", self.role, self.text]
        if self.each:
            inside = f"{self.each}[]"
            found += [self.each, inside, f"{inside}.{self.role}", f"{inside}.{self.text}"]
            if self.parts:
                found += [f"{inside}.{self.text}[]", f"{inside}.{self.text}[].type", f"{inside}.{self.text}[].text"]
        return found

    def fingerprints(self) -> list[str]:
        """One for each choice of optional fields."""
        needed = [p for p in self.paths() if p not in self.optional]
        chosen = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return [hashlib.md5("\n".join(sorted([*needed, *c])).encode()).hexdigest() for c in chosen]


_SYSTEM = ("system", ("system",))
# fixed values: field names of common chat layouts
LAYOUTS = (
    Layout("turn_row", row=True, text="text"),
    Layout("messages", each="messages", fixed=(_SYSTEM,), optional=("system",)),
    Layout("message_parts", each="messages", fixed=(_SYSTEM,), optional=("system",), parts=True),
    Layout("conversations", each="conversations", role="from", text="value", fixed=(_SYSTEM,), optional=("system",)),
    Layout(
        "instruction",
        fixed=(_SYSTEM, ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("system", "input"),
    ),
    Layout("prompt_completion", fixed=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt_response", fixed=(_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("question_answer", fixed=(_SYSTEM, ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)
# fixed values: speakers of the "conversations" layout, and fields inside messages that hold no text
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
IGNORED = ("messages[].name", "messages[].weight", "conversations[].weight")


def record_of(*columns: str) -> Column:
    """The named columns of a table as a record."""
    return F.to_variant_object(F.struct(*columns))


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, path, kind)


def _nested(value: Column, depth: int) -> Column:
    """Paths below a value, each with the sign that leads to it."""
    lists = _get(value, "$", "array<variant>")
    if not depth:
        return F.when(lists.isNotNull(), F.array(F.lit("[]"))).otherwise(F.array().cast("array<string>"))
    fields = F.transform(_fields(value, depth), lambda p: F.concat(F.lit("."), p))
    below = F.flatten(F.transform(lists, lambda x: F.transform(_nested(x, depth - 1), lambda p: F.concat(F.lit("[]"), p))))
    lists = F.when(lists.isNotNull(), F.array_distinct(F.concat(F.array(F.lit("[]")), below)))
    return F.coalesce(lists, fields, F.array().cast("array<string>"))


def _fields(value: Column, depth: int, only: tuple[str, ...] = ()) -> Column:
    entries = F.map_entries(_get(value, "$", "map<string,variant>"))
    if only:
        entries = F.filter(entries, lambda e: e["key"].isin(*only))
    each = lambda e: F.concat(F.array(e["key"]), F.transform(_nested(e["value"], depth - 1), lambda p: F.concat(e["key"], p)))
    return F.flatten(F.transform(entries, each))


def field_paths(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The sorted nested paths of a record below the first names that layouts use."""
    first = tuple(sorted({p.split("[")[0] for layout in layouts for p in layout.paths()}))
    paths = F.array_except(_fields(record, DEPTH, first), F.array(*map(F.lit, IGNORED)))
    return F.coalesce(F.sort_array(paths), F.array().cast("array<string>"))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return F.md5(F.array_join(field_paths(record, layouts), "\n"))


def _turn(turn: Column, role: Column, text: Column) -> Column:
    named = (turn.cast("long").alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return F.struct(*named)


def _turns(layout: Layout, record: Column) -> Column:
    if layout.row:
        return F.array(_turn(_get(record, "$.turn", "long"), *(_get(record, f"$.{p}", "string") for p in (layout.role, layout.text))))
    turns = []
    for at, (role, fields) in enumerate(layout.fixed):
        texts = F.array(*[_get(record, f"$.{f}", "string") for f in fields])
        left_out = F.lit(all(f in layout.optional for f in fields)) & F.forall(texts, lambda t: t.isNull())
        text = F.array_join(F.filter(texts, lambda t: F.length(t) > 0), "\n\n")
        turns.append(F.when(~left_out, _turn(F.lit(at - len(layout.fixed)), F.lit(role), text)))
    turns = F.array_compact(F.array(*turns)) if turns else F.array().cast(TURNS)
    if not layout.each:
        return turns
    speakers = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])

    def one(element: Column, at: Column) -> Column:
        role, text = _get(element, f"$.{layout.role}", "string"), _get(element, f"$.{layout.text}", "string")
        if layout.parts:
            parts = F.transform(_get(element, f"$.{layout.text}", "array<variant>"), lambda p: _get(p, "$.text", "string"))
            text = F.coalesce(F.array_join(parts, "\n"), text)
        return _turn(at, F.coalesce(speakers[role], role) if layout.role == "from" else role, text)

    return F.concat(turns, F.transform(_get(record, f"$.{layout.each}", "array<variant>"), one))


def mapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records (conv_id, record)`` with fingerprint, layout (null if none has this fingerprint) and its turns."""
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        found = F.col("fingerprint").isin(*layout.fingerprints())
        name = F.when(found, F.lit(layout.name)).otherwise(name)
        turns = F.when(found, _turns(layout, F.col("record")).cast(TURNS)).otherwise(turns)
    rows = records.select("conv_id", "record", fingerprint(F.col("record"), layouts).alias("fingerprint"))
    return rows.select("conv_id", "record", "fingerprint", name.alias("layout"), turns.alias("turns"))


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """fingerprint, n, paths of the layouts that are not declared."""
    rows = mapped(records, layouts).where("layout is null")
    return rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.first(field_paths(F.col("record"), layouts)).alias("paths"))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records (conv_id, record)`` to conv_id, turn, role, text, one row a turn."""
    return mapped(records, layouts).select("conv_id", F.inline("turns"))


# fixed values: the marks of the template
BEGIN = "<s>"
MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", "</s>")}
OTHER, AS, OTHER_END = "[ROLE] ", " [AS] ", " [/ROLE]"
LEARNED = "assistant"
_TAIL = r"/?(?:(?:INST|SYS|ANS|ROLE|AS)\]|s>)"
_PLAIN, _ESCAPED = rf"([\[<])(\\*{_TAIL})", rf"([\[<])\\(\\*{_TAIL})"
_TURN = r"(?s)\[(?:INST|SYS|ANS|ROLE)\] .*?(?: \[/(?:INST|SYS|ROLE)\]|</s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _mark(role: Column, side: int, other: Column) -> Column:
    found = other
    for name, marks in MARKS.items():
        found = F.when(role == name, F.lit(marks[side])).otherwise(found)
    return found


def formatted(turns: DataFrame) -> DataFrame:
    """``turns (conv_id, turn, role, text)`` to conv_id, formatted, loss (array of start and length in code points)."""
    rows = turns.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    ).select("*", escaped(F.col("text")).alias("body"))
    role = F.col("role")
    opening = _mark(role, 0, F.concat(F.lit(OTHER), escaped(role), F.lit(AS)))
    rows = rows.select("*", opening.alias("opening"), _mark(role, 1, F.lit(OTHER_END)).alias("closing"))
    rows = rows.withColumn("piece", F.concat("opening", "body", "closing"))
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + len(BEGIN)
    span = F.struct((F.col("at") + F.length("opening")).alias("start"), F.length("body").cast("long").alias("length"))
    rows = rows.withColumn("at", at).select(
        "conv_id", F.struct("at", "piece", F.when(role == LEARNED, span).alias("span")).alias("part")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return whole.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.col("parts.piece"), "")).alias("formatted"),
        F.array_compact(F.col("parts.span")).alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""

    def inside(turn: Column, opening: str, closing: str) -> Column:
        return F.substr(turn, F.lit(len(opening) + 1), F.length(turn) - len(opening) - len(closing))

    def read(turn: Column) -> Column:
        other = inside(turn, OTHER, OTHER_END)
        cut = F.instr(other, AS)
        role, said = F.substr(other, F.lit(1), cut - 1), F.substr(other, cut + len(AS))
        for name, marks in MARKS.items():
            here = F.startswith(turn, F.lit(marks[0]))
            role, said = F.when(here, F.lit(name)).otherwise(role), F.when(here, inside(turn, *marks)).otherwise(said)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), read)


def learned_texts(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they were before formatting."""
    return F.transform(loss, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
