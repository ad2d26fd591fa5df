r"""Chat formatting: heterogeneous layouts to canonical turns, turns to one training string with a loss mask.

A layout is recognised by its schema: the nested field paths are hashed to a fingerprint, which selects a declarative
mapping (``MAPPINGS``). Where further fields make the fingerprint unknown, the mapping with the most paths that are all
there is taken, of several such the first in the table. A conversation's turns are gathered by its id; a conversation is
one output row by nature, so one with very many turns (all rows with a null id, say) is one task's work.

Template (control strings in upper case brackets or ``<s>``): a user turn is ``[INST] text [/INST]``, an assistant turn
``<s>text</s>``, a system turn ``[SYS]text[/SYS]``, any other ``[ROLE]role[/ROLE][TURN]text[/TURN]``. Inside texts, a
control string gets one backslash after its first character, and one that has backslashes there already gets one more;
so no text holds a control string, and taking one away restores every text. The loss mask is the spans, in code points
of the formatted string, of the assistant texts.

Records whose layouts differ from row to row (``canonical_json``) never end a job: ``layout`` names the mapping, or says
why there are no turns: ``null``, ``malformed`` (no JSON), ``no record`` (JSON, but no object), ``unknown`` and the
fingerprint (no mapping fits). A list of turns that is null, empty, or holds nothing but nulls is that layout without
turns; of a list's entries, nulls are no turns, and others that aren't objects are turns without a role.

Defined results: a null text or role counts as empty; turns are ordered by (turn, role, text), null turns first; rows
with a null conv_id form one conversation; repeated rows are repeated turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import tidy

TURNS = "array<struct<role:string,text:string>>"

_TAIL = r"(/?s>|/?(?:INST|SYS|ROLE|TURN)\])"
_ESCAPE, _UNESCAPE = re.compile(r"([<\[])(\\*)" + _TAIL), re.compile(r"([<\[])\\(\\*)" + _TAIL)
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s>(?P<assistant>.*?)</s>|\[SYS\](?P<system>.*?)\[/SYS\]|\[ROLE\](?P<role>.*?)\[/ROLE\]\[TURN\](?P<other>.*?)\[/TURN\]", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string, and the (start, end) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        match role:
            case "user":
                before, after = "[INST] ", " [/INST]"
            case "assistant":
                before, after = "<s>", "</s>"
                spans.append((at + len(before), at + len(before) + len(body)))
            case "system":
                before, after = "[SYS]", "[/SYS]"
            case _:
                before, after = f"[ROLE]{escape(role)}[/ROLE][TURN]", "[/TURN]"
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


@dataclass(frozen=True)
class Mapping:
    """How a layout holds its turns.

    rows: a row for each turn, fields (id, order, role, text). list: a list of structs, fields (list, role, text).
    columns: a field for each part, fields ((role, field, ...), ...), the fields of a part joined by an empty line.
    """

    kind: str
    paths: frozenset[str]
    fields: tuple
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def name(self) -> str:
        return ",".join(sorted(self.paths))


def _list(name: str, role: str, text: str, roles=()) -> Mapping:
    return Mapping("list", frozenset({f"{name}[].{role}", f"{name}[].{text}"}), (name, role, text), roles)


def _columns(*parts: tuple[str, ...]) -> Mapping:
    return Mapping("columns", frozenset(f for _, *fields in parts for f in fields), parts)


_SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("chatbot", "assistant"))


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {
    fingerprint(m.paths): m
    for m in (
        Mapping("rows", frozenset({"conv_id", "turn", "role", "text"}), ("conv_id", "turn", "role", "text")),
        _list("messages", "role", "content"),
        _list("conversations", "from", "value", _SHARED_ROLES),
        _list("conversation", "role", "content"),
        _columns(("system", "system"), ("user", "instruction", "input"), ("assistant", "output")),
        _columns(("user", "instruction", "input"), ("assistant", "output")),
        _columns(("user", "instruction", "context"), ("assistant", "response")),
        _columns(("user", "instruction"), ("assistant", "output")),
        _columns(("user", "prompt"), ("assistant", "completion")),
        _columns(("user", "prompt"), ("assistant", "response")),
        _columns(("user", "question"), ("assistant", "answer")),
    )
}


def find_mapping(paths: set[str]) -> Mapping | None:
    if found := MAPPINGS.get(fingerprint(paths)):
        return found
    fitting = [m for m in MAPPINGS.values() if m.paths <= paths]
    return max(fitting, key=lambda m: len(m.paths)) if fitting else None


def select_mapping(paths: set[str]) -> Mapping:
    if (found := find_mapping(paths)) is None:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return found


def schema_paths(schema: T.StructType) -> set[str]:
    def walk(kind: T.DataType, at: str) -> Iterator[str]:
        if isinstance(kind, T.ArrayType):
            yield from walk(kind.elementType, at + "[]")
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from walk(f.dataType, f"{at}.{f.name}" if at else f.name)
        else:
            yield at

    return set(walk(schema, ""))


def value_paths(value, at: str = "") -> set[str]:
    """As ``schema_paths``, of one parsed JSON value."""
    if isinstance(value, list):
        return set().union(*(value_paths(x, at + "[]") for x in value)) if value else set()
    if isinstance(value, dict):
        return set().union(*(value_paths(x, f"{at}.{k}" if at else k) for k, x in value.items())) if value else set()
    return {at}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _entry(x, role: str, text: str, roles: dict[str, str]) -> tuple[str, str]:
    if not isinstance(x, dict):
        return "", _text(x)
    return roles.get(r := _text(x.get(role)), r), _text(x.get(text))


def record_turns(record) -> tuple[list[tuple[str, str]], str]:
    """The turns of one parsed record, by the mapping that its own fields select, and the name of its layout."""
    if record is None:
        return [], "null"
    if not isinstance(record, dict):
        return [], "no record"
    m = find_mapping(value_paths(record))
    if m is None:  # lists of turns that have no fields to tell them by
        bare = [m for m in MAPPINGS.values() if m.kind == "list" and m.fields[0] in record and (record[m.fields[0]] is None or isinstance(record[m.fields[0]], list) and not any(isinstance(x, dict) for x in record[m.fields[0]]))]
        if not bare:
            return [], f"unknown {fingerprint(value_paths(record))[:16]}"
        m = bare[0]
    roles = dict(m.roles)
    if m.kind == "list":
        name, role, text = m.fields
        turns = [_entry(x, role, text, roles) for x in record[name] or [] if x is not None]
    elif m.kind == "rows":
        turns = [(_text(record["role"]), _text(record["text"]))]
    else:
        turns = [(part[0], "\n\n".join(filter(None, (_text(record[f]) for f in part[1:])))) for part in m.fields if part[0] != "system" or _text(record[part[1]])]
    return turns, m.name


def json_turns(text: str | None) -> tuple[list[tuple[str, str]], str]:
    """As ``record_turns``, of a record as JSON."""
    try:
        return record_turns(None if text is None else json.loads(text))
    except (ValueError, RecursionError):  # what isn't JSON, or is nested too deeply to be a record
        return [], "malformed"


def canonical(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """conv_id, turns: one row for each conversation of ``df``, whose schema selects the mapping."""
    m = select_mapping(schema_paths(df.schema))
    if m.kind == "rows":
        key, order, role, text = (df[f] for f in m.fields)
        turn = F.struct(order.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        ordered = df.select(key.alias("conv_id"), turn.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
        return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if m.kind == "list":
        name, role, text = m.fields
        names = F.create_map(*(F.lit(x) for pair in m.roles for x in pair)) if m.roles else None
        as_role = (lambda r: F.coalesce(F.try_element_at(names, r), r, F.lit(""))) if m.roles else (lambda r: F.coalesce(r, F.lit("")))
        turns = F.transform(df[name], lambda t: F.struct(as_role(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
        return df.select(df[id_column].alias("conv_id"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))
    turns = []
    for role, *fields in m.fields:
        text = F.array_join(F.filter(F.array(*(df[f] for f in fields)), lambda x: x.isNotNull() & (x != "")), "\n\n")
        one = F.struct(F.lit(role).alias("role"), text.alias("text"))
        turns.append(F.when(text != "", one) if role == "system" else one)
    return df.select(df[id_column].alias("conv_id"), F.array_compact(F.array(*turns)).cast(TURNS).alias("turns"))


def canonical_json(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """conv_id, turns and layout of a column of JSON records whose layouts differ from row to row."""

    @tidy
    def convert(batches):
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            found = [json_turns(x) for x in batch.column(1).to_pylist()]
            turns = [[{"role": _whole(r), "text": _whole(t)} for r, t in some] for some, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array([x for _, x in found], pa.string())], ["conv_id", "turns", "layout"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column], df[json_column]).mapInArrow(convert, f"conv_id {kind}, turns {TURNS}, layout string")


def _whole(text: str) -> str:
    """Halves of surrogate pairs, which JSON can hold and UTF-8 can't, as replacement characters."""
    return text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


def format_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points) of canonical turns."""

    @tidy
    def convert(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            done = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in done], pa.string()), spans], ["conv_id", "formatted", "loss_spans"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.select("conv_id", "turns").mapInArrow(convert, f"conv_id {kind}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted strings back gives: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    @tidy
    def convert(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(convert, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
