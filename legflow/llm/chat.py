"""Chat formatting: schema fingerprints pick declarative mappings into canonical turns.

A record is a JSON object in one of several layouts.  Its fingerprint is the
hash of its sorted nested field paths (array elements as ``[]``); the
fingerprint picks a mapping, which only names paths.  Canonical turns are
formatted one by one, so a conversation of any length is never held whole:

    user       ``[INST] text [/INST]``
    assistant  ``[ASST] text </s>``
    system     ``[SYS] text [/SYS]``
    any other  ``[ROLE]name[/ROLE] text [/TURN]``

Control strings inside a text or a role name get one more backslash after
their first character, those that have backslashes there already likewise;
reading takes one away.  The loss mask covers exactly the escaped text of
assistant turns, without marks or blanks around it.

Nulls: a null text or role is empty; a null conv_id is a conversation of its
own; null turns come first.  Turns of equal number are ordered by role, then
text; repeated rows are repeated turns.

A record may hold more than its mapping names: among the mappings whose paths
it has all of, the one of most paths is taken, and ``n_unread`` counts the
paths left aside.  Numbers and truth values become their JSON text, lists and
``{"text": ...}`` parts are joined.  A record that is null, no JSON object, or
of unknown layout gives one row with a null layout and no turn; ``accounted``
counts them, so no record is lost unseen.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """``items``: path of a list of turns, or None for the record itself.  ``turns``: (role, or path of the role after
    ``$``, path of the text) of each turn of an item.  ``names``: role names that the layout uses for ours."""

    name: str
    paths: tuple[str, ...]
    items: str | None
    turns: tuple[tuple[str, str], ...]
    names: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "messages", (("$role", "content"),)),
    Mapping("message parts", ("messages[].role", "messages[].content[].text"), "messages", (("$role", "content"),)),
    Mapping("dialogue", ("conversations[].from", "conversations[].value"), "conversations", (("$from", "value"),),
            (("human", "user"), ("gpt", "assistant"))),
    Mapping("nested", ("message.author.role", "message.content.parts[]"), None, (("$message.author.role", "message.content.parts"),)),
    Mapping("prompt", ("prompt",), None, (("user", "prompt"),)),
    Mapping("completion", ("completion",), None, (("assistant", "completion"),)),
    Mapping("pair", ("prompt", "completion"), None, (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", ("instruction", "output"), None, (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction only", ("instruction",), None, (("user", "instruction"),)),
    Mapping("output only", ("output",), None, (("assistant", "output"),)),
    Mapping("system instruction", ("system", "instruction", "output"), None,
            (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


#: Fingerprints whose mapping a task remembers; any others are looked up again each time.
LAYOUTS = 100_000


def paths_of(value, path: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths_of(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths_of(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def text_of(value) -> str:
    """A JSON value as text: parts of a list are joined, of an object its ``text``."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(text_of, value))
    if isinstance(value, dict):
        return text_of(value.get("text"))
    return json.dumps(value)


def at_path(value, path: str):
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    names = dict(mapping.names)
    out = []
    for item in at_items(record, mapping.items):
        for role, path in mapping.turns:
            role = text_of(at_path(item, role[1:])) if role.startswith("$") else role
            out.append((names.get(role, role), text_of(at_path(item, path))))
    return out


def at_items(record: dict, path: str | None) -> list:
    items = [record] if path is None else record.get(path)
    return items if isinstance(items, list) else []


def mapping_for(paths: set[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The first mapping of most paths among those whose paths are all there."""
    fitting = [m for m in mappings if set(m.paths) <= paths]
    return max(fitting, key=lambda m: len(m.paths), default=None)


def loaded(raw: str | None):
    """The JSON object of a record, or None."""
    try:
        record = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def canonical(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, part, layout, role, text, n_unread) of every turn of every record (conv_id, turn, record)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {fingerprint(m.paths): m for m in mappings}
        for batch in batches:
            at, part, layout, role, text, unread = [], [], [], [], [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                record = loaded(raw)
                paths = paths_of(record) if record is not None else set()
                key = fingerprint(paths)
                if key not in known and len(known) < LAYOUTS:
                    known[key] = mapping_for(paths, mappings)
                mapping = known[key] if key in known else mapping_for(paths, mappings)
                turns = turns_of(record, mapping) if record is not None and mapping else []
                for j, (r, t) in enumerate(turns or [(None, None)]):
                    at.append(i)
                    part.append(j)
                    layout.append(mapping.name if turns else None)
                    role.append(r)
                    text.append(t)
                    unread.append(len(paths - set(mapping.paths)) if turns else len(paths))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(part, pa.int32()),
                                              *(pa.array(x, pa.string()) for x in (layout, role, text)), pa.array(unread, pa.int64())],
                                             ["conv_id", "turn", "part", "layout", "role", "text", "n_unread"])

    return records.select("conv_id", "turn", "record").mapInArrow(
        run, "conv_id bigint, turn bigint, part int, layout string, role string, text string, n_unread bigint")


def accounted(turns: DataFrame) -> DataFrame:
    """(layout, n_records, n_turns, n_unread) over the rows of ``canonical``; the null layout's records were not read."""
    return turns.groupBy("layout").agg(F.count_if(F.col("part") == 0).alias("n_records"), F.count("layout").alias("n_turns"),
                                       F.sum(F.when(F.col("part") == 0, F.col("n_unread")).otherwise(0)).alias("n_unread"))


CONTROL = r"([\[<])(\\{})(/?INST\]|ASST\]|/?SYS\]|/?ROLE\]|/TURN\]|/?s>|\|[a-z_]{{1,40}}\|>)"
ESCAPE, UNESCAPE = re.compile(CONTROL.format("*")), re.compile(CONTROL.format("+"))
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ASST] ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[ASST\] (?P<assistant>.*?) </s>|\[SYS\] (?P<system>.*?) \[/SYS\]"
                  r"|\[ROLE\](?P<name>.*?)\[/ROLE\] (?P<other>.*?) \[/TURN\]", re.S)


def escaped(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its text)."""
    before, after = MARKS.get(role) or (f"[ROLE]{escaped(role)}[/ROLE] ", " [/TURN]")
    body = escaped(text)
    return before + body + after, len(before), len(before) + len(body)


def read(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; anything between turns is an error."""
    at = 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = m.lastgroup if m["name"] is None else unescaped(m["name"])
        yield role, unescaped(m["other"] if m["name"] is not None else m[m.lastgroup])
        at = m.end()


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, formatted, mask): each turn's formatted text and its loss ranges (code points in it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [render(r or "", t or "") for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            mask = [[a, b] if r == "assistant" else [] for r, (_, a, b) in zip(batch.column(3).to_pylist(), rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _, _ in rows], pa.string()),
                                              pa.array(mask, pa.list_(pa.int64()))],
                                             ["conv_id", "turn", "part", "role", "text", "formatted", "mask"])

    return (turns.filter("layout is not null").select("conv_id", "turn", "part", "role", "text")
            .mapInArrow(run, "conv_id bigint, turn bigint, part int, role string, text string, formatted string, mask array<bigint>"))


def digests(out: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from the formatted turns and the mask alone, as a stream in turn order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: list = []

        def row():
            n, turns, loss_n, loss, chars = state
            return (now[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)

        def batch_of(rows):
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (conv,):
                    if now:
                        rows.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, turn in read(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{turn}\n".encode())
                for a, b in zip(mask[::2], mask[1::2]):
                    lost = unescaped(text[a:b])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(text)
            yield batch_of(rows)
        if now:
            yield batch_of([row()])

    order = ["conv_id", "turn", "part", "role", "text"]
    return (out.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted", "mask")
            .mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"))


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, record): rows (conv_id, turn, role, text) written in the layouts that sources use, dealt by hash."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    obj = lambda **f: F.to_json(F.struct(*[c.alias(k) for k, c in f.items()]))
    kind = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(5))
    known = {"user": ("prompt", "instruction"), "assistant": ("completion", "output")}
    messages = obj(messages=F.array(F.struct(role.alias("role"), text.alias("content"))))
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    dialogue = obj(conversations=F.array(F.struct(other.alias("from"), text.alias("value"))))
    nested = obj(message=F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")))

    def single(i: int) -> Column:
        out = messages
        for name, fields in known.items():
            out = F.when(role == name, obj(**{fields[i]: text})).otherwise(out)
        return out

    # a source that calls a role "human" or "gpt" itself would be read as ours, so such rows keep the plain layout
    record = (F.when((kind == 1) & ~role.isin("human", "gpt"), dialogue).when(kind == 2, nested)
              .when(kind == 3, single(0)).when(kind == 4, single(1)).otherwise(messages))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), record.alias("record"))
