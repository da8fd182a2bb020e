"""Chat formatting by schema fingerprinting.

A record's layout is the set of its nested field paths; its hash, the fingerprint, selects a declarative mapping that
turns the record into canonical turns (conversation, place, role, text). Mappings say where things are, not how to
get them: MAPPINGS lists those for rows of one turn, lists of messages, prompt and response, and instructions. A
layout that no mapping's paths are all part of has no turns and comes out as one row with layout null.

The template marks turns with control strings. Inside texts a backslash goes before every control string and every
backslash, so no text can end its turn, and reading takes them away again.

Edge cases: null text is empty, a null role the empty role; null conversation ids are one conversation, and an id that
is no integer stands for the number that its text hashes to; turns are ordered by turn (null, or no integer, first),
then place in their record, then output, so repeated rows are repeated turns; records that are no JSON object, are
nested too deeply to be read or have no layout (as an empty list of messages) are one row without output, and a
conversation of such alone has no turns; a conversation of any length is read as a stream in order, holding one turn;
an empty table gives an empty result; extra fields do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BEGIN, END = "<s>", "</s>"
CONTROLS = (BEGIN, END, "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_TOKEN = re.compile(r"(\\.)|(" + "|".join(map(re.escape, CONTROLS)) + ")", re.S)


#: Fingerprints that a task keeps.
MOST_LAYOUTS = 4096


@dataclass(frozen=True)
class Mapping:
    """Paths: a[].b is field b of each element of list a. conversation and place: fields of the record, if any.

    each: path of the list of turns ("" for the record itself); role and text: within it. fixed: turns of given
    roles, each of the texts of some fields put together by a blank line, nulls and empty ones left out.
    """

    name: str
    conversation: str = ""
    place: str = ""
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = field(default=())

    def needs(self) -> set[str]:
        lead = f"{self.each}[]." if self.each else ""
        own = {p for p in (self.conversation, self.place) if p} | {lead + p for p in (self.role, self.text) if p}
        return own | {p for _, ps in self.fixed for p in ps if p not in self.optional}


MAPPINGS = (
    Mapping("turn rows", "conv_id", "turn", role="role", text="text"),
    Mapping("messages", each="messages", role="role", text="content"),
    Mapping("shared conversations", each="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", fixed=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Mapping("prompt and response", fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Mapping("prompt and completion", fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question and answer", fixed=(("user", ("question",)), ("assistant", ("answer",)))),
)


def paths(value, lead: str = "") -> set[str]:
    """Nested field paths of a record."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{lead}{k}"} | paths(v, f"{lead}{k}."))}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, lead.removesuffix(".") + "[].")}
    return set()


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Layouts:
    """Mappings by fingerprint; a new fingerprint is looked for once, as long as no more than MOST_LAYOUTS are known."""

    def __init__(self, mappings=MAPPINGS):
        self.mappings, self.by = mappings, {}

    def of(self, record) -> Mapping | None:
        found = paths(record)
        mark = fingerprint(found)
        if len(self.by) > MOST_LAYOUTS:
            self.by.clear()
        if mark not in self.by:
            fits = [m for m in self.mappings if m.needs() <= found]
            self.by[mark] = max(fits, key=lambda m: len(m.needs()), default=None)
        return self.by[mark]


def _whole(value) -> int | None:
    """The 64-bit integer that a value is or is written as, else None."""
    if isinstance(value, str):
        value = int(value) if re.fullmatch(r"[+-]?\d{1,19}", value.strip()) else None
    return value if type(value) is int and -(1 << 63) <= value < 1 << 63 else None


def conversation_id(value) -> int | None:
    if value is None or _whole(value) is not None:
        return _whole(value)
    return int.from_bytes(hashlib.blake2b(_text(value).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each."""
    if mapping.fixed:
        out = []
        for role, fields in mapping.fixed:
            said = [t for t in (_text(record.get(f)) for f in fields) if t]
            if said or any(f in record and f not in mapping.optional for f in fields):
                out.append((role, "\n\n".join(said)))
        return out
    names = dict(mapping.roles)
    each = record.get(mapping.each) if mapping.each else [record]
    out = [(_text(e.get(mapping.role)), _text(e.get(mapping.text))) for e in each or [] if isinstance(e, dict)]
    return [(names.get(r, r), t) for r, t in out]


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's output, and the range of it that bears loss (empty but for the assistant)."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f" {body}{END}", 1, 1 + len(body)
    return f"[ROLE]{escape(role)}[/ROLE][TURN]{body}[/TURN]", 0, 0


def parsed(output: str) -> tuple[str, str]:
    """(role, text) of a turn's output."""
    at = [(m.start(), m.end(), m[2]) for m in _TOKEN.finditer(output) if m[2]]
    kinds = [k for _, _, k in at]
    if kinds == ["[INST]", "[/INST]"]:
        return "user", unescape(output[at[0][1] + 1 : at[1][0] - 1])
    if kinds == [END]:
        return "assistant", unescape(output[1 : at[0][0]])
    if kinds == ["[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]"]:
        return unescape(output[at[0][1] : at[1][0]]), unescape(output[at[2][1] : at[3][0]])
    raise ValueError("not a turn's output")


SCHEMA = "conv_id long, turn long, at int, layout string, output string, loss_from int, loss_to int"


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """One row per turn of JSON records: conv_id, turn, at (place in its record), layout, output, loss_from, loss_to.

    A record without a conversation of its own is one: conv_id is null, or the integer column conv_id if there is one.
    """
    small_batches(records.sparkSession)
    own = F.col("conv_id").cast("long") if "conv_id" in records.columns else F.lit(None).cast("long")

    def run(batches):
        layouts = Layouts()
        for b in batches:
            out = []
            for raw, conv in zip(b["record"].to_pylist(), b["conv_id"].to_pylist()):
                try:
                    record = json.loads(raw) if raw is not None else None
                    mapping = layouts.of(record) if isinstance(record, dict) else None
                except (ValueError, RecursionError):
                    mapping = None
                if mapping is None:
                    out.append((conv, None, 0, None, None, 0, 0))
                    continue
                conv = conversation_id(record[mapping.conversation]) if mapping.conversation else conv
                place = _whole(record[mapping.place]) if mapping.place else None
                out.extend((conv, place, k, mapping.name, *formatted(*t)) for k, t in enumerate(turns(record, mapping)))
            cols = list(zip(*out)) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", "turn", "at", "layout", "output", "loss_from", "loss_to"])

    return records.select(F.col(f"`{column}`").cast("string").alias("record"), own.alias("conv_id")).mapInArrow(run, SCHEMA)


def digests(outputs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from turns' outputs.

    A conversation's output is the begin mark and its turns' outputs. Hashes are sequential, so a conversation is
    read in one task, as a sorted stream; all work on texts was done before, in parallel.
    """

    def run(batches):
        now, state = None, None

        def row():
            turns_, said, n, chars, size = state
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([n], pa.int64()), pa.array([turns_.hexdigest()]), pa.array([chars], pa.int64()), pa.array([said.hexdigest()]), pa.array([size], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for conv, output, lo, hi in zip(*(b[c].to_pylist() for c in ("conv_id", "output", "loss_from", "loss_to"))):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield row()
                    now, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, len(BEGIN)]
                if output is None:
                    continue
                role, text = parsed(output)
                state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                lost = unescape(output[lo:hi])
                state[1].update(lost.encode("utf-8", "surrogatepass"))
                state[2] += 1
                state[3] += len(lost)
                state[4] += len(output)
        if now is not None:
            yield row()

    rows = outputs.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "at", "output")
    return rows.select("conv_id", "output", "loss_from", "loss_to").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The turns' outputs of a table of turn rows (conv_id, turn, role, text)."""
    record = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    return format_records(conversations.select(record.alias("record")))
