"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

A template says how each role's turn is marked, which turns may follow which, and which roles count
for the loss. Turns come out as segments of text with a loss flag each. Control strings of the
template inside a text are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role -> (before, after) a text. other: (before role, between role and text, after) for roles
    without marks. follows: state -> role -> next state, from "start"; ends: states a conversation may
    end in. loss: roles whose texts count. escape: a character that no control string holds."""

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("[TURN]", "[:]", "[/TURN]")
    follows: dict = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"},
        }
    )
    ends: tuple = ("answered",)
    loss: tuple = ("assistant",)
    escape: str = "␛"

    def controls(self) -> list[str]:
        return [*(m for pair in self.marks.values() for m in pair), *self.other]


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        controls = template.controls()
        if any(template.escape in c or not c for c in controls) or len(set(controls)) != len(controls):
            raise ValueError("control strings must differ and not hold the escape character")
        e = template.escape
        self.code = {c: f"{e}{k:x};" for k, c in enumerate([e, *controls])}
        self.back = {v: k for k, v in self.code.items()}
        longest = sorted(self.code, key=len, reverse=True)
        self.find = re.compile("|".join(map(re.escape, longest)))
        self.found = re.compile(re.escape(e) + "[0-9a-f]+;")
        self.control = re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True))))
        self.role_of = {before: (role, after) for role, (before, after) in template.marks.items()}

    def quote(self, text: str) -> str:
        return self.find.sub(lambda m: self.code[m[0]], text)

    def unquote(self, text: str) -> str:
        return self.found.sub(lambda m: self.back[m[0]], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, counts for the loss) pieces of one turn."""
        t = self.template
        if role in t.marks:
            before, after = t.marks[role]
        else:
            before, after = t.other[0] + self.quote(role) + t.other[1], t.other[2]
        return [(before, False), (self.quote(text), role in t.loss), (after, False)]

    def step(self, state: str | None, role: str) -> str | None:
        """Next state of the machine; None, for good, once a turn is out of order."""
        return self.template.follows.get(state, {}).get(role) if state is not None else None

    def read(self, turn: str) -> tuple[str, str]:
        """(role, text) of a formatted turn."""
        first = self.control.match(turn)
        if not first:
            raise ValueError("no turn begins here")
        rest = turn[first.end() :]
        if first[0] in self.role_of:
            role, after = self.role_of[first[0]]
        else:
            name, between, rest = rest.partition(self.template.other[1])
            role, after = self.unquote(name), self.template.other[2]
        if not rest.endswith(after) or (found := self.control.search(rest)) is None or found.end() != len(rest):
            raise ValueError("a turn is not closed where it should be")
        return role, self.unquote(rest[: len(rest) - len(after)])


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn, in order inside each conversation and partition: conv_id, seq (from 0), state
    (of the machine after the turn; null once the order is broken), segments array<struct<text, loss>>.

    Rows are ordered by turn, then role and text (null turns first). Null roles and texts are empty.
    Rows with a null conv_id are one conversation. A conversation streams through one task in order,
    a batch at a time; nothing of it is collected. Repeated rows are turns of their own. Very long texts are formatted
    whole; an empty table gives an empty result; columns beside the four named ones are ignored.
    """
    form = Formatter(template or Template())
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        conv, seq, state, first = None, 0, "start", True
        for b in batches:
            seqs, states, parts = [], [], []
            convs = b.column("conv_id").to_pylist()
            for c, role, text in zip(convs, b.column("role").to_pylist(), b.column("text").to_pylist()):
                if first or c != conv:
                    conv, seq, state, first = c, 0, "start", False
                state = form.step(state, role)
                seqs.append(seq)
                states.append(state)
                parts.append([{"text": t, "loss": x} for t, x in form.segments(role, text)])
                seq += 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(seqs, pa.int64()), pa.array(states, pa.string()), pa.array(parts, kind)], ["conv_id", "seq", "state", "segments"])

    return ordered.mapInArrow(run, "conv_id long, seq long, state string, segments array<struct<text:string,loss:boolean>>")


def read_back(turns: DataFrame, template: Template | None = None, ordered: bool = False) -> DataFrame:
    """One row per conversation from the segments of :func:`format_turns` alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid (the order of roles is the template's).

    Texts are hashed as they stream by; the digests of a conversation need its turns in order. They are
    brought into it here unless they are ``ordered``, straight from :func:`format_turns`. ValueError where a
    turn is missing or out of place. An empty table gives an empty result."""
    form = Formatter(template or Template())
    if not ordered:
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches):
        current, state = None, None

        def done():
            n, turns_hash, chars, loss_hash, formatted, machine = state
            return current[0], n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), formatted, machine in form.template.ends

        for b in batches:
            rows = []
            for c, seq, machine, segments in zip(*(b.column(n).to_pylist() for n in ("conv_id", "seq", "state", "segments"))):
                if current is None or c != current[0]:
                    if current is not None:
                        rows.append(done())
                    current, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                if seq != state[0]:
                    raise ValueError(f"turn {seq} of conversation {c} comes where {state[0]} should")
                turn = "".join(s["text"] for s in segments)
                role, text = form.read(turn)
                under = form.unquote("".join(s["text"] for s in segments if s["loss"]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(turn)
                state[5] = machine
            if rows:
                yield _summary(rows)
        if current is not None:
            yield _summary([done()])

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def _summary(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
