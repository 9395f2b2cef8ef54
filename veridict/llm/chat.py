"""Minimum-cost repair of conversation roles, and their rendering.

A legal conversation is an optional system turn followed by user and assistant
turns in alternation, the first by the user and the last by the assistant.
For each source turn a dynamic program over the last role written chooses to
keep the turn's role, to give it another (relabel), to append its text to the
turn before it (merge), or to write an empty turn first (insert), so that the
sum of costs over the conversation is the least that makes it legal.

The program walks a conversation in turn order and keeps back-pointers only
until all surviving paths agree; what they agree on is written at once.  So a
conversation of any length needs little memory, and no conversation is ever
gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE, INSERT, RELABEL = 1, 2, 3
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
#: What may follow what; None is the beginning.
FOLLOWS = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Turns between two attempts to find where all paths agree.
FLUSH_EVERY = 128
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _between(last: str | None, role: str) -> str | None:
    """The empty turn that makes ``role`` legal after ``last``, if one does."""
    return next((x for x in FOLLOWS[last] if role in FOLLOWS[x]), None)


def _steps() -> dict[str | None, list[tuple[str, int, str, str | None]]]:
    """For each last role: (role written, cost, kind, role inserted first)."""
    out: dict = {}
    for last in (None, *ROLES):
        out[last] = []
        for role in ROLES:
            if role in FOLLOWS[last]:
                out[last].append((role, 0, "direct", None))
            elif role == last:
                out[last].append((role, MERGE, "merge", None))
            if role not in FOLLOWS[last] and (empty := _between(last, role)):
                out[last].append((role, INSERT, "insert", empty))
    return out


_STEPS = _steps()
#: Empty turns that end a conversation after each last role.
_ENDS = {"assistant": (), "user": ("assistant",), "system": ("user", "assistant"), None: ()}


def canonical_role(role: str | None) -> str | None:
    """Trimmed, lower-case role with aliases resolved; None if it is no known role."""
    role = (role or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in ROLES else None


class Repair:
    """The dynamic program of one conversation.

    ``add`` takes the next turn's role and returns decisions that are now
    certain; ``finish`` returns the rest and the empty turns at the end.  A
    decision is (role written, kind, inserted role, cost).
    """

    def __init__(self) -> None:
        self.costs: dict[str | None, int] = {None: 0}
        self.pending: list[dict] = []

    def add(self, role: str | None) -> list[tuple]:
        role, costs, back = canonical_role(role), {}, {}
        for last, so_far in self.costs.items():
            for to, cost, kind, empty in _STEPS[last]:
                cost += 0 if to == role else RELABEL
                if to not in costs or so_far + cost < costs[to]:
                    costs[to] = so_far + cost
                    back[to] = (last, kind, empty, cost, to != role)
        self.costs = costs
        self.pending.append(back)
        return self._certain() if len(self.pending) % FLUSH_EVERY == 0 else []

    def _trace(self, state: str | None, count: int) -> list[tuple]:
        out = []
        for back in reversed(self.pending[:count]):
            last, kind, empty, cost, relabel = back[state]
            out.append((state, "relabel" if relabel and kind == "direct" else kind, empty, cost))
            state = last
        return out[::-1]

    def _certain(self) -> list[tuple]:
        alive = set(self.costs)
        for at in range(len(self.pending) - 1, -1, -1):
            alive = {self.pending[at][s][0] for s in alive}
            if len(alive) == 1 and at:
                out = self._trace(alive.pop(), at)
                self.pending = self.pending[at:]
                return out
        return []

    def finish(self) -> tuple[list[tuple], tuple[str, ...]]:
        order = ("assistant", "user", "system", None)
        last = min((s for s in order if s in self.costs), key=lambda s: self.costs[s] + INSERT * len(_ENDS[s]))
        return self._trace(last, len(self.pending)), _ENDS[last]


def _plain(text: str | None) -> str:
    """Text that can't be read as a tag."""
    return (text or "").replace("<|", "< |")


class _Conversation:
    """Turns of one conversation that wait for their decision, and what was written."""

    def __init__(self, key) -> None:
        self.key, self.repair, self.turns, self.position = key, Repair(), [], 0

    def write(self, decisions: list[tuple]) -> list[tuple]:
        out = []
        for (turn, role, text), (to, kind, empty, cost) in zip(self.turns, decisions, strict=False):
            piece = ""
            if kind != "merge":
                piece = CLOSE if self.position else ""
                if empty:
                    piece += OPEN.format(empty) + CLOSE
                self.position += 1 + bool(empty)
                piece += OPEN.format(to)
            else:
                piece = JOINT
            relabelled = to != canonical_role(role)
            out.append([self.key, turn, self.position - 1, to, kind, empty, relabelled, cost, piece + _plain(text)])
        del self.turns[: len(decisions)]
        return out

    def close(self) -> list[list]:
        decisions, ends = self.repair.finish()
        out = self.write(decisions)
        if out:
            out[-1][-1] += CLOSE + "".join(OPEN.format(x) + CLOSE for x in ends)
            out[-1][-2] += INSERT * len(ends)
        return out


_FIELDS = (
    "conv_id {key}, turn {turn}, position bigint, role string, action string, inserted string, "
    "relabelled boolean, cost bigint, piece string"
)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired and rendered turns, a row for each source turn.

    Columns: conv_id, turn (as given), position (of the written turn in its
    conversation, from 0), role (written), action (direct, relabel, merge or
    insert), inserted (role of the empty turn written before, or null),
    relabelled, cost, and piece.  A conversation's rendering is its pieces
    joined in the order (turn, role, text); the last row's piece and cost hold
    the empty turns that end it.

    Turns are taken in the order of (turn, role, text), nulls first, so ties
    and repeated rows have a fixed result.  A null conversation id is a
    conversation of its own; a null or unknown role must be relabelled; a null
    text is empty; ``<|`` in a text is written ``< |``.  Further columns are
    ignored.  An empty table gives no rows.
    """
    slim = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    types = dict(slim.dtypes)
    schema = _FIELDS.format(key=types["conv_id"], turn=types["turn"])
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        arrow = None
        for batch in batches:
            if arrow is None:
                key, number = batch.schema.field("conv_id").type, batch.schema.field("turn").type
                arrow = pa.schema(
                    zip(names, [key, number, pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()], strict=True)
                )
            done: list[list] = []
            for k, n, r, t in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if current is None or current.key != k:
                    if current is not None:
                        done += current.close()
                    current = _Conversation(k)
                current.turns.append((n, r, t))
                done += current.write(current.repair.add(r))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow, strict=True)], schema=arrow)
        if current is not None and (done := current.close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow, strict=True)], schema=arrow)

    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's repaired, rendered turns."""
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
