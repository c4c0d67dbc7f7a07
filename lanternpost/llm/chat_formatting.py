"""Chat formatting by event-sourced reconstruction.

Events (conv, seq, kind, turn, role, text) are folded turn by turn: ``start`` opens a turn with its role and
text, ``delta`` adds text to it, ``edit`` replaces its text and ``regenerate`` empties it; both of these drop
all later turns opened before them.  A turn opened again starts anew.  A turn is left if none of the turns
before it was edited or regenerated after its last start; its text is that of its last start, edit or
regeneration and of the deltas after it.  Deltas and edits of a turn that is not open add nothing.  Turns are
ordered by their numbers.  Messages are rendered with turn marks; control strings inside texts are broken up by
a backslash after their first character, more by one than the text had, so that it can be undone.

The result is one row per turn, with its place in the formatted conversation, so a conversation of any size is
spread over tasks; only one turn has to fit into a row.

Null texts and roles are empty.  Equal sequence numbers are sorted by turn, kind, role and text; a null one
comes first, and so does a null turn number.  A null conversation id is one conversation.  Other kinds are
ignored.  Conversations without an open turn give one empty row without a turn number.  An empty table gives no
rows.  Repeated deltas add their text each time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import with_range
from ..sources import storage
from .helpers import blocks

START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Strings that a tokenizer or template may take as control.
CONTROL = [OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
PLAIN = re.compile("|".join(rf"(?:{re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in CONTROL))
TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.DOTALL)
LEARNED_ROLE = "assistant"

EVENTS = "conv long, seq long, kind string, turn long, role string, text string"


def escape(text: str) -> str:
    return PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return PLAIN.sub(lambda m: m[0][:-1] if m[0][-1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A formatted turn, and its code-point span under the loss mask if it is the assistant's."""
    head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{CLOSE}\n", (len(head), len(head) + len(body)) if role == LEARNED_ROLE else None


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) read back from a formatted text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


class Reader:
    """Reads turns back from a formatted conversation that comes in pieces, cut anywhere."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self.rest, at = self.rest + piece, 0
        for m in TURN.finditer(self.rest):
            at = m.end()
            yield unescape_role(m[1]), unescape(m[2])
        self.rest = self.rest[at:]


def _before(rows: DataFrame, value: str, into: str, agg: Callable[..., Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """``agg`` of ``value`` over the earlier turns of each conversation, for rows unique per (conv, turn).

    Ranges of turn numbers are aggregated first, so that one long conversation is many tasks."""
    ranged = with_range(rows, "turn", "range")
    totals = ranged.groupBy("conv", "range").agg(agg(value).alias("total"))
    ranges_before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", "range", agg("total").over(ranges_before).alias("far"))
    turns_before = Window.partitionBy("conv", "range").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.withColumn("near", agg(value).over(turns_before))
    return near.join(offsets, ["conv", "range"]).select(*rows.columns, both(F.col("far"), F.col("near")).alias(into))


def fold(events: DataFrame) -> DataFrame:
    """(conv, turn, role, text) of the turns that are left after all ``events``; conv is a struct of the id.

    In a struct also a null id is equal to itself."""
    resets = events.where(F.col("kind") != DELTA)
    starts = F.max(F.when(F.col("kind") == START, F.struct("seq", "role"))).alias("start")
    cuts = F.max(F.when(F.col("kind") != START, F.col("seq"))).alias("cut")
    turns = resets.groupBy("conv", "turn").agg(starts, cuts, F.max(F.struct("seq", "kind", "role", "text")).alias("reset"))
    base = F.when(F.col("reset.kind") == REGENERATE, "").otherwise(F.col("reset.text"))
    turns = storage.stored(turns.select("conv", "turn", "start", "cut", F.col("reset.seq").alias("since"), base.alias("base")), "turns")
    placed = _before(turns.drop("base"), "cut", "cut_before", F.max, F.greatest)
    left = placed.where("start IS NOT NULL AND (cut_before IS NULL OR cut_before <= start.seq)")
    left = storage.stored(left.select("conv", "turn", "start.role", "since"), "left-turns")
    # Of equal sequence numbers a delta comes before what resets its turn.
    later = events.where(F.col("kind") == DELTA).select("conv", "turn", "seq", F.col("role").alias("by"), "text")
    later = later.join(left.select("conv", "turn", "since"), ["conv", "turn"]).where("seq > since")
    parts = F.sort_array(F.collect_list(F.struct("seq", "by", "text")))
    added = later.groupBy("conv", "turn").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("added"))
    whole = left.join(turns.select("conv", "turn", "base"), ["conv", "turn"]).join(added, ["conv", "turn"], "left")
    return whole.select("conv", "turn", "role", F.concat("base", F.coalesce("added", F.lit(""))).alias("text"))


def format_turns(events: DataFrame) -> DataFrame:
    """(conv, turn, piece, start, loss_start, loss_end): formatted turns of conversations of EVENTS.

    The pieces of a conversation, joined in order of their turns, are its formatted text; ``start`` is the
    place of the piece in it and the loss span (null: no loss) is counted in it too, in code points."""
    first = F.lit(-(1 << 63)).cast("long")
    known = events.select(
        F.struct("conv").alias("conv"),
        F.coalesce("seq", first).alias("seq"),
        F.coalesce("turn", first).alias("turn"),
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    known = storage.stored(known, "events")
    folded = fold(known.where(F.col("kind").isin(START, DELTA, EDIT, REGENERATE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                done = [render(r, t) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                spans = [d[1] or (None, None) for d in done]
                made = [
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([len(d[0]) for d in done], pa.int64()),
                    pa.array([s[0] for s in spans], pa.int64()),
                    pa.array([s[1] for s in spans], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("turn"), *made], names=["conv", "turn", "piece", "chars", "from", "to"])

    id_type = folded.schema["conv"].dataType.simpleString()
    pieces = storage.stored(folded.mapInArrow(run, f"conv {id_type}, turn long, piece string, chars long, `from` long, `to` long"), "pieces")
    none = F.lit(0).cast("long")
    placed = _before(pieces, "chars", "start", F.sum, lambda far, near: F.coalesce(far, none) + F.coalesce(near, none))
    spans = [(F.col("start") + F.col(c)).alias(f"loss_{n}") for c, n in (("from", "start"), ("to", "end"))]
    placed = placed.select("conv.conv", "turn", "piece", "start", *spans)
    bare = storage.stored(known.select("conv").distinct().join(pieces.select("conv").distinct(), "conv", "left_anti"), "bare")
    storage.discard(known)
    no_place = F.lit(None).cast("long")
    return placed.unionByName(bare.select("conv.conv", no_place.alias("turn"), F.lit("").alias("piece"), none.alias("start"), no_place.alias("loss_start"), no_place.alias("loss_end")))


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of the conversations of ``format_turns``, parsed from their formatted text.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).  The pieces of a conversation pass
    one task in order as a stream; not more than a block of them is held."""
    id_type = pieces.schema["conv"].dataType.simpleString()
    out = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def closed(states: list[dict], ids: pa.DataType) -> pa.RecordBatch:
            rows = [(s["n"], s["turns"].hexdigest(), s["learned"], s["loss"].hexdigest(), s["size"]) for s in states]
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), out.types)]
            return pa.RecordBatch.from_arrays([pa.array([s["conv"] for s in states], ids), *columns], names=["conv", *out.names])

        ids = None
        for batch in batches:
            ids, done = batch.schema.field("conv").type, []
            for part in blocks(batch, "piece"):
                for conv, piece, a, b in zip(*(part.column(c).to_pylist() for c in ("conv", "piece", "loss_start", "loss_end"))):
                    if state is None or state["conv"] != conv:
                        done += [state] if state else []
                        state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "learned": 0, "loss": hashlib.sha256(), "size": 0, "reader": Reader()}
                    for role, text in state["reader"].feed(piece):
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{text}\n".encode())
                    if a is not None:
                        said = unescape(piece[a - state["size"] : b - state["size"]])
                        state["learned"] += len(said)
                        state["loss"].update(said.encode())
                    state["size"] += len(piece)
            if done:
                yield closed(done, ids)
        if state:
            yield closed([state], ids)

    streams = pieces.select("conv", "turn", "piece", "loss_start", "loss_end").repartition("conv").sortWithinPartitions("conv", "turn")
    return streams.mapInArrow(run, f"conv {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def events_of_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The log of a chat that ends with the given turns, ordered by turn, role and text.

    A user's turn is written wrongly, answered, and edited, which drops the answer; all other turns are
    streamed, regenerated and streamed again in two deltas.  The turns are numbered from 1 by ranges, so that
    one long conversation is many tasks; ranges are cut at turn, role and the start of the text."""
    named = rows.select(F.struct(F.col(conv).alias("conv")).alias("conv"), F.col(turn).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    ranged = with_range(named.withColumn("key", F.struct("at", "role", F.substring("text", 1, 64).alias("text"))), "key", "range")
    counts = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    near = F.row_number().over(Window.partitionBy("conv", "range").orderBy("at", "role", "text"))
    numbered = ranged.withColumn("near", near).join(offsets, ["conv", "range"])
    numbered = numbered.select("conv.conv", (F.col("before") + F.col("near")).alias("turn"), "role", "text")
    none, half = F.lit(None).cast("string"), (F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def event(step: int, kind: str, said: Column = none, ahead: int = 0, by: Column = none) -> Column:
        place = [(F.col("turn") * 8 + step).alias("seq"), F.lit(kind).alias("kind"), (F.col("turn") + ahead).alias("turn")]
        return F.struct(*place, by.alias("role"), said.alias("text"))

    opened = event(0, START, by=F.col("role"))
    edited = [opened, event(1, DELTA, second), event(2, START, F.lit("dropped"), 1, F.lit(LEARNED_ROLE)), event(3, DELTA, F.lit(" too"), 1), event(4, EDIT, F.col("text"))]
    streamed = [opened, event(1, DELTA, second), event(2, REGENERATE), event(3, DELTA, first), event(4, DELTA, second)]
    log = F.when(F.col("role") == "user", F.array(*edited)).otherwise(F.array(*streamed))
    return numbered.select("conv", F.explode(log).alias("e")).select("conv", "e.seq", "e.kind", "e.turn", "e.role", "e.text")
