"""Conversations as chat-formatted windows of a bounded number of tokens.

The template writes a turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end.  Control strings inside a
text are escaped by one backslash more between their first two characters, so a text can neither open nor close a turn and
comes back exactly.  Prefix sums of the turns' tokens choose the windows: whole turns, as many new ones as fit into the budget behind
the system turn and a limited history.  Repeated turns are never targets, so each assistant text is under the loss mask once.

A conversation is cut into stretches of ``segment`` tokens, at which windows begin anew.  Conversations up to ``HEAVY`` bytes are
formatted as they lie in one sorted partition; the turns of longer ones are dealt by ranges, numbered and summed with one carry per
part, and their stretches are formatted apart.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownat.llm.common import stored
from knownat.llm.encode import encoder

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Bytes of text and turn overhead beyond which a conversation is formatted in stretches.
HEAVY = 1 << 20
#: Rows of an output batch.
ROWS = 256

_INSIDE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT, _ROLE_IN = re.compile(r"[\\\n|]"), re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _INSIDE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return _ROLE_OUT.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], role)


def unescape_role(role: str) -> str:
    return _ROLE_IN.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def turns_of(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    found = []
    for turn in text.split(CLOSE)[:-1]:
        role, body = turn[len(OPEN):].split("\n", 1)
        found.append((unescape_role(role), unescape(body)))
    return found


@dataclass(frozen=True)
class Plan:
    """How windows are chosen: all sizes in tokens; a system turn of more than ``system`` is an ordinary turn."""

    tokenizer: str
    budget: int = 2048
    history: int = 512
    system: int = 1024
    segment: int = 64 * 2048


@dataclass
class Turn:
    number: int
    before: int
    tokens: int
    role: str
    body: str
    fresh: bool = True

    def written(self) -> str:
        return f"{OPEN}{self.role}\n{self.body}{CLOSE}"


@dataclass
class _Walk:
    """The turns of one conversation in order, made into windows; holds one window and one history at most."""

    plan: Plan
    conv_id: object
    system: Turn | None = None
    history: deque[Turn] = field(default_factory=deque)
    window: list[Turn] = field(default_factory=list)
    repeated: list[Turn] = field(default_factory=list)
    room: int = 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        head = turn.number == 0 and turn.role == "system" and turn.tokens <= self.plan.system
        if not turn.fresh:
            if head:
                self.system = turn
            else:
                self.history.append(turn)
            return
        if self.window:
            first = self.window[0]
            same = first.before // self.plan.segment == turn.before // self.plan.segment
            if not same or turn.before + turn.tokens - first.before > self.room:
                yield self.close()
        if not self.window:
            self.open(turn)
        self.window.append(turn)
        if head:
            self.system = turn
        else:
            self.history.append(turn)

    def open(self, turn: Turn) -> None:
        room = self.plan.budget - (self.system.tokens if self.system else 0)
        kept = min(self.plan.history, max(0, room - turn.tokens))
        while self.history and turn.before - self.history[0].before > self.plan.history:
            self.history.popleft()
        repeated = [t for t in self.history if turn.before - t.before <= kept]
        self.room = room - (turn.before - repeated[0].before if repeated else 0)
        self.repeated = ([self.system] if self.system else []) + repeated

    def close(self) -> tuple:
        parts, spans, at, tokens = [], [], 0, 0
        for k, turn in enumerate(chain(self.repeated, self.window)):
            written = turn.written()
            if turn.role == "assistant" and k >= len(self.repeated):
                start = at + len(OPEN) + len(turn.role) + 1
                spans.append({"start": start, "stop": start + len(turn.body)})
            parts.append(written)
            at += len(written)
            tokens += turn.tokens
        row = (self.conv_id, self.window[0].number, len(self.window), len(self.repeated), tokens, "".join(parts), spans)
        self.window = []
        return row

    def end(self) -> Iterator[tuple]:
        if self.window:
            yield self.close()


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
NAMES = ["conv_id", "first_turn", "n_turns", "n_repeated", "n_tokens", "text", "loss"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS]


def _batches(rows: Iterator[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), [key, *KINDS])], NAMES)

    for row in rows:
        held.append(row)
        size += len(row[5])
        if len(held) >= ROWS or size > 1 << 22:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _counted(batch: pa.RecordBatch, tokenizer: str) -> Iterator[tuple]:
    """Key, escaped role and text, and the tokens of each turn with its two control tokens and last line end."""
    roles = [escape_role(r) for r in batch.column("role").to_pylist()]
    bodies = [escape(t) for t in batch.column("text").to_pylist()]
    ids = encoder(tokenizer).encode_all([f"{r}\n{b}" for r, b in zip(roles, bodies)])
    return zip(batch.column("conv_id").to_pylist(), roles, bodies, (len(x) // 4 + 3 for x in ids))


def _light(plan: Plan):
    """Windows of whole conversations that lie in order in their partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        walk, number, before = None, 0, 0
        for batch in batches:
            for conv_id, role, body, tokens in _counted(batch, plan.tokenizer):
                if walk is None or walk.conv_id != conv_id:
                    if walk is not None:
                        yield from walk.end()
                    walk, number, before = _Walk(plan, conv_id), 0, 0
                yield from walk.add(Turn(number, before, tokens, role, body))
                number, before = number + 1, before + tokens
        if walk is not None:
            yield from walk.end()

    return rows


def _stretches(plan: Plan):
    """Windows of stretches: the turns to repeat come before the new ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        walk, now = None, None
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["conv_id"], row["stretch"])
                if walk is None or here != now:
                    if walk is not None:
                        yield from walk.end()
                    walk, now = _Walk(plan, row["conv_id"]), here
                yield from walk.add(Turn(row["number"], row["before"], row["tokens"], row["role"], row["body"], row["fresh"]))
        if walk is not None:
            yield from walk.end()

    return rows


def _numbered(plan: Plan):
    """Turns of a sorted part with their number and the tokens before them inside the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, number, before, started = TaskContext.get().partitionId(), None, 0, 0, False
        for batch in batches:
            numbers, befores, rows = [], [], list(_counted(batch, plan.tokenizer))
            for conv_id, _, _, tokens in rows:
                if not started or conv_id != last:
                    started, last, number, before = True, conv_id, 0, 0
                numbers.append(number)
                befores.append(before)
                number, before = number + 1, before + tokens
            _, roles, bodies, tokens = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({
                "conv_id": batch.column("conv_id"), "part": pa.array([part] * len(rows), pa.int32()),
                "number": pa.array(numbers, pa.int64()), "before": pa.array(befores, pa.int64()),
                "tokens": pa.array(tokens, pa.int64()), "role": pa.array(roles, pa.string()), "body": pa.array(bodies, pa.string())})

    return run


def _heavy_turns(rows: DataFrame, plan: Plan, kind: str) -> DataFrame:
    """Turns of long conversations with the stretch they belong to, and those that a stretch repeats."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_crc")]
    parts = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "role", "text").mapInArrow(
            _numbered(plan), f"conv_id {kind}, part int, number long, before long, tokens long, role string, body string"), "turns")
    # One row per part and conversation: at most as many as there are parts and long conversations together.
    sums = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_size"))
    here = parts.join(carried, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select(
        "conv_id", (F.col("number") + F.col("_n")).alias("number"), (F.col("before") + F.col("_size")).alias("before"), "tokens", "role", "body")
    here = here.withColumn("stretch", F.floor(F.col("before") / plan.segment)).withColumn("fresh", F.lit(True))
    system = (F.col("number") == 0) & (F.col("role") == "system") & (F.col("tokens") <= plan.system)
    again = here.where(
        ~system & (F.col("tokens") <= plan.history) & (F.col("before") >= (F.col("stretch") + 1) * plan.segment - plan.history)
    ).withColumn("stretch", F.col("stretch") + 1).withColumn("fresh", F.lit(False))
    later = here.where("stretch > 0").select(F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch")).distinct()
    heads = here.where(system).join(later, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("stretch", F.col("_stretch")).withColumn(
        "fresh", F.lit(False)).drop("_conv", "_stretch")
    # History of a stretch that has no turn of its own opens no window.
    return here.unionByName(again).unionByName(heads)


def format_windows(conversations: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame | None]:
    """Windows of the short conversations, whose rows lie in order and undivided in their partitions, and of the long ones.

    ``conv_id, first_turn, n_turns, n_repeated, n_tokens, text, loss``: the first ``n_repeated`` turns of ``text`` stand in earlier
    windows, the other ``n_turns`` are new; ``loss`` holds the spans (code points of ``text``) of new assistant texts.

    Turns are ordered by ``turn`` (nulls first), then role, then a checksum of the text, then the text; rows repeated in full are
    turns of their own.  Null texts and roles are empty, null ids are one conversation.  A turn that does not fit into the budget
    by itself is a window of its own behind the system turn, whole and without history.  Other columns are not read.  The second
    table is None where no conversation is long; finding that out runs a job.
    """
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text") + 32).alias("_size"))
    heavy = stored(sizes.where(F.col("_size") > HEAVY).select(F.col("conv_id").alias("_heavy"), F.lit(1).alias("_mark")), "long-conversations")
    rows = rows.withColumn("_crc", F.crc32(F.col("text").cast("binary")))
    is_heavy = F.col("conv_id").eqNullSafe(F.col("_heavy"))
    schema = T.StructType([
        T.StructField("conv_id", kind), *(T.StructField(n, T.LongType()) for n in NAMES[1:5]), T.StructField("text", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))])
    some = not heavy.isEmpty()

    def windows(maker):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None:
                yield from _batches(maker(chain([first], batches)), first.schema.field("conv_id").type)

        return run

    light = (rows.join(heavy, is_heavy, "left_anti") if some else rows).repartition("conv_id").sortWithinPartitions(
        *(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_crc", "text")))
    short = light.select("conv_id", "role", "text").mapInArrow(windows(_light(plan)), schema)
    if not some:
        return short, None
    turns = _heavy_turns(rows.join(heavy, is_heavy, "left_semi"), plan, kind.simpleString())
    dealt = turns.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "number")
    return short, dealt.mapInArrow(windows(_stretches(plan)), schema)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from its windows; they must lie in order and undivided in their partitions.

    Digests take one text after the other, so no conversation is held whole; a digest of one conversation is one task's work.
    """
    kind = windows.schema["conv_id"].dataType
    fields = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, started, n, chars, size, turns, loss = None, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        key = None
        for batch in batches:
            key = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if not started or row["conv_id"] != now:
                    if started:
                        done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    now, started, n, chars, size, turns, loss = row["conv_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = row["text"]
                for role, body in turns_of(text)[row["n_repeated"]:]:
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for span in row["loss"]:
                    target = unescape(text[span["start"]:span["stop"]])
                    loss.update(target.encode())
                    chars += len(target)
                size += len(text)
            if len(done) >= 4096:
                yield _digests(done, key)
                done = []
        if started:
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
            yield _digests(done, key)

    def _digests(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["conv_id", *fields])

    schema = T.StructType([T.StructField("conv_id", kind), *(
        T.StructField(f, T.StringType() if f.endswith("sha256") else T.LongType()) for f in fields)])
    return windows.select("conv_id", "n_repeated", "text", "loss").mapInArrow(run, schema)


def conversation_digests(conversations: DataFrame, plan: Plan) -> DataFrame:
    """Format all conversations, then read each one's turns and targets back from its windows."""
    short, long = format_windows(conversations, plan)
    found = read_back(short)
    if long is None:
        return found
    ordered = long.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "first_turn")
    return found.unionByName(read_back(ordered))
