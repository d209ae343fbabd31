"""Transcript parsing: a hidden Markov model over lines recovers roles, turns are rendered canonically.

A conversation is a sequence of rows, a row a sequence of lines. Hidden states are the roles.
A line shows a speaker marker (the row's role field at its first line, or a name before a colon;
many spellings are known) and features: whether it asks, how long it is, whether it is a list or
code. Features' and turn changes' probabilities are counted over all rows whose role is known.
Viterbi finds each conversation's likeliest roles, so rows without a usable marker get the role
that their neighbours and their lines suggest, and a marker inside a row starts a turn of its own.

Rows are put in order by a range shuffle and cut into chunks of `chunk_rows`. A conversation over
several chunks is decoded exactly: each piece yields the best score from any role before it to any
role at its end, a table of 16 numbers; these tables, one row per piece, are solved first, and
then every piece is decoded between its two ends. No task ever holds a long conversation.

Defined results: a null text is empty and yields one turn; null and unknown roles count as no
marker; null turns come first, equal turns keep the table's order; rows of null conversation are
one conversation; repeated rows are turns of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import row_id, staged, text_of

ROLES = ("system", "user", "assistant", "tool")
ALIASES = {
    "system": ("system", "sys", "instruction", "instructions", "developer"),
    "user": ("user", "human", "prompter", "customer", "client", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "agent", "answer", "a"),
    "tool": ("tool", "function", "observation", "tool_result"),
}
ROLE_OF = {alias: i for i, role in enumerate(ROLES) for alias in ALIASES[role]}
MARKER = re.compile(r"[\s#>*_\[(<|-]*(" + "|".join(sorted(ROLE_OF, key=len, reverse=True))
                    + r")[\s*_\])>|]*[:：][\s*_]*", re.IGNORECASE)
TRUST, STAY = 0.97, 0.98
FEATURES = 12
CHUNK_ROWS = 2_048


def _feature(line: str) -> int:
    asks = line.rstrip().endswith(("?", "？"))
    size = 0 if len(line) < 40 else 1 if len(line) < 160 else 2
    return size + 3 * asks + 6 * line.lstrip().startswith(("-", "*", "•", "    ", "```", "1."))


def _role(name: str | None) -> int:
    return ROLE_OF.get((name or "").strip().lower(), -1)


def lines_of(role: str | None, text: str) -> list[tuple[str, list[int], int]]:
    """Per line: its text without marker, the roles its markers name, its feature."""
    out = []
    for i, line in enumerate(text.split("\n")):
        named = [_role(role)] if not i and _role(role) >= 0 else []
        if m := MARKER.match(line):
            named.append(ROLE_OF[m[1].lower()])
            line = line[m.end() :]
        out.append((line, named, _feature(line)))
    return out


def learn(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probabilities: first roles, changes of role between rows, features by role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(ROLES), FEATURES), np.int64)
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (r := _role(role)) >= 0:
                    for _, _, f in lines_of(None, text):
                        seen[r, f] += 1
        r, f = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(f), pa.array(seen[r, f])], ["role", "feature", "n"])

    def table(shape: tuple, found: list) -> np.ndarray:
        counts = np.ones(shape)
        for *at, n in found:
            counts[tuple(at)] += n
        return np.log(counts / counts.sum(-1, keepdims=True))

    lines = rows.select("role", "text").mapInArrow(run, "role long, feature long, n long")
    known = rows.select("conv", "turn", F.try_element_at(
        F.create_map(*[F.lit(x) for kv in ROLE_OF.items() for x in kv]), F.lower(F.trim("role"))).alias("r")
    ).where("r is not null").groupBy("conv", "turn", "r").agg(F.count("*").alias("n"))
    after = known.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("s"), F.col("n").alias("m"))
    steps = known.join(after, ["conv", "turn"]).groupBy("r", "s").agg(F.sum(F.col("n") * F.col("m")))
    first = known.groupBy("conv").agg(F.min(F.struct("turn", "r")).alias("f")).groupBy("f.r").agg(F.count("*"))
    k = len(ROLES)
    return (table((k,), first.collect()), table((k, k), steps.collect()),  # k and k * k rows
            table((k, FEATURES), lines.groupBy("role", "feature").agg(F.sum("n")).collect()))


class Hmm:
    """Viterbi over the lines of a run of rows."""

    def __init__(self, start: np.ndarray, change: np.ndarray, feature: np.ndarray):
        k = len(ROLES)
        self.start, self.change, self.feature = start, change, feature
        self.stay = np.log(np.where(np.eye(k), STAY, (1 - STAY) / (k - 1)))
        self.named = np.log(np.where(np.eye(k), TRUST, (1 - TRUST) / (k - 1)))

    def steps(self, rows: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lines in rows:
            for i, (_, named, feature) in enumerate(lines):
                emit = self.feature[:, feature] + sum(self.named[n] for n in named)
                yield (self.stay if i and not named else self.change), emit

    def transfer(self, rows: list, first: bool) -> np.ndarray:
        """Best scores from each role before the rows to each role at their end."""
        k = len(ROLES)
        best = None
        for trans, emit in self.steps(rows):
            if best is None:
                best = (np.tile(self.start, (k, 1)) if first else trans) + emit
            else:
                best = (best[:, :, None] + trans[None]).max(1) + emit
        return best

    def decode(self, rows: list, enter: int | None = None, leave: int | None = None) -> list[int]:
        """The likeliest role of each line, after role `enter` and ending in role `leave`, if given."""
        score, back = None, []
        for trans, emit in self.steps(rows):
            if score is None:
                score = (self.start if enter is None else trans[enter]) + emit
            else:
                ways = score[:, None] + trans
                back.append(ways.argmax(0))
                score = ways.max(0) + emit
        state = int(score.argmax()) if leave is None else leave
        path = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            path.append(state)
        return path[::-1]


def solve(pieces: pd.DataFrame) -> pd.DataFrame:
    """Roles at the ends of one conversation's pieces, from their transfer tables."""
    pieces = pieces.sort_values("chunk")
    k = len(ROLES)
    tables = [np.array(t).reshape(k, k) for t in pieces.table]
    score, back = tables[0][0], []
    for t in tables[1:]:
        ways = score[:, None] + t
        back.append(ways.argmax(0))
        score = ways.max(0)
    leave = [int(score.argmax())]
    for pointers in reversed(back):
        leave.append(int(pointers[leave[-1]]))
    leave = leave[::-1]
    return pd.DataFrame({"conv": pieces.conv.to_numpy(), "chunk": pieces.chunk.to_numpy(),
                         "enter": [-1, *leave[:-1]], "leave": leave})


def render(role: str, text: str) -> str:
    """One canonical turn; a turn's own control marks are spelled apart."""
    text = text.replace("<|im_start|>", "<| im_start |>").replace("<|im_end|>", "<| im_end |>")
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def in_order(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """rows in order of conversation and turn, with `chunk` (a run of at most chunk_rows rows) and `seq`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            at = np.arange(seq, seq + batch.num_rows)
            seq += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((part << 32) + at // chunk_rows), pa.array(at)],
                [*batch.schema.names, "chunk", "seq"])

    order = ["conv", "turn", "row_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(
        run, "conv long, turn long, row_id long, role string, text string, chunk long, seq long"), "lines")


def parse(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv, turn, row_id, part, role, content, rendered): the canonical turns of each row, in order."""
    rows = in_order(conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        row_id().alias("row_id"), F.col(role_col).cast("string").alias("role"), text_of(text_col).alias("text")),
        chunk_rows)
    model = Hmm(*learn(rows))
    many = rows.select("conv", "chunk").distinct().groupBy("conv").agg(
        F.count("*").alias("n"), F.min("chunk").alias("first_chunk")).where("n > 1").select(
        F.col("conv").alias("many_conv"), "first_chunk")

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for conv, g in pdf.sort_values("seq").groupby("conv", sort=False, dropna=False):
            chunk = int(g.chunk.iloc[0])
            t = model.transfer([lines_of(r, x) for r, x in zip(g.role, g.text)], chunk == int(g.first_chunk.iloc[0]))
            out.append((conv, chunk, t.ravel().tolist()))
        return pd.DataFrame(out, columns=["conv", "chunk", "table"]).astype({"conv": "Int64"})

    ends = (
        rows.join(many, F.col("conv").eqNullSafe(F.col("many_conv")))
        .groupBy("chunk").applyInPandas(tables, "conv long, chunk long, table array<double>")
        .groupBy("conv").applyInPandas(solve, "conv long, chunk long, enter int, leave int")
    )

    def turns(pdf: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        held = {None if pd.isna(c) else int(c): (e if e >= 0 else None, x)
                for c, e, x in zip(between.conv, between.enter, between.leave)}
        out = []
        for conv, g in pdf.sort_values("seq").groupby("conv", sort=False, dropna=False):
            conv = None if pd.isna(conv) else int(conv)
            parsed = [lines_of(r, x) for r, x in zip(g.role, g.text)]
            path = iter(model.decode(parsed, *held.get(conv, (None, None))))
            for turn, place, lines in zip(g.turn, g.row_id, parsed):
                parts: list[list] = []
                for line, named, _ in lines:
                    state = next(path)
                    if parts and parts[-1][0] == state:
                        parts[-1][1].append(line)
                    else:
                        parts.append([state, [line]])
                for i, (state, body) in enumerate(parts):
                    text = "\n".join(body)
                    out.append((conv, turn, place, i, ROLES[state], text, render(ROLES[state], text)))
        done = pd.DataFrame(out, columns=["conv", "turn", "row_id", "part", "role", "content", "rendered"])
        return done.astype({"conv": "Int64", "turn": "Int64"})

    return rows.groupBy("chunk").cogroup(ends.groupBy("chunk")).applyInPandas(
        turns, "conv long, turn long, row_id long, part int, role string, content string, rendered string")
