"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is plain text in which speakers are marked one way or another, or now and then not at all. Each line is in one
of six states: a role's first line or a later one. Lines are observed through features: the kind of speaker marker they
begin with, whether a blank line stands before, their length, how they begin and end. Starts, transitions and emissions are
counted on a bounded sample of transcripts whose turns are known, with add-one smoothing; Viterbi finds the likeliest states,
and each first line opens a turn. Canonical turns are <|role|>, the text without its marker, and <|end|>, line by line.

Null and empty transcripts have no turns and render as the empty text. A very long transcript is decoded whole, in memory in
proportion to its lines. Tables without rows give none (and train a model of the smoothing alone); further columns of
turns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import map_arrow

ROLES = ("system", "user", "assistant")
#: How speakers are marked, in the order of ROLES.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM> ", "Human> ", "AI> "),
    ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
    ("[system] ", "Q: ", "A: "),
    ("**System**: ", "**Customer**: ", "**Agent**: "),
)
MARKERS = (
    re.compile(r"^[\W_]*(?:system|context|instructions? for the model)[\W_]*[:>\]|*](?:[*|>]*\s*)", re.IGNORECASE),
    re.compile(r"^[\W_]*(?:user|human|customer|prompter|instruction|question|q|me)[\W_]*[:>\]|*](?:[*|>]*\s*)", re.IGNORECASE),
    re.compile(r"^[\W_]*(?:assistant|ai|agent|bot|model|response|answer|a|gpt)[\W_]*[:>\]|*](?:[*|>]*\s*)", re.IGNORECASE),
)
#: Turns of a conversation in one transcript.
PART = 64
STATES = len(ROLES) * 2


def transcripts(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, roles, pieces, text): the turns of a conversation, `part` turn numbers at a time, as a transcript in one of STYLES, with every eighth marker left out.

    turns: (conv_id, turn, role, text). Repeated rows count once; turns with the same number go by role and text. Null
    texts are empty, null turn numbers count as 0, and null or unknown roles as user. Conversations without id make one.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    rows = turns.select("conv_id", F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(len(STYLES)))
    marks = F.array(*(F.array(*map(F.lit, s)) for s in STYLES))
    mark = F.get(F.get(marks, style.cast("int")), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1)
    bare = F.pmod(F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).cast("binary")), F.lit(8)) == 0
    piece = F.concat(F.when(bare, F.lit("\n")).otherwise(mark), F.col("text"))
    grouped = rows.groupBy("conv_id", F.floor(F.col("turn") / part).alias("part")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", piece.alias("piece")))).alias("t"))
    pieces = F.transform("t", lambda x: x["piece"])
    return grouped.select("conv_id", "part", F.transform("t", lambda x: x["role"]).alias("roles"), pieces.alias("pieces"), F.array_join(pieces, "\n").alias("text"))


def observe(lines: list[str]) -> np.ndarray:
    """One row of small integers for each line, the values of its features."""
    out, blank, ended = np.zeros((len(lines), 6), np.int64), True, 1
    for k, line in enumerate(lines):
        text = line.strip()
        marker = next((i + 1 for i, m in enumerate(MARKERS) if m.match(line)), 0)
        first = text[:1]
        end = 0 if not text else 1 if text[-1] == "?" else 2 if text[-1] in ".!" else 3
        out[k] = (
            marker,
            blank and k > 0,
            min(4, len(text).bit_length() // 2) if text else 5,
            0 if not first else 1 if first.isupper() else 2 if first.islower() else 3 if first in "-*#>|" else 4,
            end,
            ended,
        )
        blank, ended = not text, end
    return out


#: How many values each feature has.
KINDS = (4, 2, 6, 5, 4, 4)


class Model:
    def __init__(self):
        self.start = np.ones(STATES)
        self.move = np.ones((STATES, STATES))
        self.emit = [np.ones((STATES, n)) for n in KINDS]

    def learn(self, roles: list[str], pieces: list[str]) -> None:
        states, lines = [], []
        for role, piece in zip(roles, pieces, strict=True):
            own = piece.split("\n")
            # the blank line before an unmarked turn still belongs to the turn before
            lead = 1 if own[0] == "" and len(own) > 1 and states else 0
            if lead:
                states.append(states[-1] | 1)
            base = 2 * ROLES.index(role)
            states += [base] + [base + 1] * (len(own) - 1 - lead)
            lines += own
        seen = observe(lines)
        self.start[states[0]] += 1
        np.add.at(self.move, (states[:-1], states[1:]), 1)
        for f, table in enumerate(self.emit):
            np.add.at(table, (states, seen[:, f]), 1)

    def ready(self) -> Model:
        # a later line follows its own role only
        for i in range(STATES):
            for j in range(1, STATES, 2):
                if i // 2 != j // 2:
                    self.move[i, j] = 1e-12
        self.start[1::2] = 1e-12
        self.log_start = np.log(self.start / self.start.sum())
        self.log_move = np.log(self.move / self.move.sum(axis=1, keepdims=True))
        self.log_emit = [np.log(t / t.sum(axis=1, keepdims=True)) for t in self.emit]
        return self

    def viterbi(self, lines: list[str]) -> list[int]:
        seen = observe(lines)
        emitted = sum(table[:, seen[:, f]].T for f, table in enumerate(self.log_emit))
        best, back = self.log_start + emitted[0], np.zeros((len(lines), STATES), np.int64)
        for k in range(1, len(lines)):
            ways = best[:, None] + self.log_move
            back[k] = ways.argmax(axis=0)
            best = ways[back[k], np.arange(STATES)] + emitted[k]
        path = [int(best.argmax())]
        for k in range(len(lines) - 1, 0, -1):
            path.append(int(back[k, path[-1]]))
        return path[::-1]

    def turns(self, text: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        if not text:
            return []
        lines = text.split("\n")
        out: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.viterbi(lines), strict=True):
            role = ROLES[state // 2]
            if state % 2 == 0 or not out:
                mark = MARKERS[state // 2].match(line)
                out.append((role, [line[mark.end() :] if mark else line]))
            else:
                out[-1][1].append(line)
        return [(role, "\n".join(x).strip("\n")) for role, x in out]


def canonical(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def train(scripts: DataFrame, most: int = 2000) -> Model:
    """scripts: (conv_id, part, roles, pieces), of which a hash picks at most `most`, the bound of what the driver gathers."""
    rows = scripts.select("roles", "pieces", F.xxhash64("conv_id", "part").alias("h"), "conv_id", "part").orderBy("h", "conv_id", "part").limit(most).collect()
    model = Model()
    for row in rows:
        if row["roles"]:
            model.learn(row["roles"], row["pieces"])
    return model.ready()


def parse(scripts: DataFrame, model: Model, keep: tuple[str, ...], text: Column | None = None) -> DataFrame:
    """The kept columns with turns, array of struct(role, text), and chat, their canonical rendering, for each row of scripts."""
    frame = scripts.select(*keep, (scripts["text"] if text is None else text).alias("__text"))
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([*(frame.schema[c] for c in keep), T.StructField("turns", T.ArrayType(turn)), T.StructField("chat", T.StringType())])
    shipped, n, names = scripts.sparkSession.sparkContext.broadcast(model), len(keep), [*keep, "turns", "chat"]
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shipped.value.turns(t) for t in batch.column(n).to_pylist()]
            turns = pa.array([[{"role": r, "text": x} for r, x in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), turns, pa.array([canonical(f) for f in found], pa.string())], names=names)

    return map_arrow(frame, work, schema)
