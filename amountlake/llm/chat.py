"""Chat transcripts to canonical turns: a hidden Markov model over line features.

A transcript's lines are observed through features: the kind of speaker marker they start with (known
names of a user, an assistant or a system, a name shape that no list has, or none; each told apart by what the transcript has at all:
known speakers, only unlisted ones, or no markers), length, a question mark at the end, and whether the line before was blank.  Hidden states are pairs of a role and whether the line begins
a turn or goes on with it.  Start, transition and emission probabilities are counted over all labelled
lines, with smoothing; the tables have a fixed size, and only they reach the driver.  Viterbi gives each
line's state; lines that go on are joined to their turn, markers are stripped, and turns are
rendered as ``<|role|>``, text, ``<|end|>`` on lines of their own.

A transcript may come in parts, numbered in order.  Parts are decoded where they are, as one sequence: each is first summed up by
the best score from any state before it to any state at its end (six times 36 numbers, for what its neighbours may hold), these are joined along the
transcript, and each part then decodes between the states found for its ends.  So a conversation of any length is decoded
whole, its result is the same however it is cut, and what one task gathers is a thousandth of its turns or less.

Defined results: a null or empty transcript has no turns and renders as empty text.  Text before any
marker is a turn too, of the role the model finds likeliest.  A part that goes on with the turn before begins with a turn marked
``goes_on``, rendered without a head; parts rendered in order are the whole, but for blank lines inside a turn where a part ends.  Ties go to
the state first in order.  With nothing to learn from, the smoothed uniform model still follows the known markers.  Very long
transcripts take time in proportion.  Repeated rows give repeated results.  A turn without conv_id or number has no
place in a conversation: it is a transcript of its own, with a null part.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, small_batches

ROLES = ("user", "assistant", "system")
STATES = [(r, b) for r in ROLES for b in (True, False)]
NAMES = {
    "user": ("user", "human", "customer", "instruction", "question", "q", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "response", "answer", "a", "agent"),
    "system": ("system", "sys", "context", "developer"),
}
_KIND = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
OTHER, NONE = 3, 4
_MARK = re.compile(r"^\s*(?:<\|(?P<a>\w+)\|>|\[(?P<b>\w+)\]|#{1,4}\s*(?P<c>\w[\w ]{0,20}?)\s*:?\s*$|\*{0,2}(?P<d>[A-Za-z]\w{0,15})\*{0,2}\s?:(?=\s|$)|(?P<e>[A-Za-z]\w{0,15})>(?=\s|$))[ \t]*")
#: features: marker (5) by what the transcript's markers are (3), length (4), question mark (2), blank line before (2)
SIZES = (15, 4, 2, 2)


def features(line: str, before: str | None) -> tuple[tuple[int, int, int, int], int]:
    """Feature values of a line, and where its text starts behind the marker."""
    found = _MARK.match(line)
    kind, at = NONE, 0
    if found:
        name = next(g for g in found.groups() if g is not None).lower()
        kind, at = _KIND.get(name, OTHER), found.end()
    n = len(line) - at
    return (kind, 0 if n == 0 else 1 if n < 40 else 2 if n < 200 else 3, int(line.rstrip().endswith("?")), int(before is not None and not before.strip())), at


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray], smooth: float = 0.5) -> None:
        prior = np.full((len(STATES), SIZES[0]), smooth)
        for s, (role, begins) in enumerate(STATES):  # what markers mean, before anything is seen
            prior[s, (ROLES.index(role) if begins else NONE) :: 5] += 5
        norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start = norm(start + np.array([smooth if b else 1e-6 for _, b in STATES]))
        allowed = np.array([[1.0 if b2 or r1 == r2 else 0.0 for r2, b2 in STATES] for r1, _ in STATES])
        self.move = norm(move * allowed + smooth * allowed + 1e-9)
        self.emit = [norm(e + (prior if i == 0 else smooth)) for i, e in enumerate(emit)]

    @staticmethod
    def empty() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = len(STATES)
        return np.zeros(n), np.zeros((n, n)), [np.zeros((n, k)) for k in SIZES]

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, i]].T for i, e in enumerate(self.emit))

    def viterbi(self, seen: np.ndarray, before: int | None = None, last: int | None = None) -> np.ndarray:
        """The best states, given the one before the first line and the one at the last, if these are known."""
        score = self.scores(seen)
        back = np.zeros((len(seen), len(STATES)), np.int8)
        now = (self.start if before is None else self.move[before]) + score[0]
        for t in range(1, len(seen)):
            ways = now[:, None] + self.move
            back[t] = ways.argmax(0)
            now = ways.max(0) + score[t]
        path = np.zeros(len(seen), np.int64)
        path[-1] = now.argmax() if last is None else last
        for t in range(len(seen) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path

    def across(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each state before the lines (if they are the first: from the start) to each at their end."""
        score = self.scores(seen)
        now = (np.tile(self.start, (len(STATES), 1)) if first else self.move) + score[0]
        for row in score[1:]:
            now = (now[:, :, None] + self.move[None]).max(1) + row
        return now


def markers(seen: np.ndarray) -> int:
    """2 if there are markers of a known user or assistant, 1 if there are only others, 0 if there are none."""
    kinds = set((seen[:, 0] % 5).tolist())
    return 2 if kinds & {0, 1} else 1 if OTHER in kinds else 0


def observed(text: str, blank: bool | None = None, kind: int | None = None) -> tuple[np.ndarray, list[str], list[int]]:
    """Features of each line, the lines, and where their text starts.

    ``blank``: was the line before the first blank?  None: there is none; blank lines before the first turn are left out.
    ``kind``: what markers the whole transcript has, if that is known better than from this text.
    """
    lines = (text.lstrip("\n") if blank is None else text).split("\n")
    seen, starts = zip(*(features(line, lines[i - 1] if i else None if blank is None else "" if blank else "x") for i, line in enumerate(lines)))
    seen = np.array(seen)
    seen[:, 0] += 5 * (markers(seen) if kind is None else kind)
    return seen, lines, list(starts)


def parse(text: str | None, model: Model, before: int | None = None, last: int | None = None, blank: bool | None = None, kind: int | None = None) -> list[tuple[str, str, bool]]:
    """(role, text, goes on with the part before) of each turn."""
    if text is None or (before is None and last is None and not text.strip()):
        return []
    seen, lines, starts = observed(text, blank, kind)
    turns: list[tuple[str, list[str], bool]] = []
    for line, at, state in zip(lines, starts, model.viterbi(seen, before, last).tolist()):
        role, begins = STATES[state]
        if begins or not turns:
            turns.append((role, [line[at:] if begins else line], not begins and before is not None))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(own).strip(), on) for role, own, on in turns]


def render(turns: list[tuple[str, str, bool]], inside: bool = False, open_end: bool = False) -> str:
    """Turns between their marks.  ``inside``: a turn of the part before is still open; ``open_end``: the last one stays so."""
    out = "<|end|>\n" if inside and turns and not turns[0][2] else ""
    for role, text, on in turns:
        out += ("" if on else f"<|{role}|>\n") + ("" if on and not text else f"{text}\n") + "<|end|>\n"
    return out[: -len("<|end|>\n")] if turns and open_end else out


def fit(labelled: DataFrame) -> Model:
    """From transcripts with the columns text and states (array of state numbers, one per line)."""
    small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = Model.empty()
        for batch in batches:
            for text, states in zip(batch.column("text").to_pylist(), batch.column("states").to_pylist()):
                states = states[len(text) - len(text.lstrip("\n")) :]
                seen = observed(text)[0]
                if len(seen) != len(states) or not states:
                    continue
                start[states[0]] += 1
                np.add.at(move, (states[:-1], states[1:]), 1)
                for i, e in enumerate(emit):
                    np.add.at(e, (states, seen[:, i]), 1)
        flat = np.concatenate([start, move.reshape(-1), *(e.reshape(-1) for e in emit)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.int64))], ["at", "n"])

    rows = labelled.filter("text is not null and states is not null").select("text", F.col("states").cast("array<int>").alias("states"))
    got = rows.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    start, move, emit = Model.empty()
    flat = np.zeros(len(start) + move.size + sum(e.size for e in emit))
    for at, n in got:
        flat[at] = n
    parts, at = [], 0
    for shape in (start.shape, move.shape, *(e.shape for e in emit)):
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return Model(parts[0], parts[1], parts[2:])


def _borders(transcripts: DataFrame, model: Model) -> DataFrame:
    """_c, _p, before, last, blank, on, kind: what parts of transcripts in several parts must know of each other."""
    spark = transcripts.sparkSession
    shared = spark.sparkContext.broadcast(model)
    parts = transcripts.filter("conv_id is not null and part is not null")
    many = materialize(parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("first")).filter("n > 1"), "many")
    kinds = "_c long, _p long, before int, last int, blank boolean, on boolean, kind int"
    if many.isEmpty():
        return spark.createDataFrame([], kinds)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends, kinds = [], [], []
            for text, first in zip(batch.column("text").to_pylist(), batch.column("first").to_pylist()):
                text = text or ""
                own = None if first else False
                ways = [shared.value.across(observed(text, None if first else b, kind)[0], first) for kind in range(3) for b in (False, True)]
                data.append(np.stack(ways).tobytes())
                ends.append(not text.rsplit("\n", 1)[-1].strip())
                kinds.append(markers(observed(text, own)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(data, pa.binary()), pa.array(ends, pa.bool_()), pa.array(kinds, pa.int32())], ["conv_id", "part", "ways", "ends", "kind"])

    rows = parts.join(bounded(many), "conv_id").select("conv_id", "part", "text", (F.col("part") == F.col("first")).alias("first"))
    summed = rows.mapInArrow(sums, "conv_id long, part long, ways binary, ends boolean, kind int")

    def joined(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        ends = rows.column("ends").to_pylist()
        blank, kind = [None, *ends[:-1]], max(rows.column("kind").to_pylist())
        ways = [np.frombuffer(w, np.float64).reshape(3, 2, len(STATES), -1)[kind, int(bool(b))] for w, b in zip(rows.column("ways").to_pylist(), blank)]
        now, back = ways[0][0], []
        for w in ways[1:]:
            step = now[:, None] + w
            back.append(step.argmax(0))
            now = step.max(0)
        last = [int(now.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        before = [None, *last[:-1]]
        return pa.table([rows.column("conv_id"), rows.column("part"), pa.array(before, pa.int32()), pa.array(last, pa.int32()), pa.array(blank, pa.bool_()), pa.array([True] * (len(last) - 1) + [False]), pa.array([kind] * len(last), pa.int32())], ["_c", "_p", "before", "last", "blank", "on", "kind"])

    return materialize(summed.groupBy("conv_id").applyInArrow(joined, kinds), "borders")


def format_transcripts(transcripts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with turns (array of role, text, goes_on) and rendered, from column text; conv_id and part, if there, order parts."""
    spark = transcripts.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {transcripts.schema[c].dataType.simpleString()}" for c in keep)
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("goes_on", pa.bool_())]))
    known = [F.lit(None).cast("int").alias("_before"), F.lit(None).cast("int").alias("_last"), F.lit(None).cast("boolean").alias("_blank"), F.lit(False).alias("_on"), F.lit(None).cast("int").alias("_kind")]
    rows = transcripts.select(*keep, F.col("text").cast("string").alias("_text"), *known)
    if {"conv_id", "part"} <= set(transcripts.columns):
        borders = _borders(transcripts, model)
        if not borders.isEmpty():
            met = transcripts.join(borders, (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p")), "left")
            rows = met.select(*keep, F.col("text").cast("string").alias("_text"), F.col("before").alias("_before"), F.col("last").alias("_last"), F.col("blank").alias("_blank"), F.coalesce("on", F.lit(False)).alias("_on"), F.col("kind").alias("_kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            turns, texts = [], []
            for text, before, last, blank, on, kind in zip(*(batch.column(c).to_pylist() for c in ("_text", "_before", "_last", "_blank", "_on", "_kind"))):
                turns.append(parse(text, model, before, last, blank, kind))
                texts.append(render(turns[-1], before is not None, on))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array([[{"role": r, "text": t, "goes_on": o} for r, t, o in x] for x in turns], turn), pa.array(texts, pa.string())],
                [*keep, "turns", "rendered"],
            )

    return rows.mapInArrow(run, f"{kinds}, turns array<struct<role:string,text:string,goes_on:boolean>>, rendered string")


#: Ways in which transcripts mark speakers: user, assistant, system; {} is the text.  Some say who speaks by words that no
#: list has, some leave speakers out and have a blank line, or mark one side only, and some texts hold what looks like a marker.
STYLES = (
    ("User: {}", "Assistant: {}", "System: {}"),
    ("Ana: {}", "Ben: {}", "Setup: {}"),
    ("### Instruction:\n{}", "### Response:\n{}", "### System:\n{}"),
    ("\n{}", "\n{}", "\n{}"),
    ("Q: {}", "\n{}", "[system] {}"),
    ("<|user|> {}", "<|assistant|> {}", "<|system|> {}"),
    ("Zoe: {}", "Max: {}", "Scene: {}"),
    ("Customer: {}", "Agent: {}", "Context: {}"),
)
#: styles in which further lines of a text start with what looks like a marker
NOTED = (0, 7)


def held_out(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 4 == 2, F.lit(False))


def transcripts(conversations: DataFrame, size: int = 1000) -> DataFrame:
    """conv_id, part, text, states, roles: raw transcripts of conversations, in one of eight marker styles by conv_id.

    A part has the turns numbered from a multiple of ``size`` to the next, so a conversation that holds a third of all rows is
    spread over tasks.
    """
    text = F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    style = F.pmod(F.xxhash64(F.col("conv_id").cast("long")), F.lit(len(STYLES)))
    text = F.when(style.isin(*NOTED), F.replace(text, F.lit("\n"), F.lit("\nNote: "))).otherwise(text)

    def marked(form: str) -> Column:
        a, b = form.split("{}")
        return F.concat(F.lit(a), text, F.lit(b))

    every = F.array(*[F.array(*[marked(form) for form in forms]) for forms in STYLES])
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), role).cast("int")
    line = F.element_at(F.element_at(every, (style + 1).cast("int")), number)
    # a turn that starts with a blank line begins at the line behind it: the blank one ends the turn before
    state, lead = ((number - 1) * 2).cast("int"), F.startswith(line, F.lit("\n"))
    states = F.concat(F.when(lead, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.array(state), F.array_repeat(state + 1, F.size(F.split(line, "\n")) - 1 - lead.cast("int")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.floor(F.col("turn") / size).cast("long").alias("part"),
        F.struct(F.col("turn").cast("long").alias("turn"), line.alias("line"), role.alias("role"), states.alias("states")).alias("x"),
    )
    placed = F.col("conv_id").isNotNull() & F.col("part").isNotNull()
    grouped = rows.filter(placed).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("x")).alias("x"))
    alone = rows.filter(~placed).select("conv_id", F.lit(None).cast("long").alias("part"), F.array("x").alias("x"))
    both = grouped.unionByName(alone)
    flat = F.flatten(F.col("x.states"))
    before = lambda s, i: F.when(s == -1, F.when(i == 0, F.lit(1)).otherwise(F.get(flat, i - 1) - F.get(flat, i - 1) % 2 + 1)).otherwise(s)
    return both.select("conv_id", "part", F.array_join(F.col("x.line"), "\n").alias("text"), F.transform(flat, before).alias("states"), F.col("x.role").alias("roles"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, part, held_out, n_turns, n_found, n_right, rendered_sha256 of formatted transcripts with a column roles.

    Right are turns found in their place with their role, counted from the first to the last.
    """
    own = F.filter(F.col("turns"), lambda t: ~t.goes_on)
    same = F.filter(F.transform(F.col("roles"), lambda r, i: r == F.get(own, i).role), lambda x: x)
    return formatted.select("conv_id", "part", held_out(F.col("conv_id")).alias("held_out"), F.size("roles").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_found"), F.size(same).cast("long").alias("n_right"), F.sha2("rendered", 256).alias("rendered_sha256"))
