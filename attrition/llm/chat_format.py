"""Chat formatting by a hidden Markov model over transcript lines (operator 8).

A transcript is plain text in which some lines begin with a speaker marker
("User:", "Q:", "AI >"); others carry none, or one that says nothing of the role.
Each line is an observation (marker class, length, question mark, capital); the
hidden state of a line is its speaker's role and whether it opens a turn.
Viterbi recovers the states of a whole transcript, then turns are rendered in one
canonical form.

*No text is lost or forged.*  Lines of a turn's own text that look like a role's
marker are written with a backslash before them, which the parser takes off
again; ``<|`` inside a text is rendered as ``<\\|``, so only the renderer's
delimiters are delimiters (``parse_rendered`` reads the rendering back).

*Long conversations.*  A conversation is cut into parts of at most ``PART`` units
(a turn, and one more for every ``UNIT_CHARS`` of its text), placed by exact ranks
over ranges, so that no task gathers more, whatever the conversation.  The path is
that of the whole transcript all the same: each part gives the best score from
every state before it to every state at its end; these 6 x 6 tables are
multiplied (sum, maximum) in groups of ``FAN`` up to one table a conversation, and
back down each part learns the scores it starts from and the state it ends in.
Scores are whole numbers and ties are ordered through the products, so the states
are those of one Viterbi over all lines, wherever the cuts fall.  The renderings
of a conversation's parts, joined in order, are its rendering.

Probabilities are counted (plus one), in tasks, on transcripts of about ``SAMPLE``
conversations drawn by hash, parts with unknown roles left out.

Defined results: null text is an empty line; rows with a null role carry no marker
and take no part in training; repeated rows of a conversation count once; rows
with null ``conv_id`` are one transcript each; null ``turn`` comes first; turns
with one number are ordered by role and a hash of the text; a transcript always
opens with a new turn; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import written

#: Units of a part, characters of a unit, parts of a product.
PART = 1_024
UNIT_CHARS = 4_096
FAN = 256
#: Turns of a range when a table is put in order.
RANGE_ROWS = 50_000
SAMPLE = 1_500
ROLES = ("assistant", "system", "user")
#: A state is 2 * role + (0: first line of a turn, 1: later line).
STATES = 2 * len(ROLES)

#: Words that mark a speaker, by role (fixed values).
MARKERS = {
    "user": ("user", "human", "customer", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent"),
    "system": ("system", "instructions", "context", "note"),
}
_ROLE_OF = {word: ROLES.index(role) for role, words in MARKERS.items() for word in words}
_MARKER = re.compile(r"[ \t]{0,8}(?:#{1,4}[ \t]?)?([A-Za-z]{1,16})[ \t]?[:>][ \t]?")
#: Lines of a text that the writer escapes (Java): a backslash, or what the parser takes for a role's marker.
_TO_ESCAPE = (r"(?mdi)^(?=\\|[ \t]{0,8}(?:#{1,4}[ \t]?)?(?:" + "|".join(sorted(_ROLE_OF)) + r")[ \t]?[:>])")
NO_MARKER, OTHER_MARKER = len(ROLES), len(ROLES) + 1
#: Values of each feature of a line.
SIZES = (len(ROLES) + 2, 5, 2, 2)
#: Log probabilities are counted in steps of 2^-20; ``NEVER`` stands for minus infinity.
STEP, NEVER = 1 << 20, -(1 << 59)
LINES = 4_096


def _unescaped(line: str) -> str:
    return line[1:] if line.startswith("\\") else line


def line_features(line: str) -> tuple[int, ...]:
    m = _MARKER.match(line)
    marker = NO_MARKER if m is None else _ROLE_OF.get(m.group(1).lower(), OTHER_MARKER)
    body = _unescaped(line[m.end():] if m else line).strip()
    n = len(body)
    return (marker, 0 if n == 0 else 1 if n < 40 else 2 if n < 120 else 3 if n < 300 else 4,
            int(body.endswith("?")), int(body[:1].isupper()))


def without_marker(line: str) -> str:
    m = _MARKER.match(line)
    return line[m.end():] if m and m.group(1).lower() in _ROLE_OF else line


def features_of(lines: list[str]) -> np.ndarray:
    """``(lines, features)``, block by block."""

    blocks = [np.array([line_features(x) for x in lines[i:i + LINES]], np.int8) for i in range(0, len(lines), LINES)]
    return np.concatenate(blocks)


def _whole(logs: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(logs), NEVER, np.round(np.where(np.isneginf(logs), 0, logs) * STEP)).astype(np.int64)


def _times(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Products of stacked tables ``(n, before, end)`` of scores and of the order among equal scores.

    ``order[:, a, s]`` ranks the best paths from each ``a`` to ``s``: the one with
    the lower last state is before another, then the state before that, and so on.
    """

    (a, a_order), (b, b_order) = left, right
    through = a[:, :, :, None] + b[:, None, :, :]
    best = through.max(axis=2)
    middle = np.where(through == best[:, :, None, :], b_order[:, None, :, :], STATES).argmin(axis=2)
    n, start, end = np.ogrid[:len(a), :STATES, :STATES]
    order = b_order[n, middle, end] * STATES + a_order[n, start, middle]
    return best, order.argsort(axis=1).argsort(axis=1)


@dataclass
class RoleModel:
    start: np.ndarray  # log probabilities
    move: np.ndarray
    emit: list[np.ndarray]  # per feature: (states, values)

    def __post_init__(self) -> None:
        self._start, self._move = _whole(self.start), _whole(self.move)
        self._emit = [_whole(table) for table in self.emit]

    @staticmethod
    def counted(counts: dict[int, int]) -> RoleModel:
        """From the counts of ``_count`` by cell, one more for each."""

        every = np.ones(STATES + STATES ** 2 + STATES * sum(SIZES))
        for cell, n in counts.items():
            every[cell] += n
        start, move, *emit = np.split(every, np.cumsum([STATES, STATES ** 2, *(STATES * size for size in SIZES[:-1])]))
        move, emit = move.reshape(STATES, STATES), [t.reshape(STATES, -1) for t in emit]
        start[1::2] = 0  # a transcript opens with a turn
        for a in range(STATES):
            for b in range(1, STATES, 2):
                move[a, b] *= a // 2 == b // 2  # a later line follows a line of its speaker
        with np.errstate(divide="ignore"):
            return RoleModel(np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True)),
                             [np.log(t / t.sum(axis=1, keepdims=True)) for t in emit])

    def _scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(table[:, seen[:, k]] for k, table in enumerate(self._emit)).T

    def entry(self) -> np.ndarray:
        """Scores before the first line: one state, which ``start`` leaves."""

        return np.where(np.arange(STATES) == 0, 0, NEVER)

    def viterbi(self, lines, first: bool = True, entry: np.ndarray | None = None, end: int | None = None) -> list[int]:
        """Most probable states; of equal paths the one with the lower state numbers last.

        A part that isn't the ``first`` starts from the scores ``entry`` and, as
        every part but the last, goes to the state ``end``.
        """

        if not len(lines):
            return []
        seen = np.asarray(lines)
        before = self.entry() if entry is None else entry
        back = np.zeros((len(seen), STATES), np.int8)
        every = np.arange(STATES)
        for low in range(0, len(seen), LINES):
            for t, scores in enumerate(self._scores(seen[low:low + LINES]), low):
                paths = before[:, None] + (np.broadcast_to(self._start, (STATES, STATES)) if first and t == 0 else self._move)
                back[t] = paths.argmax(axis=0)
                before = paths[back[t], every] + scores
        state = int(before.argmax()) if end is None else end
        out = [state]
        for t in range(len(seen) - 1, 0, -1):
            state = int(back[t, state])
            out.append(state)
        return out[::-1]

    def table(self, lines: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(1, before, end)``: best scores over ``lines`` and the order among equal ones."""

        total = None
        for low in range(0, len(lines), LINES):
            scores = self._scores(lines[low:low + LINES])
            steps = self._move[None] + scores[:, None, :]
            if first and low == 0:
                steps[0] = self._start + scores[0]
            block = steps, np.broadcast_to(np.arange(STATES)[:, None], steps.shape)
            while len(block[0]) > 1:
                even = len(block[0]) // 2 * 2
                pairs = _times(tuple(x[0:even:2] for x in block), tuple(x[1:even:2] for x in block))
                block = tuple(np.concatenate([p, x[even:]]) for p, x in zip(pairs, block))
            total = block if total is None else _times(total, block)
        return total


def _spoken(lines: list[str], states: list[int]) -> list[tuple[str | None, str]]:
    """(role, text) of each turn; the first has no role if it goes on with a turn of the part before."""

    out: list[tuple[str | None, list[str]]] = []
    for line, state in zip(lines, states):
        if state % 2 == 0:
            out.append((ROLES[state // 2], [_unescaped(without_marker(line))]))
        elif out:
            out[-1][1].append(_unescaped(line))
        else:
            out.append((None, [_unescaped(line)]))
    return [(role, "\n".join(body)) for role, body in out]


def turns(transcript: str, model: RoleModel) -> tuple[list[tuple[str, str]], list[int]]:
    """((role, text) of each turn, state of each line)."""

    lines = transcript.split("\n")
    states = model.viterbi(features_of(lines))
    return _spoken(lines, states), states


def rendered(found: list[tuple[str | None, str]], first: bool = True, last: bool = True) -> str:
    """The canonical form; renderings of parts in order make that of the whole."""

    out = []
    for k, (role, text) in enumerate(found):
        text = re.sub(r"<(\\*)\|", r"<\\\1|", text)
        close = "" if k == 0 and first else "\n<|end|>\n"
        out.append(f"\n{text}" if role is None else f"{close}<|{role}|>\n{text}")
    return "".join(out) + ("\n<|end|>\n" if last else "")


def parse_rendered(whole: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendering."""

    found = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", whole, re.DOTALL)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in found]


# -- transcripts of a conversation table -------------------------------------------

def conversation_parts(conversations: DataFrame, part: int = PART) -> DataFrame:
    """``key, conv_id, part, is_last, said array<struct<turn, role, h, text>>`` in order of turns."""

    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    alone = F.concat_ws(" ", F.lit("null"), F.xxhash64(F.lit(1), "turn", "role", "text"),
                        F.xxhash64(F.lit(2), "text", "role", "turn"))
    units = 1 + F.floor(F.length("text") / UNIT_CHARS)
    rows = written(rows.withColumns({"key": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), alone),
                                     "h": F.xxhash64("text"), "units": units}))
    order = ("turn", "role", "h")
    ranges = max(1, rows.count() // RANGE_ROWS)
    ranged = written(rows.repartitionByRange(ranges, "key", *order).withColumn("range", F.spark_partition_id()))
    held = ranged.groupBy("key", "range").agg(F.sum("units").alias("held"))
    by_range = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("key", "range", F.coalesce(F.sum("held").over(by_range), F.lit(0)).alias("offset"),
                          F.sum("held").over(Window.partitionBy("key")).alias("whole"))
    inside = Window.partitionBy("key", "range").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("place", F.coalesce(F.sum("units").over(inside), F.lit(0))).join(offsets, ["key", "range"])
    at = F.col("offset") + F.col("place")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "h", "text")))
    return placed.groupBy("key", F.floor(at / part).alias("part")).agg(
        F.max("conv_id").alias("conv_id"), F.max(at + F.col("units") == F.col("whole")).alias("is_last"), said.alias("said"))


def _line_marker(turn: Column) -> Column:
    """How a turn is marked in the plain transcript: by one of the words of its role, or not at all.

    The choice follows a hash of the turn: a fifth carry no marker.
    """

    pick = F.pmod(F.xxhash64(turn["text"], turn["turn"]), F.lit(60))
    marked = F.lit("")
    for role, words in MARKERS.items():
        choice = F.element_at(F.array(*(F.lit(f"{w.capitalize()}: ") for w in words)),
                              (pick % len(words) + 1).cast("int"))
        marked = F.when(turn["role"] == role, choice).otherwise(marked)
    return F.when(pick % 5 == 4, F.lit("")).otherwise(marked)


def transcripts(conversations: DataFrame, part: int = PART) -> DataFrame:
    """``key, conv_id, part, is_last, transcript, roles, sizes``: plain text, the true role and the lines of each turn."""

    def plain(turn: Column) -> Column:
        return F.concat(_line_marker(turn), F.regexp_replace(turn["text"], _TO_ESCAPE, "\\\\"))

    sizes = F.transform("said", lambda t: F.size(F.split(t["text"], "\n")))
    return conversation_parts(conversations, part).select(
        "key", "conv_id", "part", "is_last", F.array_join(F.transform("said", plain), "\n").alias("transcript"),
        F.transform("said", lambda t: t["role"]).alias("roles"), sizes.alias("sizes"))


def true_states(roles: list, sizes: list[int]) -> list[int | None]:
    out: list[int | None] = []
    for role, size in zip(roles, sizes):
        first = 2 * ROLES.index(role) if role in ROLES else None
        out += [first] + [None if first is None else first + 1] * (size - 1)
    return out


# -- training ---------------------------------------------------------------------------

def _count(states: np.ndarray, seen: np.ndarray, first: bool) -> np.ndarray:
    """Cells of starts, moves and observations of one part, each as often as it was seen."""

    cells = [states[:1]] if first else []
    cells.append(STATES + STATES * states[:-1] + states[1:])
    base = STATES + STATES ** 2
    for k, size in enumerate(SIZES):
        cells.append(base + size * states + seen[:, k])
        base += STATES * size
    return np.concatenate(cells)


def fit_parts(parts: DataFrame, sample: int = SAMPLE) -> RoleModel:
    """From parts of transcripts with their true roles; only sums of counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(STATES + STATES ** 2 + STATES * sum(SIZES), np.int64)
            for transcript, roles, sizes, number in zip(*(batch.column(k).to_pylist() for k in range(4))):
                cells = _count(np.array(true_states(roles, sizes)), features_of(transcript.split("\n")).astype(np.int64),
                               number == 0)
                total += np.bincount(cells, minlength=len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    total = parts.filter("part = 0").count()
    drawn = F.pmod(F.xxhash64("key", F.lit("chat sample")), F.lit(1_000_000)) / 1e6 < sample / max(1, total)
    known = parts.filter(drawn & F.forall("roles", lambda r: F.coalesce(r.isin(*ROLES), F.lit(False))))
    counts = known.select("transcript", "roles", "sizes", "part").mapInArrow(run, "cell long, n long")
    return RoleModel.counted({r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()})


def fit(conversations: DataFrame, sample: int = SAMPLE) -> RoleModel:
    return fit_parts(written(transcripts(conversations)), sample)


# -- parsing ----------------------------------------------------------------------------

_TABLE = "key string, part long, scores array<long>, ranks array<long>"
_STATE = "key string, part long, entry array<long>, end long"


def _part_tables(parts: DataFrame, model: RoleModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.table(features_of(text.split("\n")), number == 0)
                     for text, number in zip(batch.column("transcript").to_pylist(), batch.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"),
                 *(pa.array([f[k].ravel().tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1))],
                names=["key", "part", "scores", "ranks"])

    return parts.select("key", "part", "transcript").mapInArrow(run, _TABLE)


def _in_order(group: pa.Table) -> tuple[list, list[tuple[np.ndarray, np.ndarray]]]:
    rows = sorted(zip(*(group.column(c).to_pylist() for c in ("part", "scores", "ranks"))), key=lambda r: r[0])
    square = (1, STATES, STATES)
    return [r[0] for r in rows], [(np.array(r[1]).reshape(square), np.array(r[2]).reshape(square)) for r in rows]


def _products(level: DataFrame, fan: int) -> DataFrame:
    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, tables = _in_order(group)
        total = tables[0]
        for table in tables[1:]:
            total = _times(total, table)
        return pa.table({"key": [key[0].as_py()], "part": [key[1].as_py()], "scores": [total[0].ravel().tolist()],
                         "ranks": [total[1].ravel().tolist()]})

    return level.withColumn("up", F.floor(F.col("part") / fan)).groupBy("key", "up").applyInArrow(run, _TABLE)


def _ends(level: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """Of each part the scores before it and the state at its end, from those of its group."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        numbers, tables = _in_order(group)
        entries = [np.array(group.column("entry")[0].as_py())]
        for scores, _ in tables[:-1]:
            entries.append((entries[-1][:, None] + scores[0]).max(axis=0))
        ends = [group.column("end")[0].as_py()]
        for (scores, ranks), entry in zip(tables[:0:-1], entries[:0:-1]):
            paths = entry + scores[0, :, ends[-1]]
            ends.append(int(np.where(paths == paths.max(), ranks[0, :, ends[-1]], STATES).argmin()))
        return pa.table({"key": [key[0].as_py()] * len(numbers), "part": numbers,
                         "entry": [e.tolist() for e in entries], "end": ends[::-1]})

    joined = level.withColumn("up", F.floor(F.col("part") / fan)).join(
        above.select("key", F.col("part").alias("up"), "entry", "end"), ["key", "up"])
    return joined.groupBy("key", "up").applyInArrow(run, _STATE)


def part_states(parts: DataFrame, model: RoleModel, fan: int = FAN) -> DataFrame:
    """``key, part, entry, end`` of the parts of conversations that have several."""

    several = parts.filter((F.col("part") > 0) | ~F.col("is_last"))
    levels = [written(_part_tables(several, model))]
    highest = levels[0].agg(F.max("part")).first()[0] or 0
    while highest > 0:
        levels.append(written(_products(levels[-1], fan)))
        highest //= fan
    entry = model.entry()

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [int((entry[:, None] + np.array(s).reshape(STATES, STATES)).max(axis=0).argmax())
                    for s in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"),
                 pa.array([entry.tolist()] * len(ends), pa.list_(pa.int64())), pa.array(ends, pa.int64())],
                names=["key", "part", "entry", "end"])

    found = levels[-1].select("key", "part", "scores").mapInArrow(top, _STATE)
    for level in levels[-2::-1]:
        found = written(_ends(level, found, fan))
    return found


def format_chats(parts: DataFrame, model: RoleModel, fan: int = FAN) -> DataFrame:
    """``conv_id, part, n_lines, n_turns, n_agree, roles, rendered`` of parts of transcripts.

    A turn counts where it opens.  ``n_agree`` counts the lines whose speaker is
    the true one, where ``roles`` and ``sizes`` say who that is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for number, last, transcript, roles, sizes, entry, end in zip(
                    *(batch.column(k).to_pylist() for k in range(1, 8))):
                lines = transcript.split("\n")
                states = model.viterbi(features_of(lines), number == 0, None if entry is None else np.array(entry), end)
                found = _spoken(lines, states)
                truth = true_states(roles, sizes)
                agree = sum(t is not None and t // 2 == s // 2 for t, s in zip(truth, states))
                opened = [role for role, _ in found if role is not None]
                for col, value in zip(rows, (len(states), len(opened), agree, ",".join(opened),
                                             rendered(found, number == 0, last))):
                    col.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, types))],
                names=["conv_id", "part", "n_lines", "n_turns", "n_agree", "roles", "rendered"])

    carried = parts.join(part_states(parts, model, fan), ["key", "part"], "left")
    kind = parts.schema["conv_id"].dataType.simpleString()
    return carried.select("conv_id", "part", "is_last", "transcript", "roles", "sizes", "entry", "end").mapInArrow(
        run, f"conv_id {kind}, part long, n_lines long, n_turns long, n_agree long, roles string, rendered string")


def format_conversations(conversations: DataFrame, model: RoleModel | None = None, part: int = PART,
                         fan: int = FAN) -> DataFrame:
    """Plain transcripts of the conversations, parsed back and rendered."""

    parts = written(transcripts(conversations, part))
    return format_chats(parts, model or fit_parts(parts), fan)
