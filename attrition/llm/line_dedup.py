"""Line deduplication by content-defined line chunks (operator 5).

A text's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes
ends a chunk where it falls on one value in ``DIVISOR``, once the chunk has
``LEAST_LINES`` lines.  Boundaries depend on the lines near them alone, so a
passage that many documents share is cut alike wherever it stands, but for its
first and last lines.  A line of ``LONG_LINE`` words or more stands for several:
it is a chunk by itself, so a long passage on one line is found too.  Chunks of
several lines and a word, or of one long line, take part.

Where chunks end depends on the lines around a passage, so its first and last lines,
or all of a passage of few lines, can be missed.  So matches are extended by windows:
from each line on, and up to each line, the fewest lines that hold ``LONG_LINE`` words.
These depend on the lines inside them alone, and together they cover every run of
lines with that many words, wherever it stands.

A chunk, or a window, that an earlier document holds (less ``doc_id``) is removed;
within a document its first occurrence counts, for windows those before it without
overlap.  Every line that goes by either rule stands, equal, earlier in the corpus.

Spans are looked up by 128 bits, sums over the two hashes of each line, and then
compared byte by byte: all spans of an equal hash must be the same sequence of line
hashes, and all lines of an equal hash the same text.  If any differs, all is done
again with other line hashes, until every look-up is proved.

*Scale.*  The text is read three times: one pass writes a narrow row for each span of a
document, one sends the lines of repeated spans to the comparison, one removes.  Spans
to compare are picked by a bit table of fixed size (``MARKS`` bits, 8 MB; a mark set by
another span only costs work).  Counts and comparisons are summed up in each task before
the shuffle, so a passage in a third of all documents is one row from each task.
The join with the repeated spans can be split by Spark where one is frequent.  One
shuffle carries text: documents once, to meet what is removed from them.

Defined results: null text stays null; a document may become empty, it isn't
dropped; rows that agree in ``doc_id`` count as one document, rows without one
are told apart by their text and come after all others; an empty table gives no
rows; all columns pass through, whatever their names, ``n_chars`` follows the text.
What a task holds of a document is bounded by its text, however many rows share its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from attrition.llm.common import map_rows, text_blocks, written

WINDOW, DIVISOR, LEAST_LINES = 2, 2, 2
#: Words, by spaces.
LONG_LINE = 50
_BASE = 0x100000001B3
#: One odd base for each half of a line's 128-bit hash.
_BASES = (_BASE, 0x9E3779B97F4A7C15)
MARKS = 1 << 26
#: Rows without an id come after all ids: this less a hash of the text.
_LAST = (1 << 63) - 1
_ORDER, _KEY = "__doc_order", "__text_key"


def _digests(lines: list[str], seed: int = 0) -> np.ndarray:
    """A row of two hashes for each line."""

    import xxhash

    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(line, seed) for line in lines] if seed else map(digest, lines)), "<u8").reshape(-1, 2)


def _is_long(line: str) -> bool:
    return line.count(" ") >= LONG_LINE - 1 and not line.isspace()


def _long_lines(lines: list[str]) -> np.ndarray:
    return np.array([len(line) >= LONG_LINE and _is_long(line) for line in lines], bool)


def _cuts(hashes: np.ndarray, long: np.ndarray, starts: np.ndarray, window: int = WINDOW, divisor: int = DIVISOR,
          least: int = LEAST_LINES) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the chunks of texts that begin at the lines ``starts`` (the number of lines at the end)."""

    rolling = hashes.copy()
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(1, window):
        inside = np.flatnonzero(place >= back)
        rolling[inside] += hashes[inside - back] * np.uint64(pow(_BASE, back, 1 << 64))
    ends = (rolling >> np.uint64(32)) % np.uint64(divisor) == 0
    last_line = np.zeros(len(hashes), bool)
    last_line[starts[1:] - 1] = True
    first, last, start = [], [], 0
    for i in np.flatnonzero(ends | long | last_line).tolist():
        if long[i]:
            if i > start:
                first.append(start)
                last.append(i - 1)
            first.append(i)
            last.append(i)
            start = i + 1
        elif last_line[i] or i + 1 - start >= least:
            first.append(start)
            last.append(i)
            start = i + 1
    return np.array(first, np.int64), np.array(last, np.int64)


def chunks(text: str, window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST_LINES) -> list[list[str]]:
    """The lines of a text, cut into chunks."""

    lines = text.split("\n")
    cuts = _cuts(_digests(lines)[:, 0], _long_lines(lines), np.array([0, len(lines)]), window, divisor, least)
    return [lines[a:b + 1] for a, b in zip(*cuts)]


def _windows(words: np.ndarray, long: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the windows, by first line; a long line alone is a chunk, not a window."""

    upto = np.append(0, np.cumsum(words))
    n = len(words)
    sizes = np.diff(starts)
    begin, end = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
    last = np.searchsorted(upto, upto[:-1] + LONG_LINE) - 1
    first = np.searchsorted(upto, upto[1:] - LONG_LINE, side="right") - 1
    at = np.arange(n)
    codes = np.unique(np.concatenate([(at * n + last)[last < end], (first * n + at)[first >= begin]]))
    first, last = codes // n, codes % n
    several = (last > first) | ~long[first]
    return first[several], last[several]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(2 * n, base, np.uint64)
        out[:1] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


@dataclass
class Spans:
    """Chunks that take part and windows of some texts, text by text, chunks first; line numbers run over all texts."""

    lines: list[str]
    starts: np.ndarray
    digests: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    is_chunk: np.ndarray
    h: np.ndarray
    g: np.ndarray


def spans(texts: list[str], seed: int = 0, hash_bits: int = 64) -> Spans:
    """Look-up hashes from ``seed``; where chunks end doesn't depend on it."""

    of_text = [text.split("\n") for text in texts]
    lines = [line for own in of_text for line in own]
    starts = np.append(0, np.cumsum([len(own) for own in of_text]))
    long, own = _long_lines(lines), _digests(lines)
    words = np.fromiter(map(len, map(str.split, lines)), np.int64, len(lines))
    first, last = _cuts(own[:, 0], long, starts)
    any_word = np.append(0, np.cumsum(words > 0))
    counts = np.where(last > first, any_word[last + 1] > any_word[first], long[first])
    counts &= (last == first) | (last + 1 - first >= LEAST_LINES)
    first, last = first[counts], last[counts]
    from_, to = _windows(words, long, starts)
    is_chunk = np.arange(len(first) + len(from_)) < len(first)
    first, last = np.concatenate([first, from_]), np.concatenate([last, to])
    text = np.searchsorted(starts, first, side="right") - 1
    order = np.argsort(text, kind="stable")
    first, last, text, is_chunk = first[order], last[order], text[order], is_chunk[order]
    digests = _digests(lines, seed) if seed else own
    out = []
    for k, base in enumerate(_BASES):
        sums = np.zeros(len(lines) + 1, np.uint64)
        np.cumsum(digests[:, k] * _powers(base, len(lines)), out=sums[1:])
        sums = (sums[last + 1] - sums[first]) * _powers(pow(base, -1, 1 << 64), len(lines))[first]
        sums[is_chunk] ^= np.uint64(_BASES[1])  # chunks meet chunks, windows windows
        out.append(sums)
    if hash_bits < 64:
        out = [out[0] >> np.uint64(64 - hash_bits), np.zeros_like(out[1])]
    return Spans(lines, starts, digests, text, first, last, is_chunk, out[0].view(np.int64), out[1].view(np.int64))


def doc_order():
    """Order of documents: ids first, then rows without one by a hash of their text."""

    by_text = F.lit(_LAST) - F.pmod(F.xxhash64("text"), F.lit(1 << 48))
    return F.coalesce(F.col("doc_id").cast("long"), by_text)


def span_table(docs: DataFrame, seed: int = 0, hash_bits: int = 64) -> DataFrame:
    """``ord, key, h, g``: a row for each different span of each row; ``key`` names its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                found = spans(texts, seed, hash_bits)
                order = np.lexsort((found.g, found.h, found.text))
                pair = np.stack([found.text, found.h, found.g], 1)[order]
                pair = pair[np.append(True, (pair[1:] != pair[:-1]).any(axis=1))] if len(pair) else pair
                take = pa.array(pair[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(pair[:, 1]), pa.array(pair[:, 2])],
                    names=["ord", "key", "h", "g"])

    return docs.select(doc_order().alias("ord"), F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, "ord long, key long, h long, g long")


def _marks(repeated: DataFrame) -> np.ndarray:
    """Bit table of the first halves of the repeated spans; a fixed 8 MB whatever their number."""

    bit = F.col("h").bitwiseAND(F.lit(MARKS - 1))
    words = repeated.select(F.shiftright(bit, 5).alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("mark"))
    table = np.zeros(MARKS // 32, np.int64)
    # at most MARKS / 32 rows
    for batch in words.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.astype(np.uint32)


def ambiguous(docs: DataFrame, repeated: DataFrame, seed: int = 0, hash_bits: int = 64) -> DataFrame:
    """Hashes of repeated spans, or of lines in them, that stand for different bytes."""

    marks = docs.sparkSession.sparkContext.broadcast(_marks(repeated))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            for _, texts in text_blocks(batch):
                rows: dict[tuple, bytes] = {}
                more: list[tuple] = []  # an equal hash with other bytes
                found = spans(texts, seed, hash_bits)
                bit = found.h & (MARKS - 1)
                own = np.flatnonzero(table[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
                covered = np.zeros(len(found.lines) + 1, np.int64)
                np.add.at(covered, found.first[own], 1)
                np.add.at(covered, found.last[own] + 1, -1)
                whole, signed = found.digests.tobytes(), found.digests.view(np.int64)
                items = [((0, h, g), whole[16 * i:16 * j + 16]) for h, g, i, j in zip(
                    *(c[own].tolist() for c in (found.h, found.g, found.first, found.last)))]
                at = np.flatnonzero(np.cumsum(covered[:-1]))
                items += [((1, *name), found.lines[i].encode("utf-8", "surrogatepass"))
                          for i, name in zip(at.tolist(), signed[at].tolist())]
                for name, value in items:
                    if rows.setdefault(name, value) != value:
                        more.append((name, value))
                some = [*rows.items(), *more]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([name[k] for name, _ in some], pa.int64()) for k in range(3)),
                     pa.array([value for _, value in some], pa.binary())], names=["what", "h", "g", "value"])

    found = docs.select("text").mapInArrow(run, "what long, h long, g long, value binary")
    return (found.groupBy("what", "h", "g").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
            .filter("least <> greatest").select("what", "h", "g"))


def removals(docs: DataFrame, hash_bits: int = 64) -> tuple[DataFrame, int, int]:
    """``ord, key, gone`` (hashes of the spans that an earlier document holds), and the seed and bits that proved them."""

    for seed in count():
        bits = hash_bits if not seed else 64
        table = written(span_table(docs, seed, bits))
        repeated = written(table.groupBy("h", "g").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
                           .filter("first < last").select("h", "g", "first"))
        if ambiguous(docs, repeated, seed, bits).isEmpty():
            break
    gone = table.join(repeated, ["h", "g"]).filter("ord > first")
    return gone.groupBy("ord", "key").agg(F.collect_set(F.struct("h", "g")).alias("gone")), seed, bits


def kept_texts(texts: list[str], gone: list[set[tuple[int, int]]], seed: int = 0, hash_bits: int = 64,
               ) -> list[tuple[str, int]]:
    """Of each text (what is left without its spans in ``gone`` and without repeats inside it, lines removed)."""

    found = spans(texts, seed, hash_bits)
    order = np.lexsort((found.h, found.text))
    same = (np.diff(found.text[order]) == 0) & (np.diff(found.h[order]) == 0)
    again = set(found.text[order][1:][same].tolist())
    upto = np.searchsorted(found.text, np.arange(len(texts) + 1))
    out = []
    for t, (text, lost) in enumerate(zip(texts, gone)):
        if not lost and t not in again:
            out.append((text, 0))
            continue
        start, own = int(found.starts[t]), slice(upto[t], upto[t + 1])
        lines = found.lines[start:int(found.starts[t + 1])]
        off, ends = np.zeros(len(lines), bool), {}
        for chunk, i, j, h, g in zip(found.is_chunk[own].tolist(), (found.first[own] - start).tolist(),
                                     (found.last[own] - start).tolist(), found.h[own].tolist(), found.g[own].tolist()):
            if (h, g) in lost:
                off[i:j + 1] = True
            elif t in again and ends.setdefault((chunk, *lines[i:j + 1]), j) < (j if chunk else i):
                off[i:j + 1] = True  # the same lines, compared as text, stand before
        out.append(("\n".join([line for line, o in zip(lines, off.tolist()) if not o]), int(off.sum())) if off.any() else (text, 0))
    return out


def dedup_lines(docs: DataFrame, hash_bits: int = 64, report: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with repeated spans removed from ``text``.

    ``report``: name of a further column with the number of lines removed.
    """

    lists, seed, bits = removals(docs, hash_bits)
    lists = lists.select(F.col("ord").alias(_ORDER), F.col("key").alias(_KEY), F.col("gone").alias("__gone"))
    marked = docs.withColumns({_ORDER: doc_order(), _KEY: F.xxhash64("text")})
    met = marked.join(lists, [_ORDER, _KEY], "left").select(*(F.col(f"`{c}`") for c in docs.columns), "__gone")
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                at = part.schema.get_field_index("text")
                null = part.column(at).is_null().to_pylist()
                lists = part.column(width)
                gone = []
                for i in range(len(texts)):
                    own = lists[i].values
                    gone.append(set(zip(own.field(0).to_pylist(), own.field(1).to_pylist())) if own is not None else set())
                kept = kept_texts(texts, gone, seed, bits)
                new = [None if none else text for (text, _), none in zip(kept, null)]
                removed = [n for _, n in kept]
                columns = part.columns
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())],
                                                 names=[*part.schema.names, "__removed"])

    out = map_rows(met, run, [StructField("__removed", LongType())]).drop("__gone")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnRenamed("__removed", report) if report else out.drop("__removed")


def text_digest(column: str):
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
