"""Exact deduplication by composable polynomial fingerprints (operator 13).

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only.  A text's
bytes b0, b1, ... have the fingerprint ``b0 + b1*B + b2*B^2 + ... mod P``, for two
bases B packed into one long.  It composes: of texts x and y, ``f(xy) = f(x) +
B^len(x) * f(y)``.  So every chunk of ``CHUNK`` bytes is hashed by itself, shifted by
the length before it, and the sum over a text's chunks, in any order, is the text's
fingerprint.  All chunks of a block of rows are hashed side by side in numpy; a text
of more than ``HUGE`` bytes is dealt out chunk by chunk, so many tasks hash it, and
its shifted hashes meet in a sum.

Equal fingerprints (with equal lengths) prove nothing, so every group of them is
compared as a stream of chunks: for each chunk number the least and the greatest
chunk of the group must be the same bytes.  If any group fails, all is done again
with two more bases, until every group is proved equal.

*Scale.*  The text is read twice and never shuffled whole.  The first pass writes one
narrow row a document (and the chunks of huge ones).  The second sends on only texts
whose fingerprint is marked in a bit table of the repeated ones; the table has a fixed
size (``MARKS`` bits, 8 MB), and a mark set by another fingerprint only costs work.
The comparison is a least and greatest per chunk, summed up in each task before the
shuffle: a text with a third of all rows as copies is one row from each task.  The
join that names the row to keep can be split by Spark where one group is large.

Defined results: null text is an empty one; empty texts are copies of each other;
among rows without a ``doc_id`` or with the same one exactly one row stays, and a
row without one only where no copy has one; no rows for an empty table; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import written

CHUNK = 1 << 16
HUGE = 1 << 18
#: The largest prime under 2^31: a byte times a power, summed over a chunk, fits 64 bits.
MODULUS = (1 << 31) - 1
MARKS = 1 << 26
#: Bytes hashed at once.
BLOCK = 1 << 22

ROWS = "row long, doc_id long, n_bytes long, sha binary, prints array<long>, no int, chunk binary"


def base(k: int, modulus: int) -> int:
    """The k-th base: fixed, spread over the residues."""

    return int.from_bytes(hashlib.sha256(b"base %d" % k).digest()[:8], "little") % (modulus - 2) + 2


@lru_cache(maxsize=8)
def _powers(k: int, modulus: int, chunk: int) -> np.ndarray:
    out, one, b = np.empty(chunk, np.uint64), 1, base(k, modulus)
    for i in range(chunk):
        out[i] = one
        one = one * b % modulus
    return out


def chunk_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bases: int,
                 modulus: int = MODULUS, chunk: int = CHUNK) -> np.ndarray:
    """Unshifted hashes (a row of each base) of chunks that lie at ``starts`` in ``data``, none empty."""

    out = np.empty((bases, len(starts)), np.int64)
    first = 0
    ends = np.cumsum(sizes)
    while first < len(starts):
        begun = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, begun + BLOCK, side="right")))
        own = sizes[first:last]
        at = np.zeros(len(own), np.int64)
        np.cumsum(own[:-1], out=at[1:])
        within = np.arange(int(own.sum())) - np.repeat(at, own)
        values = data[within + np.repeat(starts[first:last], own)].astype(np.uint64)
        for k in range(bases):
            out[k, first:last] = np.add.reduceat(values * _powers(k, modulus, chunk)[within], at) % np.uint64(modulus)
        first = last
    return out


def shifted(hashes: np.ndarray, before: np.ndarray, modulus: int = MODULUS) -> np.ndarray:
    """Hashes times B to the number of bytes before each chunk."""

    out = hashes.copy()
    for k in range(len(hashes)):
        b = base(k, modulus)
        for i in np.flatnonzero(before):
            out[k, i] = int(hashes[k, i]) * pow(b, int(before[i]), modulus) % modulus
    return out


def packed(sums: np.ndarray, modulus: int = MODULUS) -> np.ndarray:
    """Sums of shifted hashes of each base -> longs of two residues each, by row."""

    residues = sums % modulus
    return (residues[0::2] << 31 | residues[1::2]).T


def fingerprints(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bases: int,
                 modulus: int = MODULUS, chunk: int = CHUNK) -> np.ndarray:
    """Packed fingerprints, by row, of the texts at ``starts`` in ``data``."""

    n = -(-sizes // chunk)
    owner = np.repeat(np.arange(len(sizes)), n)
    before = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * chunk
    own = np.minimum(sizes[owner] - before, chunk)
    hashes = shifted(chunk_hashes(data, starts[owner] + before, own, bases, modulus, chunk), before, modulus)
    sums = np.zeros((bases, len(sizes)), np.int64)
    for k in range(bases):
        np.add.at(sums[k], owner, hashes[k])
    return packed(sums, modulus)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes with A-Z lower-cased, starts, sizes) of an Arrow text or binary column; null: empty."""

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    values = column.buffers()[2]
    data = np.frombuffer((values.slice(first, last - first).to_pybytes() if values else b"").lower(), np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return data, offsets[:-1] - first, sizes


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``BLOCK`` bytes of text."""

    data, starts, sizes = lowered(batch.column(at))
    first, ends = 0, np.cumsum(sizes)
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + BLOCK, side="right")))
        yield batch.slice(first, last - first), data, starts[first:last], sizes[first:last]
        first = last


def _cut(data: np.ndarray, start: int, size: int, chunk: int) -> list[bytes]:
    return [data[start + i:start + min(i + chunk, size)].tobytes() for i in range(0, size, chunk)]


def fingerprint_rows(docs: DataFrame, bases: int = 2, modulus: int = MODULUS, chunk: int = CHUNK,
                     huge: int = HUGE) -> tuple[DataFrame, DataFrame]:
    """(``row, doc_id, n_bytes, sha, prints`` of every row, ``row, no, chunk`` of huge ones), both written."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "n_bytes", "sha", "prints", "no", "chunk"]
        for batch in batches:
            for part, data, starts, sizes in _parts(batch, 2):
                small = sizes <= huge
                prints: list = [None] * len(sizes)
                for i, p in zip(np.flatnonzero(small), fingerprints(data, starts[small], sizes[small], bases, modulus, chunk).tolist()):
                    prints[i] = p
                whole = memoryview(data)
                sha = [hashlib.sha256(whole[a:a + n]).digest() for a, n in zip(starts.tolist(), sizes.tolist())]
                none = pa.nulls(len(sizes))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes), pa.array(sha, pa.binary()),
                     pa.array(prints, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
                for i in np.flatnonzero(~small):
                    row = part.column(0)[int(i)].as_py()
                    pieces = _cut(data, int(starts[i]), int(sizes[i]), chunk)
                    for a in range(0, len(pieces), 64):
                        some = pieces[a:a + 64]
                        none = pa.nulls(len(some))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row] * len(some)), none.cast(pa.int64()), none.cast(pa.int64()),
                             none.cast(pa.binary()), none.cast(pa.list_(pa.int64())),
                             pa.array(range(a, a + len(some)), pa.int32()), pa.array(some, pa.binary())], names=names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, starts, sizes in _parts(batch, 2):
                before = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64) * chunk
                sums = shifted(chunk_hashes(data, starts, sizes, bases, modulus, chunk), before, modulus)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(s) for s in sums)],
                                                 names=["row", *(f"h{k}" for k in range(bases))])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(rows.mapInArrow(heads, ROWS))
    chunks = table.filter("no is not null").select("row", "no", "chunk")
    all_heads = table.filter("no is null").select("row", "doc_id", "n_bytes", "sha", "prints")
    schema = "row long, " + ", ".join(f"h{k} long" for k in range(bases))
    spread = chunks.repartition(docs.sparkSession.sparkContext.defaultParallelism * 4)
    residue = [F.pmod(F.sum(f"h{k}"), F.lit(modulus)) for k in range(bases)]
    pairs = [F.call_function("shiftleft", a, F.lit(31)).bitwiseOR(b) for a, b in zip(residue[::2], residue[1::2])]
    sums = spread.mapInArrow(hashed, schema).groupBy("row").agg(F.array(*pairs).alias("sums"))
    whole = (all_heads.filter("prints is null").join(sums, "row")
             .select("row", "doc_id", "n_bytes", "sha", F.col("sums").alias("prints")))
    return all_heads.filter("prints is not null").unionByName(whole), chunks


def _marks(groups: DataFrame) -> np.ndarray:
    """Bit table of the first longs of the groups' fingerprints; a fixed 8 MB whatever their number."""

    bit = F.col("prints")[0].bitwiseAND(F.lit(MARKS - 1))
    words = groups.select(F.shiftright(bit, 5).alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(31)).cast("int")).alias("mark"))
    table = np.zeros(MARKS // 32, np.int64)
    # at most MARKS / 32 rows
    for batch in words.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.astype(np.uint32)


def unequal_groups(docs: DataFrame, rows: DataFrame, chunks: DataFrame, groups: DataFrame, bases: int,
                   modulus: int = MODULUS, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """``prints, n_bytes, no``: where the texts of a group of equal fingerprints differ."""

    marks = docs.sparkSession.sparkContext.broadcast(_marks(groups))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = marks.value
        for batch in batches:
            for _, data, starts, sizes in _parts(batch, 0):
                small = np.flatnonzero((sizes > 0) & (sizes <= huge))
                starts, sizes = starts[small], sizes[small]
                prints = fingerprints(data, starts, sizes, bases, modulus, chunk)
                bit = prints[:, 0] & (MARKS - 1)
                own = np.flatnonzero(table[bit >> 5] >> (bit & 31).astype(np.uint32) & 1)
                cut = [_cut(data, int(starts[i]), int(sizes[i]), chunk) for i in own]
                n = [len(c) for c in cut]
                owner = np.repeat(own, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[owner].tolist(), pa.list_(pa.int64())), pa.array(sizes[owner]),
                     pa.array([i for k in n for i in range(k)], pa.int32()),
                     pa.array([c for x in cut for c in x], pa.binary())], names=["prints", "n_bytes", "no", "chunk"])

    found = docs.select("text").mapInArrow(pieces, "prints array<long>, n_bytes long, no int, chunk binary")
    large = (rows.filter(F.col("n_bytes") > huge).join(groups.select("prints", "n_bytes"), ["prints", "n_bytes"])
             .select("row", "prints", "n_bytes").join(chunks, "row").select("prints", "n_bytes", "no", "chunk"))
    return (found.unionByName(large).groupBy("prints", "n_bytes", "no")
            .agg(F.min("chunk").alias("least"), F.max("chunk").alias("greatest"))
            .filter("least <> greatest").select("prints", "n_bytes", "no"))


def exact_duplicates(docs: DataFrame, modulus: int = MODULUS, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, and ``n_bases`` that it took."""

    bases = 2
    while True:
        rows, chunks = fingerprint_rows(docs, bases, modulus, chunk, huge)
        rows = written(rows)
        groups = written(rows.groupBy("prints", "n_bytes").agg(
            F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).filter("group_size > 1"))
        if unequal_groups(docs, rows, chunks, groups, bases, modulus, chunk, huge).isEmpty():
            break
        bases += 2
    keep_row = F.coalesce(F.col("keep.row"), F.col("row"))
    return rows.join(groups, ["prints", "n_bytes"], "left").select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (keep_row == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.lit(bases).alias("n_bases"))


def drop_duplicates(docs: DataFrame, modulus: int = MODULUS, chunk: int = CHUNK, huge: int = HUGE) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that agree in ``doc_id`` and text are alike, one stays."""

    digest = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    found = written(exact_duplicates(docs.select("doc_id", "text"), modulus, chunk, huge))
    kept = found.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_sha"))
    marked = docs.withColumns({"__sha": digest, "__alike": F.monotonically_increasing_id()})
    met = written(marked.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__sha") == F.col("__kept_sha")),
                              "left_semi"))
    first = met.groupBy("doc_id", "__sha").agg(F.min("__alike").alias("__alike")).select("__alike")
    return met.join(first, "__alike", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
