"""Merkle manifest of a dataset by time-forward processing (operator 11).

Every document is a leaf.  Per source, leaves ascend by ``doc_id`` and every ``FANOUT``
consecutive nodes of a level (the last run may be shorter) become one node, until one
is left: the source's subroot.  Subroots, ordered by source, give the root alike.

Nodes are labelled by (last leaf below, level), so children come before their
parents.  Processing nodes in that order, each sends its digest to its parent through
a priority queue ordered by the receiver's label; a node whose label comes up takes
its messages, hashes them and sends on.  The queue is external: leaves are cut into
blocks of ``FANOUT ** LEVELS``; messages between blocks travel through Spark's sorted
shuffle, which brings every block its nodes in the order of labels and spills to disk,
and inside a block a heap holds what is under way.  Each round of blocks makes their
tops, which are the next round's nodes.  A sweep in the reversed order then sends
each node's proof suffix, the digests beside the path from it to the root, to its
children: along the same blocks, a block's message first, down to the leaves.

*Scale.*  Positions are exact without a window over a source: leaves are dealt out by
range of (source, doc_id, digest, row), sorted there, and the counts of each source in
each range are summed up, so a source with a third of all rows is many ranges.  A
task holds one block (256 nodes) and one suffix (a few KB).  Only the root, one
row, comes to the driver.  Text is read once and leaves the first stage as 32 bytes.

Defined results: a null field counts as ``-``; rows without a ``doc_id`` come first in
their source, rows that agree in ``doc_id`` are ordered by digest and equal rows are
leaves each; the null source is a source of its own; a lone leaf is its subroot, a lone
subroot the root; no rows for an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import BLOCK_CHARS, written

FANOUT, LEVELS = 16, 2
#: Where this divides the crc32 of the decimal id, a leaf is tampered with.
TAMPER = 5


def _h(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


# -- leaves -------------------------------------------------------------------

def field(column: str) -> Column:
    """``-`` for null, else byte count, colon, value."""

    value = F.col(column).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def source_key(column: str = "source") -> Column:
    """Null first, then by UTF-8 bytes."""

    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def leaves(docs: DataFrame, tamper: int = TAMPER) -> DataFrame:
    """``g, doc_id, leaf, altered`` of every row; ``altered`` is the tampered leaf, null where none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(4)), 0).to_pylist()
            first = held = 0
            for i in range(len(sizes) + 1):
                if i == len(sizes) or held + sizes[i] > BLOCK_CHARS:
                    if i > first:
                        yield digests(batch.slice(first, i - first))
                    first, held = i, 0
                held += sizes[i] if i < len(sizes) else 0

    def digests(part: pa.RecordBatch) -> pa.RecordBatch:
        plain, changed = [], []
        for head, own, text in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
            before = hashlib.sha256(head)
            before.update(b"-" if text is None else b"%d:" % len(text))
            after = before.copy() if own else None
            if text is not None:
                before.update(text)
                if own:
                    after.update(text.lower())
            plain.append(before.digest())
            changed.append(after.digest() if own else None)
        return pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(plain, pa.binary()), pa.array(changed, pa.binary())],
            names=["g", "doc_id", "leaf", "altered"])

    head = F.concat(field("doc_id"), field("source"), field("lang"), field("n_chars"))
    own = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper == 0, F.lit(False))
    return docs.select(
        source_key().alias("g"), F.col("doc_id").cast("long").alias("doc_id"), head.cast("binary").alias("head"),
        own.alias("own"), F.col("text").cast("binary").alias("text"),
    ).mapInArrow(run, "g string, doc_id long, leaf binary, altered binary")


# -- positions ----------------------------------------------------------------

def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``pos`` (from 0) by ``order`` among the rows of its ``g``, and their number ``n``."""

    keys = ["g", *order]
    dealt = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the range, by Spark's numbering
    dealt = dealt.withColumn("part", part)
    counts = dealt.groupBy("g", "part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("own"))
    of_group = Window.partitionBy("g")
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.select("g", "part", "least", F.sum("own").over(of_group).alias("n"),
                                   F.coalesce(F.sum("own").over(before), F.lit(0).cast("long")).alias("before")))
    return dealt.join(counts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("least")).select(
        *df.columns, "pos", "n")


# -- a block ------------------------------------------------------------------

def level_counts(n: int, fanout: int = FANOUT, levels: int = LEVELS) -> list[int]:
    """Nodes of the whole group at the levels that a block spans."""

    counts = [n]
    while len(counts) <= levels and counts[-1] > 1:
        counts.append(-(-counts[-1] // fanout))
    return counts


def forward(first: int, digests: list[bytes], n: int, fanout: int = FANOUT, levels: int = LEVELS) -> dict:
    """``(level, index) -> digest`` of all nodes over a block that begins at position ``first``."""

    counts = level_counts(n, fanout, levels)
    top, nodes, queue = len(counts) - 1, {}, []

    def send(level: int, index: int, digest: bytes) -> None:
        nodes[level, index] = digest
        if level < top:
            parent = index // fanout
            last = min((parent + 1) * fanout ** (level + 1), n) - 1
            heappush(queue, (last, level + 1, index, digest))

    for pos, digest in enumerate(digests, first):
        send(0, pos, digest)
        while queue and queue[0][0] == pos:
            last, level, index, received = heappop(queue)
            parts = [received]
            while queue and queue[0][:2] == (last, level):
                parts.append(heappop(queue)[3])
            send(level, index // fanout, _h(b"".join(parts)))
    return nodes


def backward(nodes: dict, n: int, suffix: tuple[bytes, bytes, bytes], fanout: int = FANOUT, levels: int = LEVELS,
             ) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
    """Position and proof of each lowest node, from the last on; ``suffix`` is the proof of the block's top.

    A proof is (digests beside the path, place of the path in each run, size of each run).
    """

    counts = level_counts(n, fanout, levels)
    top = max(nodes)
    queue = [(-n, -top[0], -top[1], suffix)]
    while queue:
        _, level, index, (path, turns, sizes) = heappop(queue)
        level, index = -level, -index
        if not level:
            yield index, (path, turns, sizes)
            continue
        below = range(index * fanout, min((index + 1) * fanout, counts[level - 1]))
        run = b"".join([nodes[level - 1, i] for i in below])
        grown = bytes([len(below)]) + sizes
        for k, i in enumerate(below):
            last = min((i + 1) * fanout ** (level - 1), n) - 1
            heappush(queue, (-last, 1 - level, -i, (run[:64 * k] + run[64 * k + 64:] + path, bytes([k]) + turns, grown)))


def fold(leaf: bytes, path: bytes, turns: bytes, sizes: bytes) -> bytes:
    """The root that a leaf and its proof give."""

    at = 0
    for k, size in zip(turns, sizes):
        left, at = path[at:at + 64 * k], at + 64 * k
        right, at = path[at:at + 64 * (size - 1 - k)], at + 64 * (size - 1 - k)
        leaf = _h(left + leaf + right)
    return leaf


# -- sweeps -------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one block after the other; the first two columns name it."""

    name, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != name:
                if rows:
                    yield rows
                name, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def sweep_up(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``g, pos, n, digest`` of the tops of all blocks of ``nodes``."""

    width = fanout ** levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in _blocks(batches):
            g, block, first, n, _ = rows[0]
            made = forward(first, [r[4] for r in rows], n, fanout, levels)
            out.append((g, block, -(-n // width), made[max(made)]))
            if len(out) == 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                          names=["g", "pos", "n", "digest"])

    return (nodes.select("g", F.expr(f"pos div {width}").alias("block"), "pos", "n", "digest")
            .repartition("g", "block").sortWithinPartitions("g", "block", "pos")
            .mapInArrow(run, "g string, pos long, n long, digest binary"))


PROOF = "path binary, turns binary, sizes binary"


def sweep_down(nodes: DataFrame, messages: DataFrame, carried: dict[str, str], finish: Callable, schema: str,
               fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Rows that ``finish`` makes of each node and its proof.

    ``messages``: ``g, pos`` (of a block's top), its proof and ``top``, which goes on unchanged.
    ``carried``: further columns of ``nodes`` with their types.  ``finish`` gets (g, pos,
    digest, proof, top, carried values) and gives a tuple for ``schema``.
    """

    width = fanout ** levels
    kinds = [f.split(" ")[1] for f in schema.split(", ")]
    names = [f.split(" ")[0] for f in schema.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for message, *rows in _blocks(batches):
            g, _, _, n, _, path, turns, sizes, top = message[:9]
            n = rows[0][3]
            made = forward(rows[0][2], [r[4] for r in rows], n, fanout, levels)
            first = rows[0][2]
            for pos, proof in backward(made, n, (path, turns, sizes), fanout, levels):
                row = rows[pos - first]
                out.append(finish(g, pos, row[4], proof, top, row[9:]))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(zip(*rows), kinds)], names=names)

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    sent = messages.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), null("long").alias("n"),
                           null("binary").alias("digest"), "path", "turns", "sizes", "top",
                           *(null(t).alias(c) for c, t in carried.items()))
    own = nodes.select("g", F.expr(f"pos div {width}").alias("block"), "pos", "n", "digest",
                       *(null("binary").alias(c) for c in ("path", "turns", "sizes", "top")), *carried)
    return (own.unionByName(sent).repartition("g", "block").sortWithinPartitions("g", "block", "pos")
            .mapInArrow(run, schema))


def build(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """The nodes of each round of blocks, ``nodes`` first; in the last every group has one node."""

    rounds = [nodes]
    while not rounds[-1].filter("n > 1").isEmpty():
        rounds.append(written(sweep_up(rounds[-1], fanout, levels)))
    return rounds


def deliver(rounds: list[DataFrame], messages: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Messages for the blocks of the first round, from those for the single nodes of the last."""

    def on(g, pos, digest, proof, top, _):
        return (g, pos, *proof, top)

    for nodes in rounds[:0:-1]:
        messages = written(sweep_down(nodes, messages, {}, on, f"g string, pos long, {PROOF}, top binary", fanout, levels))
    return messages


def manifest(docs: DataFrame, tamper: int = TAMPER, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""

    made = written(leaves(docs, tamper).withColumn("row", F.monotonically_increasing_id()))
    placed = written(positions(made, ["doc_id", "leaf", "row"]).select(
        "g", "pos", "n", F.encode(F.lower(F.hex("leaf")), "UTF-8").alias("digest"), "doc_id",
        F.encode(F.lower(F.hex("altered")), "UTF-8").alias("altered")))
    trees = build(placed, fanout, levels)

    subroots = trees[-1].select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    forest = build(written(positions(subroots, ["source"])), fanout, levels)
    root = forest[-1].select("digest").first()
    root = bytes(root.digest) if root else b""
    start = forest[-1].select("g", "pos", *(F.lit(b"").alias(c) for c in ("path", "turns", "sizes", "top")))
    to_sources = deliver(forest, start, fanout, levels)

    def of_source(g, pos, digest, proof, top, carried):
        return (carried[0], 0, *proof, digest)

    to_trees = written(sweep_down(forest[0], to_sources, {"source": "string"}, of_source,
                                  f"g string, pos long, {PROOF}, top binary", fanout, levels))
    to_leaves = deliver(trees, to_trees, fanout, levels)

    def proved(g, pos, digest, proof, top, carried):
        doc_id, altered = carried
        folded = fold(altered or digest, *proof)
        return doc_id, digest, top, root, _h(proof[0]), folded, folded == root

    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    rows = sweep_down(placed, to_leaves, {"doc_id": "long", "altered": "binary"}, proved,
                      "doc_id long, " + ", ".join(f"{c} binary" for c in names) + ", verified boolean", fanout, levels)
    return rows.withColumns({c: F.decode(c, "UTF-8") for c in names})
