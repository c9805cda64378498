"""Packing by first-fit decreasing over a tournament tree (operator 7).

Every document becomes its token ids and one end id.  A document of more than
``capacity`` ids gives full sequences first; what is left of it (fewer ids than
``capacity``) is packed with other documents' rests: documents are dealt at
random into groups of about ``group_docs`` and each group is packed by itself,
in one task and with memory for one group.  In a group the rests go, longest
first, to the first bin with enough room.  A tournament tree over the bins'
free room (each node holds the larger of its two children) finds that bin in
logarithmic time.

A sequence is padded to ``capacity`` unless its length is a power of two.

The ids are those of the ``tokenizers`` file of the same vocabulary, made from
its rank file by ``tiktoken``, which takes about a third of the time.  Its pattern
search fails in a run of about a million whitespace characters, so the words of
runs of ``LONG_SPACE`` or more are cut out beforehand and merged without the search.

Group and sequence numbers follow from the row's place in the input's
partitions, so they are the same again when a lost task is run anew over the
same files; the pieces are written to the shared folder between the two stages.

Defined results: null text is empty and gives the end id alone; special strings
in a text become their ids (the library's default); repeated rows and rows with
null ``doc_id`` are documents of their own; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import text_blocks, written

#: The vocabulary as the file names of two libraries; both give the same ids.
RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: Whitespace characters in a row, as the pattern's space class has them.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)
CAPACITY = 1_024
GROUP_DOCS = 2_048
#: Sequence numbers set aside for a group, as a power of two.
GROUP_BITS = 24


class TournamentTree:
    """First bin with room for a size: ``first_fit`` adds to it, or opens a bin."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)
        self.opened = 0

    def first_fit(self, size: int) -> tuple[int, int]:
        """(bin, free room that it had) of the first bin with room for ``size``."""

        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin is left that can hold the item")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        self.opened = max(self.opened, node - self.leaves + 1)
        found = node - self.leaves
        room[node] = had - size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; longest first, ties in the given order."""

    tree = TournamentTree(max(1, len(sizes)), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found, had = tree.first_fit(sizes[i])
        out[i] = (found, capacity - had)
    return out


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=SPECIAL)


def encode(encoder, text: str) -> np.ndarray:
    """All ids of a text.

    A long run of whitespace is one word of the pattern: up to its last character,
    or whole where a special string or the end of the text follows.
    """

    if len(text) < LONG_SPACE:
        return encoder.encode_to_numpy(text, allowed_special="all")
    parts, start = [], 0
    for m in _LONG_SPACE.finditer(text):
        whole = m.end() == len(text) or text.startswith(tuple(SPECIAL), m.end())
        end = m.end() if whole else m.end() - 1
        parts.append(encoder.encode_to_numpy(text[start:m.start()], allowed_special="all"))
        parts.append(np.array(encoder._encode_single_piece(text[m.start():end]), np.uint32))
        start = end
    return np.concatenate([*parts, encoder.encode_to_numpy(text[start:], allowed_special="all")])


def token_pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY,
                 end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Each document's ids, cut at multiples of ``capacity``: one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path)
        for batch in batches:
            for part, texts in text_blocks(batch):
                row_ids, doc_ids = part.column(0).to_pylist(), part.column(1).to_pylist()
                cols: list[list] = [[] for _ in range(7)]
                for row, doc, text in zip(row_ids, doc_ids, texts):
                    ids = np.append(encode(encoder, text), end_id).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start:start + capacity]
                        for col, value in zip(cols, (row, doc, start, len(piece), zlib.crc32(piece.tobytes()),
                                                     len(ids), piece.astype(np.int32) if keep_ids else None)):
                            col.append(value)
                types = [pa.int64()] * 6 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)],
                    names=["row_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    source = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    pieces = source.mapInArrow(run, "row_id long, doc_id long, start long, length long, ids_crc32 long, "
                                    "doc_tokens long, ids array<int>")
    return pieces if keep_ids else pieces.drop("ids")


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0,
                   group_docs: int = GROUP_DOCS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]``.

    Only rests (one per document at most) are shuffled, by group.
    """

    pieces = written(token_pieces(docs, ranks_path, capacity, end_id, keep_ids))
    payload = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if keep_ids else [])
    rests = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_docs))

    # a full piece is a sequence: even numbers, unique by row and place
    full = pieces.filter(F.col("length") == capacity).withColumn("at", F.monotonically_increasing_id())
    full = full.select(*payload, (F.col("at") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_id")
        placed = first_fit_decreasing(rows["length"].to_pylist(), capacity)
        # odd numbers: each group has a range of its own
        first = key[0].as_py() << GROUP_BITS
        sequence = pa.array([(first + found) * 2 + 1 for found, _ in placed], pa.int64())
        offset = pa.array([offset for _, offset in placed], pa.int64())
        return rows.select(payload).append_column("sequence_id", sequence).append_column("offset", offset)

    out_schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                  + ("ids array<int>, " if keep_ids else "") + "sequence_id long, offset long")
    grouped = rests.withColumn("grp", F.pmod(F.xxhash64("row_id"), F.lit(groups)))
    return full.unionByName(grouped.groupBy("grp").applyInArrow(pack_group, out_schema))
