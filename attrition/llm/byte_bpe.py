"""Byte-level BPE encoding and decoding over padded matrices (operator 4).

Pieces (matches of the split pattern) are encoded many at a time.  The distinct
pieces of a block of documents are put into buckets of like length, each bucket
one numpy matrix with a row of token ids per piece, padded with -1.  In every
round each row merges its leftmost pair of minimum rank: ``argmin`` over the
matrix of pair ranks finds it, the two cells become one and every row is
compacted by one cell; only the two pairs beside the merged cell are looked up
anew.  Rows with no pair left leave the matrix.  Pair ranks come from an open
addressing hash table over (left id, right id).

A piece that is itself in the vocabulary is one token, as in the library.
Pieces of more than ``LONG_PIECE`` bytes (runs without a split, for instance
100,000 equal letters) would take as many rounds as they have bytes; they go
through a linked list with a heap, which picks the same pair each time.

Defined results: null text is empty (no ids); text is never normalised; special
strings are ordinary text; repeated rows each give a row; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrition.llm.common import text_blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
LONG_PIECE = 512
#: Cells of one padded matrix.
MATRIX_CELLS = 1_500_000
#: Encoded pieces kept by a worker between blocks: beyond this many the store
#: becomes the old store, and pieces not asked for again go with the next change.
KEPT_PIECES = 150_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the joined token, by vectorised open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(4, int(len(left) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._hash(keys)
        left_over = np.arange(len(keys))
        while len(left_over):
            at = slot[left_over]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left_over[free]]  # of several, the last stays
            won = self.keys[at] == keys[left_over]
            self.values[at[won]] = joined[left_over[won]]
            left_over = left_over[~won]
            slot[left_over] = (slot[left_over] + 1) & (size - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._hash(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((held != keys) & (held != -1) & (left >= 0) & (right >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class ByteBpe:
    """Encoder and decoder over a rank file; the id of a token is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, joined = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, joined)

    # -- encoding -----------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, in order."""

        out: list[list[int]] = [[]] * len(pieces)
        left = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = [rank]
            elif len(piece) > LONG_PIECE:
                out[i] = self._encode_long(piece)
            elif piece:
                left.append(i)
        left.sort(key=lambda i: len(pieces[i]))
        start = 0
        while start < len(left):
            # a bucket: like lengths (the longest is at most a quarter longer), bounded cells
            end, low = start, len(pieces[left[start]])
            while end < len(left) and (width := len(pieces[left[end]])) <= low + 2 + low // 4 \
                    and (end - start + 1) * width <= MATRIX_CELLS:
                end += 1
            bucket = left[start:end]
            for i, ids in zip(bucket, self._encode_bucket([pieces[i] for i in bucket])):
                out[i] = ids
            start = end
        return out

    def _encode_bucket(self, pieces: list[bytes]) -> list[list[int]]:
        width = max(map(len, pieces))
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rows = np.arange(len(pieces))
        out: list[list[int]] = [[]] * len(pieces)
        while len(rows):
            n, width = ids.shape
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(n, np.int64)
            every = np.arange(n)
            best = ranks[every, at] if width > 1 else np.full(n, _NONE)
            done = best == _NONE
            if done.any():
                for row, cells in zip(rows[done].tolist(), ids[done].tolist()):
                    out[row] = cells[:cells.index(-1)] if cells[-1] < 0 else cells
                go = ~done
                rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
                n = len(rows)
                every = np.arange(n)
                if not n:
                    break
            # merge, then drop the right cell of the pair: every row shrinks by one
            ids[every, at] = best
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            if width == 2:
                ranks = np.zeros((n, 0), np.int32)
                continue
            keep = np.ones((n, width - 1), bool)
            keep[every, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            rest = np.flatnonzero(at < width - 2)
            ranks[rest, at[rest]] = self.pairs.get(ids[rest, at[rest]], ids[rest, at[rest] + 1])
            rest = np.flatnonzero(at > 0)
            ranks[rest, at[rest] - 1] = self.pairs.get(ids[rest, at[rest] - 1], ids[rest, at[rest]])
        return out

    def _encode_long(self, piece: bytes) -> list[int]:
        """The same merges for one very long piece, by a linked list and a heap."""

        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joined = self.ranks
        parts = [piece[i:i + 1] for i in range(n)]

        def rank(i: int) -> int | None:
            return joined.get(parts[i] + parts[after[i]]) if after[i] < n else None

        heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or len(parts[i]) != a or len(parts[j]) != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = parts[i] + parts[j], b""
            ids[i] = r
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, len(parts[k]), len(parts[after[k]])))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def _coder(path: str | None) -> tuple[ByteBpe, dict]:
    import public_tokenizers
    import regex

    coder = ByteBpe(path or public_tokenizers.path(RANKS))
    return coder, {"split": regex.compile(public_tokenizers.PATTERN).findall, "kept": {}, "old": {}, "digest": None}


def _entries(coder: ByteBpe, state: dict, split: list[list[str]], digest: bool) -> dict:
    """Store of all pieces of a block: piece -> (ids or their number, digits, bytes decoded)."""

    if len(state["kept"]) > KEPT_PIECES:
        state["old"], state["kept"] = state["kept"], {}
    kept, old = state["kept"], state["old"]
    order = []
    for piece in {piece for pieces in split for piece in pieces}.difference(kept):
        if piece in old:
            kept[piece] = old[piece]
        else:
            order.append(piece)
    for piece, ids in zip(order, coder.encode_pieces([p.encode() for p in order])):
        kept[piece] = (len(ids) if digest else ids, ",".join(map(str, ids)), coder.decode(ids))
    return kept


def encode_documents(docs: DataFrame, ranks_path: str | None = None, output: str = "ids") -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``output="ids"``: ``doc_id, ids array<int>, decoded binary``.
    ``output="digest"``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, made
    in the same pass so that the id arrays needn't leave the worker.
    Row-local: no shuffle; a worker holds a block of texts and ``KEPT_PIECES``
    encoded pieces.
    """

    digest = output == "digest"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, state = _coder(ranks_path)
        find = state["split"]
        if state["digest"] != digest:  # the stores of the two kinds of output differ
            state.update(kept={}, old={}, digest=digest)
        for batch in batches:
            for part, texts in text_blocks(batch):
                split = [find(t) for t in texts]
                kept = _entries(coder, state, split, digest)
                rows: list[list] = [[], [], []]
                for pieces in split:
                    got = [kept[p] for p in pieces]
                    decoded = b"".join([e[2] for e in got])
                    if digest:
                        rows[0].append(sum([e[0] for e in got]))
                        rows[1].append(hashlib.sha256(",".join([e[1] for e in got]).encode()).hexdigest())
                        rows[2].append(hashlib.sha256(decoded).hexdigest())
                    else:
                        rows[0].append([i for e in got for i in e[0]])
                        rows[1].append(decoded)
                if digest:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()),
                         pa.array(rows[2], pa.string())],
                        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.binary())],
                        names=["doc_id", "ids", "decoded"])

    schema = ("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest
              else "doc_id long, ids array<int>, decoded binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
