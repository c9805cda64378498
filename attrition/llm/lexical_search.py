"""Ranked lexical search by Block-Max MaxScore over a sharded, compressed index (operator 12).

Terms are the runs of characters that are no ASCII ones but letters and digits, A-Z
lower-cased.  A term of weight w that stands tf times in a document scores there
``w * ((10^9 * tf) div (1000 * tf + 12 * m))``; m grows with the document's length.

*Index.*  Each task deals its documents into shards of at most ``SHARD_DOCS`` documents and
``SHARD_TERMS`` terms (a single longer document is a shard by itself).  A shard has for
each of its terms a list of postings in blocks of ``BLOCK``: gaps of document numbers and
frequencies, each in the fewest bytes that hold the block's largest.  Beside the bytes
stand each block's first and last document and its best (tf, length) pairs, those that no
other pair of the block beats in both; whatever the corpus' statistics turn out to be,
the block's highest score is that of one of these pairs.  All documents and all terms
are indexed, in one pass over the text; document counts per term are sums over lists.

*Search.*  A task has one shard and all queries of a block of queries.  Lists are ordered
by their highest score.  Those whose highest scores sum up to less than the query's
threshold, the k-th best score so far, can't alone make a result: they are non-essential.
Documents are taken in windows: essential lists are added up, then each document's sum
plus the block maxima of the non-essential lists must reach the threshold, else it goes
before any of their blocks is decompressed; the rest meets one list after the other,
highest first, and is tested again after each.  A shard's heap of k goes to a merge by
rank.  Nothing is approximate: what could tie with the threshold stays.

*Scale.*  Postings of terms that no query has stay on disk.  Shards are bounded, so a task's
memory is too; the merge sees k rows a shard and query, cut down to k in each task
before the shuffle.  Queries are the stated set; they go to the tasks in blocks of at
most ``QUERY_BLOCK`` items and ``QUERY_CHARS`` characters.

Defined results: null texts have no terms, a document or item without terms finds
nothing; repeated rows are documents each; rows without ``doc_id`` come last among equal
scores; items that agree in id and text are one, items that agree in id only are ranked
each; no rows where either table is empty; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import text_blocks, written

BLOCK = 64
SHARD_DOCS, SHARD_TERMS = 8192, 2_000_000
WINDOW = 4096
QUERY_BLOCK, QUERY_CHARS = 2000, 4_000_000
K = 20
_HELD = (1 << 63) - 1

#: ASCII letters and digits (A-Z lower-cased) as they are, other ASCII a space, bytes of other characters as they are.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, as UTF-8."""

    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


# -- index --------------------------------------------------------------------

def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    """Little-endian ``values`` of ``width`` bytes each at ``at``."""

    for k in range(4):
        has = width > k
        out[at[has] + k] = values[has] >> 8 * k & 255


def encode(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> dict:
    """Blocks of postings sorted by (term, doc): columns of arrays by block, and one byte string.

    ``term`` numbers the lists from 0 without gaps.
    """

    n = np.bincount(term)
    start = np.cumsum(n) - n
    in_list = np.arange(len(term)) - start[term]
    opens = np.flatnonzero(in_list % block == 0)
    size = np.diff(np.append(opens, len(term)))
    own = np.repeat(np.arange(len(opens)), size)
    first, last = doc[opens], doc[opens + size - 1]
    gap = np.diff(doc, prepend=0)
    gap[opens] = 0
    gap_width, tf_width = _width(np.maximum.reduceat(gap, opens)), _width(np.maximum.reduceat(tf, opens))
    bytes_ = size * (gap_width + tf_width)
    at = np.cumsum(bytes_) - bytes_
    data = np.zeros(int(bytes_.sum()), np.uint8)
    within = np.arange(len(term)) - opens[own]
    _put(data, at[own] + within * gap_width[own], gap_width[own], gap)
    _put(data, (at + size * gap_width)[own] + within * tf_width[own], tf_width[own], tf)
    # best pairs: by block, tf falling, length rising; a pair stays if its length is under all before it in its block
    length = lengths[doc]
    order = np.lexsort((length, -tf, own))
    far = int(lengths.max(initial=0)) + 1
    fallen = length[order] - own[order] * far
    best = np.ones(len(order), bool)
    best[1:] = fallen[1:] < np.minimum.accumulate(fallen)[:-1]
    pair = order[best]
    return {"list": term[opens], "first": first, "last": last, "size": size, "gap_width": gap_width, "tf_width": tf_width,
            "at": at, "bytes": bytes_, "data": data, "n": n, "start": start,
            "pairs": np.bincount(own[pair], minlength=len(opens)), "pair_tf": tf[pair], "pair_length": length[pair]}


def _shard_rows(shard: int, doc_ids: list, tokens: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """The shard's documents and lists as rows of ``INDEX``."""

    lengths = np.array([len(t) for t in tokens], np.int64)
    names: dict[bytes, int] = {}  # each term's first place
    places = np.fromiter(map(names.setdefault, chain.from_iterable(tokens), count()), np.int64, int(lengths.sum()))
    number = np.empty(len(places), np.int64)
    number[np.fromiter(names.values(), np.int64, len(names))] = np.arange(len(names))
    ids = number[places]
    docs = np.repeat(np.arange(len(tokens)), lengths)
    key, tf = np.unique(ids * len(tokens) + docs, return_counts=True)
    term, doc = np.divmod(key, len(tokens))
    null = pa.nulls(1)
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), null.cast(pa.string()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
         pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64())),
         *[null.cast(pa.list_(pa.int64()))] * 2, null.cast(pa.binary())], names=_NAMES)
    if not len(key):
        return
    made = encode(term, doc, tf, lengths)
    blocks = np.stack([made[c] for c in ("first", "last", "size", "gap_width", "tf_width", "pairs")], 1)
    pairs = np.stack([made["pair_tf"], made["pair_length"]], 1)
    upto = np.searchsorted(made["list"], np.arange(len(names) + 1))
    pair_upto = np.append(0, np.cumsum(made["pairs"]))[upto]
    byte_upto = np.append(0, np.cumsum(made["bytes"]))[upto]

    def lists(values: np.ndarray, cut: np.ndarray, a: int, b: int) -> pa.Array:
        offsets = (cut[a:b + 1] - cut[a]) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[cut[a]:cut[b]].ravel(), pa.int64()))

    whole, texts = made["data"].tobytes(), [t.decode("utf-8", "surrogatepass") for t in names]
    for a in range(0, len(names), 20000):
        b = min(a + 20000, len(names))
        none = pa.nulls(b - a)
        data = pa.array([whole[i:j] for i, j in zip(byte_upto[a:b].tolist(), byte_upto[a + 1:b + 1].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * (b - a)), pa.array(texts[a:b], pa.string()), pa.array(made["n"][a:b]), none.cast(pa.int64()),
             none.cast(pa.list_(pa.int64())), none.cast(pa.list_(pa.int64())), lists(blocks, upto, a, b),
             lists(pairs, pair_upto, a, b), data], names=_NAMES)


#: A row without ``term`` has a shard's documents (``df``: those with a term, ``total``: their terms), others a list each.
INDEX = ("shard long, term string, df long, total long, doc_ids array<long>, lengths array<long>, "
         "blocks array<long>, pairs array<long>, data binary")
_NAMES = [f.split(" ")[0] for f in INDEX.split(", ")]


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The index of all documents and terms, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        doc_ids: list = []
        tokens: list = []
        for batch in batches:
            for part, texts in text_blocks(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), texts):
                    found = terms(text)
                    if tokens and (len(tokens) == shard_docs or held + len(found) > shard_terms):
                        yield from _shard_rows(shard, doc_ids, tokens)
                        shard, held, doc_ids, tokens = shard + 1, 0, [], []
                    doc_ids.append(doc_id)
                    tokens.append(found)
                    held += len(found)
        if tokens:
            yield from _shard_rows(shard, doc_ids, tokens)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX))


# -- search in a shard -----------------------------------------------------------

def score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's score for a weight of one."""

    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def damping(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    return 75 + 25 * lengths * n // max(total, 1)


class PostingList:
    """One term's list in a shard; blocks are decompressed when they're asked for, once."""

    def __init__(self, blocks: np.ndarray, pairs: np.ndarray, data: bytes, m: np.ndarray, n: int, total: int):
        self.first, self.last, self.size, self.gap_width, self.tf_width, counts = blocks.reshape(-1, 6).T
        pairs = pairs.reshape(-1, 2)
        opens = np.cumsum(counts) - counts
        #: Highest score of each block, and of the list, for a weight of one.
        self.highest = np.maximum.reduceat(score(pairs[:, 0], damping(pairs[:, 1], n, total)), opens)
        self.bound = int(self.highest.max())
        taken = self.size * (self.gap_width + self.tf_width)
        self.at = np.cumsum(taken) - taken
        self.data, self.m = data, m
        self.start = np.append(0, np.cumsum(self.size))
        #: Documents and scores for a weight of one; a block's last document stands for all of it until it is asked for.
        self.docs, self.scores = np.repeat(self.last, self.size), np.zeros(int(self.start[-1]), np.int64)
        self.packed = np.ones(len(self.size), bool)

    def unpack(self, blocks: np.ndarray) -> None:
        """Decompress those of ``blocks`` that aren't yet."""

        for k in blocks[self.packed[blocks]].tolist():
            size, at, wide = int(self.size[k]), int(self.at[k]), int(self.gap_width[k])
            docs = self.first[k] + np.cumsum(np.frombuffer(self.data, f"<u{wide}", size, at), dtype=np.int64)
            tf = np.frombuffer(self.data, f"<u{int(self.tf_width[k])}", size, at + size * wide).astype(np.int64)
            own = slice(int(self.start[k]), int(self.start[k + 1]))
            self.docs[own], self.scores[own] = docs, score(tf, self.m[docs])
            self.packed[k] = False

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from a up to b, and their scores."""

        i, j = int(self.last.searchsorted(a)), int(self.first.searchsorted(b))
        if i >= j:
            return _NONE
        self.unpack(np.arange(i, j))
        own = slice(int(self.start[i]), int(self.start[j]))
        docs = self.docs[own]
        lo, hi = docs.searchsorted((a, b))
        return docs[lo:hi], self.scores[own][lo:hi]

    def bounds_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block that may hold each document or -1, highest score there), from the block's head alone."""

        k = self.last.searchsorted(docs)
        inside = np.minimum(k, len(self.last) - 1)
        may = (k < len(self.last)) & (self.first[inside] <= docs)
        return np.where(may, inside, -1), np.where(may, self.highest[inside], 0)

    def scores_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores of documents (0: not in the list); only ``blocks`` are decompressed."""

        may = blocks >= 0
        self.unpack(np.unique(blocks[may]))
        at = np.minimum(self.docs.searchsorted(docs), len(self.docs) - 1)
        return np.where(may & (self.docs[at] == docs), self.scores[at], 0)


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def max_score(lists: list[tuple[int, PostingList]], doc_ids: np.ndarray, k: int, window: int = WINDOW,
              ) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best, scores falling, then ``doc_ids`` rising, of weighted lists."""

    lists = sorted(((w, own) for w, own in lists if w > 0), key=lambda x: x[0] * x[1].bound)
    upto = np.cumsum([w * own.bound for w, own in lists])
    best, best_scores, threshold = *_NONE, 1
    a, b = 0, min(max(1, window // 8), len(doc_ids) if lists else 0)  # a small window first, for a threshold
    while a < b:
        # documents that only the first lists hold stay under the threshold
        free = int(np.searchsorted(upto, threshold, side="left"))
        sums = np.zeros(b - a, np.int64)
        for w, own in lists[free:]:
            docs, scores = own.between(a, b)
            sums[docs - a] += w * scores
        found = np.flatnonzero(sums)
        sums, found = sums[found], found + a
        if free and len(found):
            heads = [own.bounds_of(found) for _, own in lists[:free]]
            open_ = sum(w * high for (w, _), (_, high) in zip(lists, heads))
            for i in range(free - 1, -1, -1):
                stay = sums + open_ >= threshold
                if not stay.all():
                    found, sums, open_ = found[stay], sums[stay], open_[stay]
                    heads[:i + 1] = [(blocks[stay], high[stay]) for blocks, high in heads[:i + 1]]
                if not len(found):
                    break
                w, own = lists[i]
                blocks, high = heads[i]
                open_ = open_ - w * high
                sums = sums + w * own.scores_of(found, blocks)
        stay = sums >= threshold
        best, best_scores = np.append(best, found[stay]), np.append(best_scores, sums[stay])
        if len(best) > k:
            order = np.lexsort((doc_ids[best], -best_scores))[:k]
            best, best_scores = best[order], best_scores[order]
        if len(best) == k:
            threshold = max(1, int(best_scores.min()))
        a, b = b, min(b + window, len(doc_ids))
    order = np.lexsort((doc_ids[best], -best_scores))
    return best[order], best_scores[order]


# -- search -------------------------------------------------------------------

def _query_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The distinct (item_id, text) with terms, in blocks that fit a task."""

    block, chars = [], 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        own = terms(row.text)
        if own:
            if block and (len(block) == QUERY_BLOCK or chars + len(row.text) > QUERY_CHARS):
                yield block
                block, chars = [], 0
            block.append((row.item_id, own))
            chars += len(row.text)
    if block:
        yield block


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item."""

    spark = index.sparkSession
    stats = index.filter("term is null").agg(F.sum("df").alias("n"), F.sum("total").alias("total")).first()
    n, total = stats.n or 0, stats.total or 0
    found = None
    for block in _query_blocks(items):
        asked = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in {t for _, own in block for t in own}],
                                      "term string")
        lists = index.filter("term is not null").join(F.broadcast(asked), "term")  # QUERY_CHARS characters at most
        weights = {r.term.encode("utf-8", "surrogatepass"): weight(n, r.df)
                   for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the block's terms
        heads = index.filter("term is null").select(*_NAMES)
        part = _search_block(heads, lists.select(*_NAMES), block, weights, n, total, k, window)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _search_block(heads: DataFrame, lists: DataFrame, block: list, weights: dict, n: int, total: int, k: int,
                  window: int) -> DataFrame:
    """``item_id, query, doc_id, score``: each shard's k best of each item of the block."""

    queries = []
    for item_id, own in block:
        times: dict[bytes, int] = {}
        for t in own:
            times[t] = times.get(t, 0) + 1
        queries.append((item_id, [(t.decode("utf-8", "surrogatepass"), c * weights[t]) for t, c in times.items() if t in weights]))
    sent = heads.sparkSession.sparkContext.broadcast(queries)  # QUERY_CHARS characters at most

    def run(table: pa.Table) -> pa.Table:
        posted, out = {}, []
        table = table.combine_chunks()
        names = table.column("term").to_pylist()
        head = next((i for i, name in enumerate(names) if name is None), None)
        if head is not None:
            of_shard = table.slice(head, 1).select(["doc_ids", "lengths"]).to_pylist()[0]
            held = of_shard["doc_ids"]
            doc_ids = np.array([_HELD if d is None else d for d in held], np.int64)
            m = damping(np.array(of_shard["lengths"], np.int64), n, total)
            blocks, pairs, data = (table.column(c).chunk(0) for c in ("blocks", "pairs", "data"))
            for i, name in enumerate(names):
                if name is not None:
                    posted[name] = PostingList(np.asarray(blocks[i].values), np.asarray(pairs[i].values),
                                               data[i].as_py(), m, n, total)
            for q, (item_id, own) in enumerate(sent.value):
                docs, scores = max_score([(w, posted[t]) for t, w in own if t in posted], doc_ids, k, window)
                out += [(item_id, q, held[d], s) for d, s in zip(docs.tolist(), scores.tolist())]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "query", "doc_id", "score"])

    return heads.unionByName(lists).groupBy("shard").applyInArrow(
        run, "item_id long, query long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Index ``docs``, search all ``items``."""

    return search(build_index(docs), items, k)
