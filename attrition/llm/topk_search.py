"""Exact top-k search by distributed histogram selection (operator 6).

Vectors become whole numbers, floor(64 x).  Queries are the rows whose ``vec_id``
is divisible by ``every``; each is scored against every other row.  Query blocks
meet candidate blocks; a block pair is one bounded matrix product.

The k-th best score of each query is found without gathering its scores.  Each
round scores everything and counts the scores inside the query's current interval
in ``BINS`` equal bins; counts are added up over all blocks, and the bin that
holds the k-th best becomes the next interval, until it is one score wide.  The
first interval comes from the largest absolute sum of components (a proven bound
of any inner product).  A last round keeps scores above the k-th best, and of
those equal to it the smallest ids: each block as many as are still wanted, then
over the blocks.  So a task holds one block pair, and for each query no more rows
leave a block than can be in the result.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, nor do rows with null ``vec_id``; a query's own ``vec_id`` is never
its candidate; vectors of different lengths are compared as if the shorter ended
in zeros; rows that share an id are a candidate each, and one query (by the vector
that sorts first); ties go to the smaller ``vec_id``; fewer candidates than k: all; a score
beyond 2^61, or a component that fits no long, stops the job with an overflow error; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import written

TOP, EVERY, SCALE = 20, 20, 64
#: Rows of a query block and of a candidate block.
QUERY_ROWS, CANDIDATE_ROWS = 1_024, 8_192
BINS = 256
#: A score over this stops the job; sums of its parts may be larger.
LARGEST = 1 << 61
#: Scores of a block pair held at once.
TILE = 4_000_000


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v array<long>`` of the rows that take part."""

    wrong = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == F.lit(math.inf)), F.lit(True)))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~wrong)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(vectors: pa.ChunkedArray, width: int, exact: bool) -> np.ndarray:
    """Rows of a block, padded with zeros; doubles where all sums are whole doubles."""

    out = np.zeros((len(vectors), width), np.float64 if exact else np.int64)
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = np.asarray(lists.offsets)
    lengths = np.diff(offsets)
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    out[np.arange(width) < lengths[:, None]] = flat
    return out


class Search:
    """Block pairs over one written table of vectors."""

    def __init__(self, vectors: DataFrame, every: int, query_rows: int, candidate_rows: int):
        self.vectors = written(vectors)
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        asked = F.col("vec_id") % every == 0
        rows, queries, norm, of_queries, self.width = self.vectors.agg(
            F.count(F.lit(1)), F.count_if(asked), F.max(square), F.max(F.when(asked, square)), F.max(F.size("v"))).first()
        #: No inner product is larger (Cauchy and Schwarz), so scores lie in [-bound, bound]; beyond LARGEST each is tested.
        self.bound = min(LARGEST, math.ceil(math.sqrt(norm or 0.0) * math.sqrt(of_queries or 0.0) * (1 + 1e-9)))
        self.exact = self.bound < 1 << 52
        self.every = every
        self.query_blocks = max(1, -(-(queries or 0) // query_rows))
        self.candidate_blocks = max(1, -(-(rows or 0) // candidate_rows))

    def score(self, state: DataFrame, per_tile: Callable, schema: str) -> DataFrame:
        """``per_tile(state rows, query ids, candidate ids, scores)`` for tiles of every block pair.

        ``state`` has ``query_id`` and whatever a tile needs to know of them.
        """

        every_candidate = F.explode(F.sequence(F.lit(0), F.lit(self.candidate_blocks - 1))).alias("cb")
        every_query = F.explode(F.sequence(F.lit(0), F.lit(self.query_blocks - 1))).alias("qb")
        named = F.xxhash64("vec_id", "v")
        queries = self.vectors.filter(F.col("vec_id") % self.every == 0).select(
            F.col("vec_id").alias("query_id"), F.col("v").alias("q")).groupBy("query_id").agg(F.min("q").alias("q"))
        queries = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(self.query_blocks)).cast("int"))
        queries = queries.join(state, "query_id").select("*", every_candidate)
        candidates = self.vectors.withColumn("cb", F.pmod(named, F.lit(self.candidate_blocks)).cast("int"))
        candidates = candidates.select("*", every_query)
        width, exact, tested = self.width or 0, self.exact, self.bound == LARGEST

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if len(left) and len(right):
                q, c = _matrix(left["q"], width, exact), _matrix(right["v"], width, exact)
                ids = right["vec_id"].to_numpy()
                step = max(1, TILE // len(c))
                for start in range(0, len(q), step):
                    tile = left.slice(start, step)
                    # whole numbers wrap around: a sum that fits is right, whatever its parts
                    scores = (q[start:start + step] @ c.T).astype(np.int64)
                    if tested:
                        rough = q[start:start + step].astype(float) @ c.T.astype(float)
                        if (np.abs(rough) > LARGEST * (1 - 1e-9))[tile["query_id"].to_numpy()[:, None] != ids[None, :]].any():
                            raise OverflowError(f"scores over {LARGEST}")
                    out.append(per_tile(tile, tile["query_id"].to_numpy(), ids, scores))
            return pa.concat_tables(out) if out else None

        fields = pa.schema([(name, pa.int64()) for name in (x.split()[0] for x in schema.split(","))])

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            found = run(left, right)
            return found if found is not None else fields.empty_table()

        return queries.groupBy("cb", "qb").cogroup(candidates.groupBy("cb", "qb")).applyInArrow(pair, schema)


def _histogram(bins: int) -> Callable:
    def per_tile(state: pa.Table, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
        low, step = state["low"].to_numpy()[:, None], state["step"].to_numpy()[:, None]
        at = (scores - low) // step
        inside = (at >= 0) & (at < bins) & (queries[:, None] != ids[None, :])
        rows = np.broadcast_to(np.arange(len(queries))[:, None], scores.shape)[inside]
        counts = np.bincount(rows * bins + at[inside], minlength=len(queries) * bins)
        held = np.flatnonzero(counts)
        return pa.table({"query_id": queries[held // bins], "bin": held % bins, "n": counts[held]})

    return per_tile


def _winners(top: int) -> Callable:
    def per_tile(state: pa.Table, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
        kth, wanted = state["low"].to_numpy(), state["wanted"].to_numpy()
        other = queries[:, None] != ids[None, :]
        row, col = np.nonzero((scores > kth[:, None]) & other)
        parts = [(queries[row], ids[col], scores[row, col])]
        row, col = np.nonzero((scores == kth[:, None]) & other)
        order = np.lexsort((ids[col], row))  # of the ties the smallest ids, as many as are wanted
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < wanted[row]
        row, col = row[keep], col[keep]
        parts.append((queries[row], ids[col], scores[row, col]))
        names = ("query_id", "vec_id", "score")
        return pa.table({name: np.concatenate([p[k] for p in parts]) for k, name in enumerate(names)})

    return per_tile


def top_k(embeddings: DataFrame, top: int = TOP, every: int = EVERY, query_rows: int = QUERY_ROWS,
          candidate_rows: int = CANDIDATE_ROWS, bins: int = BINS, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` best candidates."""

    search = Search(whole_vectors(embeddings, scale), every, query_rows, candidate_rows)
    queries = search.vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")).distinct()
    step = 1  # a power of ``bins``, so that a bin is exactly the next interval
    while step * bins < 2 * search.bound + 1:
        step *= bins
    # the interval [low, low + bins * step) holds the k-th best; ``wanted`` of the scores in it or below are in the result
    state = queries.select("query_id", F.lit(-search.bound).alias("low"), F.lit(step).alias("step"),
                           F.lit(top).cast("long").alias("wanted"))
    while True:
        counted = search.score(state, _histogram(bins), "query_id long, bin long, n long")
        total = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        ranked = total.withColumn("above", F.sum("n").over(upto) - F.col("n"))
        # the lowest bin reached: the k-th best, or the last score there is if there are fewer than k
        held = ranked.join(state, "query_id").filter(F.col("above") < F.col("wanted")).groupBy("query_id").agg(
            F.min(F.struct("bin", "above", "low", "wanted")).alias("b"))
        smaller = step // bins
        state = written(held.select(
            "query_id", (F.col("b.low") + F.col("b.bin") * step).alias("low"), F.lit(smaller).cast("long").alias("step"),
            (F.col("b.wanted") - F.col("b.above")).alias("wanted")))
        if step == 1:
            break
        step = smaller
    found = search.score(state, _winners(top), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
