"""Attributions for a model of any kind: coalitions of features under the Shapley kernel.

The worth of a coalition for a row is the mean prediction over the background rows
with the coalition's features taken from the row.  A row's attributions are the weighted
least-squares fit of these worths by sums over members, held to add up to the row's
prediction less that of the background.  The design is the same for all rows, so
the solution is one matrix that each row's worths are multiplied by.  With every
coalition in the design (few features) the attributions are the Shapley values;
otherwise whole sizes are listed from both ends while they fit the budget, and
the rest is drawn in pairs of a coalition and its complement.

A row makes (coalitions x background) points, scored by the model as one Spark
plan; a task holds one block of points.  Background and design are bounded by
parameters, whatever the tables' size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RANDOM_STATE
from ..session import cut_lineage

BACKGROUND = 10  # rows
DRAWN = 256  # coalitions beside those of one feature and of all but one
BLOCK_VALUES = 2_000_000  # doubles of a block of points


def kernel_coalitions(d: int, budget: int, seed: int = RANDOM_STATE) -> tuple[np.ndarray, np.ndarray]:
    """(membership, weights) of about ``budget`` proper coalitions of ``d`` features (at least those of one
    feature and of all but one)."""

    mass = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}
    total, left = sum(mass.values()), max(budget, 2 * d)
    rows: list[np.ndarray] = []
    weights: list[float] = []
    for small in range(1, d // 2 + 1):
        sizes = sorted({small, d - small})
        if len(sizes) * comb(d, small) > left:
            break
        for size in sizes:
            for members in combinations(range(d), size):
                row = np.zeros(d, bool)
                row[list(members)] = True
                rows.append(row)
                weights.append(mass[size] / total / comb(d, size))
            left -= comb(d, size)
            del mass[size]
    if mass and left >= 2:
        rng = np.random.default_rng(seed)
        sizes, share = list(mass), np.array(list(mass.values()))
        pairs = left // 2
        for size in rng.choice(sizes, pairs, p=share / share.sum()):
            row = np.zeros(d, bool)
            row[rng.choice(d, size, replace=False)] = True
            rows += [row, ~row]
        weights += [float(share.sum()) / total / (2 * pairs)] * (2 * pairs)
    return np.array(rows, bool).reshape(-1, d), np.array(weights)


def solution(members: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The matrix that takes worths (none, the coalitions in order, all) to attributions."""

    n, d = members.shape
    z = members.astype(float)
    root = np.sqrt(weights)[:, None]
    fit = np.linalg.pinv(root * (z[:, :-1] - z[:, -1:])) * root.T if d > 1 else np.zeros((0, n))
    held = fit @ z[:, -1]  # the last feature takes what the others leave
    head = np.column_stack([held - fit.sum(axis=1), fit, -held])
    last = -head.sum(axis=0)
    last[0] -= 1.0
    last[-1] += 1.0
    return np.vstack([head, last])


def coalition_attributions(predict_encoded: Callable, encoded: DataFrame, background: DataFrame,
                           coalitions: int | None = None, seed: int = RANDOM_STATE,
                           prob: str = "churn_probability") -> tuple[DataFrame, float]:
    """(``encoded`` with ``attributions``, the background's mean prediction).

    ``predict_encoded(df, keep)`` scores rows that hold a ``features`` vector;
    ``background`` holds few such rows (see ``explain.background_rows``).
    """

    given = np.array([r[0] for r in background.select(vector_to_array("features")).toLocalIterator()], float)
    if not len(given):
        raise ValueError("attributions need background rows")
    d = given.shape[1]
    members, weights = kernel_coalitions(d, 2 * d + DRAWN if coalitions is None else coalitions, seed)
    solve = solution(members, weights)
    masks = np.vstack([np.zeros((1, d), bool), members, np.ones((1, d), bool)])
    kept = [c for c in encoded.columns if c != "features"]
    rows = cut_lineage(encoded.select(*kept, "features", F.monotonically_increasing_id().alias("_row")))
    step = max(1, BLOCK_VALUES // max(1, d * len(given)))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = x.values.to_numpy(zero_copy_only=False)
                for start in range(0, len(masks), step):
                    mask = masks[start:start + step]
                    mixed = np.where(mask[:, None, :], values, given).reshape(-1, d)
                    at = np.repeat(np.arange(start, start + len(mask), dtype=np.int32), len(given))
                    offsets = np.arange(len(mixed) + 1, dtype=np.int32) * d
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(mixed), row)), pa.array(at),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(mixed.ravel()))],
                        names=["_row", "_c", "_x"])

    def attributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve @ w.values.to_numpy(zero_copy_only=False) for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(f) for f in found], pa.list_(pa.float64()))],
                                             names=["_row", "attributions"])

    mixed = rows.select("_row", vector_to_array("features").alias("_x")).mapInArrow(
        points, "_row long, _c int, _x array<double>")
    scored = predict_encoded(mixed.select("_row", "_c", array_to_vector("_x").alias("features")), ["_row", "_c"])
    worth = scored.groupBy("_row", "_c").agg(F.avg(prob).alias("v"))
    worths = worth.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_c", "v"))).alias("w"))
    shares = worths.select("_row", F.col("w.v").alias("w")).mapInArrow(attributed, "_row long, attributions array<double>")
    base = predict_encoded(background.select("features", F.lit(0).alias("_b")), ["_b"]).agg(F.avg(prob)).first()[0]
    return rows.join(shares, "_row").select(*kept, "features", "attributions"), float(base)
