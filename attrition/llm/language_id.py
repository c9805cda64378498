"""Language identification by nearest centroids (operator 3).

A text is a vector of character n-grams: its letters in lower case, everything
else a space, UTF-8 byte pairs and triples hashed to ``DIMS`` numbers, sublinear
counts times inverse document frequency, length one.  Each language has
``CENTROIDS`` centroids from spherical k-means over labelled texts (the widest cluster
is halved until there are enough, then rows move); a text gets the language of the
centroid with the largest cosine, which is its score.

Distance-based rejection: the fewer distinct n-grams a text has, the less of a
centroid it can cover, so its cosine is set against the root of that number (full
from ``FULL_NGRAMS`` on).  A text for which this is under ``REJECT`` times the
``STRAY`` quantile of the language's sample is too far from all that was learned
and is marked ``rejected``; so is ``und`` (null text or no letter).

Labels may be wrong: the ``STRAY`` share of a sample farthest from its mean makes no
centroid, and every centroid stands for at least that share of the others.  What is rarer
in a language than that is told from a wrong label by nothing.  Samples of fewer than
``LEAST_TRIMMED`` rows are taken as they are.

*What is fitted on what.*  Labelled rows whose crc32(doc_id as text) mod 4 is not
2, of these at most ``SAMPLE`` per language and ``LANGUAGES`` languages (the most
frequent): a bounded sample, of which a task gets one language and the driver only the
centroids.  The sample is taken by hash; only a text's characters enter a prediction.

Defined results: empty text has no letter; without any labelled row all is
``und``; a language of one text, or of equal texts, has one centroid; ties go to the language that sorts first; a null ``doc_id`` is neither
held out nor learned from; repeated rows each give a row; an empty table gives
no rows; other columns pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import map_rows, text_blocks, written

SAMPLE, LANGUAGES = 300, 200
DIMS = 8_192
CENTROIDS, ROUNDS = 4, 8
REJECT, FULL_NGRAMS = 0.5, 300
STRAY, LEAST_TRIMMED = 0.05, 10
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters stay, bytes of other characters stay, the rest is a space.
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def ngram_counts(text: str) -> np.ndarray:
    words = b" ".join(text.lower().encode().translate(_KEEP).split())
    a = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    pairs = a[:-1] << 8 | a[1:]
    codes = np.concatenate([pairs, 1 << 24 | pairs[:-1] << 8 | a[2:]])
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, DIMS), rows of length one
    idf: np.ndarray
    least: np.ndarray  # of each centroid: the relative cosine under which a text is rejected

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""

        languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for start in range(0, len(known), 128):
            rows = known[start:start + 128]
            vectors = weighted(np.array([ngram_counts(texts[i]) for i in rows], np.float32), self.idf)
            cosine = vectors @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(rows)), best]
            for i, b in zip(rows, best.tolist()):
                languages[i] = self.languages[b]
            scores[rows] = np.clip(top, 0.0, 1.0)
            rejected[rows] = top / coverable(vectors) < self.least[best]
        return languages, scores, rejected


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def coverable(vectors: np.ndarray) -> np.ndarray:
    """What a text's cosine is set against, by its number of distinct n-grams."""

    return np.sqrt(np.clip((vectors > 0).sum(axis=1), 1, FULL_NGRAMS) / FULL_NGRAMS)


def cluster_sum(x: np.ndarray) -> np.ndarray:
    """Sum of the rows, of length one: the centroid of a cluster."""

    total = x.sum(axis=0)
    return total / max(float(np.linalg.norm(total)), 1e-12)


def halved(x: np.ndarray, least: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which rows of a cluster go to its second half: two-means, at least ``least`` rows a half.

    Starts from the cluster's longest axis, cut at the middle.
    """

    centred = x - x.mean(axis=0)
    axis = centred[int(np.argmax((centred * centred).sum(axis=1)))]
    for _ in range(rounds):
        axis = (centred @ axis) @ centred
        axis = axis / max(float(np.linalg.norm(axis)), 1e-12)
    lean, cut = centred @ axis, len(x) // 2
    for _ in range(rounds):
        order = np.argsort(lean, kind="stable")
        second = np.zeros(len(x), bool)
        second[order[cut:]] = True
        lean = x @ cluster_sum(x[second]) - x @ cluster_sum(x[~second])
        cut = min(max(int((lean <= 0).sum()), least), len(x) - least)
    second = np.zeros(len(x), bool)
    second[np.argsort(lean, kind="stable")[cut:]] = True
    return second


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centroids, each of the ``STRAY`` share of the rows or more (fewer, if there are too few rows).

    The widest cluster is halved until there are ``k``; then rows move to their nearest
    centroid for as long as every centroid keeps that share.
    """

    least = max(1, math.ceil(STRAY * len(x)))
    own, count = np.zeros(len(x), int), 1
    while count < k:
        width = [float((1 - x[own == c] @ cluster_sum(x[own == c])).sum()) if (own == c).sum() >= 2 * least else -1.0
                 for c in range(count)]
        widest = int(np.argmax(width))
        if width[widest] <= 1e-6 * len(x):  # too few rows to halve, or all alike
            break
        rows = np.flatnonzero(own == widest)
        own[rows[halved(x[rows], least, rounds)]] = count
        count += 1
    centroids = np.array([cluster_sum(x[own == c]) for c in range(count)])
    for _ in range(rounds):
        moved = (x @ centroids.T).argmax(axis=1)
        if (moved == own).all() or (np.bincount(moved, minlength=count) < least).any():
            break
        own = moved
        centroids = np.array([cluster_sum(x[own == c]) for c in range(count)])
    return centroids


def strays(n: int) -> int:
    return math.ceil(STRAY * n) if n >= LEAST_TRIMMED else 0


def language_centroids(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Centroids of a language's sample and the relative cosine under which a text is rejected."""

    trimmed = strays(len(x))
    order = np.argsort(x @ x.sum(axis=0) / coverable(x), kind="stable")
    centroids = spherical_kmeans(x[np.sort(order[trimmed:])], k)
    return centroids, REJECT * float(np.sort((x @ centroids.T).max(axis=1) / coverable(x))[trimmed])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """``lang`` and sparse n-gram counts (``at``, ``n``) of at most ``sample`` texts per language."""

    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # thin by hash first, so that the ranking sees about four times the sample whatever the table's size
    order = F.xxhash64("doc_id", F.lit("language sample"))
    share = F.pmod(order, F.lit(1_000_000)) / 1e6
    thin = rows.join(F.broadcast(sizes), "lang").filter(share < F.lit(4.0 * sample) / F.col("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, F.xxhash64("text")))
    picked = thin.withColumn("r", rank).filter(F.col("r") <= sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                counts = [ngram_counts(t) for t in texts]
                at = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(at, pa.list_(pa.int32())),
                     pa.array([c[i].astype(np.int32) for c, i in zip(counts, at)], pa.list_(pa.int32()))],
                    names=["lang", "r", "at", "n"])

    return picked.select("lang", "r", "text").mapInArrow(run, "lang string, r int, at array<int>, n array<int>")


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, centroids: int = CENTROIDS) -> LanguageModel:
    """Centroids are found in one task per language; the driver gets n-gram counts and centroids only."""

    rows = written(labelled_sample(docs, sample, languages))
    seen, total = np.zeros(DIMS), rows.count()
    for at, n in rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():
        seen[at] = n
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        counts = np.zeros((table.num_rows, DIMS), np.float32)
        for row, at, n in zip(counts, table["at"], table["n"]):
            row[at.values.to_numpy()] = n.values.to_numpy()
        found, bound = language_centroids(weighted(counts, idf), centroids)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(found)),
                         "nr": pa.array(range(len(found)), pa.int32()),
                         "centroid": pa.array([c.astype(np.float32) for c in found], pa.list_(pa.float32())),
                         "bound": pa.array([bound] * len(found), pa.float64())})

    learned = rows.groupBy("lang").applyInArrow(learn, "lang string, nr int, centroid array<float>, bound double")
    table = learned.toArrow().sort_by([("lang", "ascending"), ("nr", "ascending")])
    found = [c.values.to_numpy() for c in table["centroid"]]
    return LanguageModel(table["lang"].to_pylist(), np.array(found, np.float32).reshape(len(found), DIMS), idf,
                         np.array(table["bound"].to_pylist()))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""

    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                languages, scores, rejected = model.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(languages, pa.string()), pa.array(scores),
                     pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they are."""

    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                yield part.filter(pa.array(~model.predict(texts)[2]))

    return map_rows(docs, run)
