"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 10).

*Fingerprints.*  Words of the lower-cased (A-Z) text, shingles of three words,
XXH64 (seed 42) of each; a bit of the fingerprint is 1 if more than half of the
hashes have it set.

*Candidates.*  A fingerprint's 64 bits are cut into three segments of 22, 21 and
21 bits.  Two fingerprints at most two bits apart agree in one segment at least
(pigeonhole).  The agreeing segment is taken exactly and the next one fuzzily:
the perfect binary Golay code (23, 12) decodes every word of 23 bits to the one
codeword within three bits, and the words within one bit of a segment decode to
one or six codewords.  Segments at most two bits apart have a word within one bit
of both, so they share a codeword.  A key is (which segment, its bits, index of a
codeword of the next): at most 18 keys for a fingerprint, of 33 bits each.

*Join and verify.*  Only distinct fingerprints take part, so exact copies cost
nothing here.  A bucket (fingerprints with one key) of at most ``BUCKET`` members
is joined with itself and pairs are verified by counting differing bits.  In a
larger bucket the number of pairs would be quadratic; there each member names the
65 words within one bit of itself: two fingerprints are at most two bits apart if
and only if they name a common word, and at most 65 fingerprints can name the
same word, so linking those to the least of them loses no component and no group
is large.  Both ways are exact.

*Components.*  Alternating large-star and small-star contraction over the links,
each round checkpointed in the shared folder, until nothing changes.

Defined results: null text and texts without a word have fingerprint zero and
are linked like any other; with fewer than three words the whole sequence is the
one shingle; rows with null ``doc_id`` are linked, but never name a component
(whose id is null if all its rows have none); repeated rows each give a row; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import KEY_1, KEY_2, text_blocks, with_key, written
from attrition.session import ensure_checkpoint_dir

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Largest bucket whose pairs are compared one by one.
BUCKET = 24
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code (23, 12).
GOLAY = 0b101011100011


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = (ends - [len(w) for w in words]).tolist()
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i:i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, the row keys and the fingerprint (a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                bits = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(bits)],
                                                 names=["doc_id", KEY_1, KEY_2, "bits"])

    keyed = with_key(docs.select("doc_id", "text"))
    return keyed.mapInArrow(run, f"doc_id long, {KEY_1} long, {KEY_2} long, bits long")


# -- Golay code ---------------------------------------------------------------

def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainder (11 bits) of each 23-bit word by the generator polynomial."""

    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainder of the low 12 bits, of the high 11, error patterns by remainder).

    The code is perfect: each of the 2,048 remainders has one pattern of at most
    three errors.  Row r of the patterns holds those that lead from a word with
    remainder r to the codewords of the words within one bit of it, -1 as filler.
    """

    one = [1 << i for i in range(23)]
    errors = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]),
                       *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])])
    nearest = np.full(2048, -1)
    nearest[_remainders(errors)] = errors
    patterns = np.full((2048, 6), -1)
    for r in range(2048):
        leads = {int(nearest[r])}
        for bit in one:
            leads.add(int(nearest[r ^ int(_remainders(np.array([bit]))[0])]) ^ bit)
        patterns[r, :len(leads)] = sorted(leads)
    return _remainders(np.arange(4096)), _remainders(np.arange(2048) << 12), patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords of all words within one bit; -1 as filler."""

    low, high, patterns = golay_tables()
    errors = patterns[low[words & 4095] ^ high[words >> 12]]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) of every key of every fingerprint."""

    parts = [(bits.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1) for at, width in SEGMENTS]
    owners, keys = [], []
    for k, part in enumerate(parts):
        near = codeword_indices(parts[(k + 1) % 3])
        row, col = np.nonzero(near >= 0)
        owners.append(row)
        keys.append((part[row] << 12 | near[row, col]) * 3 + k)
    return np.concatenate(owners), np.concatenate(keys)


def postings(distinct: DataFrame) -> DataFrame:
    """``key, bits``: every fuzzy key of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy()
            owner, key = fuzzy_keys(bits)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(bits[owner])], names=["key", "bits"])

    return distinct.select("bits").mapInArrow(run, "key long, bits long")


# -- links and components -----------------------------------------------------

def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b`` (a < b): links whose components are those of all pairs two bits apart or less."""

    keyed = postings(distinct)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = written(keyed.join(sizes, "key"))
    small = shared.filter(F.col("members") <= bucket)
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = (small.select("key", F.col("bits").alias("a"))
             .join(small.select("key", F.col("bits").alias("b")), "key")
             .filter((F.col("a") < F.col("b")) & (differing <= DISTANCE)).select("a", "b"))
    near = F.concat(F.array("bits"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    named = (shared.filter(F.col("members") > bucket).select("bits").distinct()
             .select("bits", F.explode(near).alias("word")))
    stars = (named.groupBy("word").agg(F.collect_list("bits").alias("all")).filter(F.size("all") > 1)
             .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b"))
    return pairs.union(stars).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step over undirected ``a, b``: neighbours move to the least of them."""

    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select("v", "u"))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    moved = met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else (
        met.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m"), F.col("u"))))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``bits, root`` for every fingerprint that has a link."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    # two narrow columns that are always read whole: rows in a checkpoint cost less than many small Parquet files
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.checkpoint()
    seen = state(edges)
    while seen[0]:
        edges = _star(_star(edges, large=True), large=False).checkpoint()
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("bits"), F.col("a").alias("root"))


def _linked(prints: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(fingerprint -> root, distinct fingerprints) of written fingerprints."""

    distinct = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    return components(links(distinct, bucket)), distinct


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""

    prints = written(fingerprints(docs, shingle))
    roots, distinct = _linked(prints, bucket)
    rooted = written(distinct.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_bits = rooted.join(named, "root").select("bits", "component_id")
    return prints.join(by_bits, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Of each component the row with the least ``doc_id`` (nulls last), all columns of ``docs``.

    Among rows that agree in ``doc_id`` and text, which are alike, one stays.
    """

    prints = written(fingerprints(docs, shingle))
    roots, _ = _linked(prints, bucket)
    order: Column = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", KEY_1, KEY_2)
    firsts = prints.groupBy("bits").agg(F.min(order).alias("first"))
    rooted = firsts.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(f"first.{KEY_1}", f"first.{KEY_2}")
    alike = Window.partitionBy(KEY_1, KEY_2).orderBy(F.lit(1))
    return (with_key(docs).join(kept, [KEY_1, KEY_2], "left_semi")
            .withColumn("__alike", F.row_number().over(alike)).filter("__alike = 1")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
