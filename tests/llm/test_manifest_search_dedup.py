"""Merkle manifest, lexical search and exact dedup against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import DOC_SCHEMA, awkward_docs, empty_docs

from attrition.llm import exact_dedup, lexical_search, merkle_manifest

SMALL = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- Merkle manifest ---------------------------------------------------------------

def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def plain_manifest(rows, fanout=16):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda x: x[:3]) for s in names}
    trees = {s: levels_of([x[2] for x in ordered[s]], fanout) for s in names}
    top = levels_of([trees[s][-1][0] for s in names], fanout) if names else [[]]
    out = []
    for j, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(ordered[s]):
            beside = []
            for tree, at in ((trees[s], i), (top, j)):
                for level in tree[:-1]:
                    first = at // fanout * fanout
                    beside.append((level[first:at], level[at + 1:first + fanout]))
                    at //= fanout
            now = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                now = leaf(r, None if r.text is None else r.text.translate(LOW))
            for left, right in beside:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(a + b) for a, b in beside))
            out.append((r.doc_id, own, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return Counter(out)


def found_manifest(docs, **sizes):
    return Counter(tuple(r) for r in merkle_manifest.manifest(docs, **sizes).collect())


def test_manifest_equals_plain_trees(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_manifest(docs.collect())
    assert found_manifest(docs) == want
    assert 0 < sum(not r[-1] for r in want) < sum(want.values())


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_of_many_rounds(spark, levels):
    """Three children a node: deep trees, several rounds of blocks, one source with most rows, many with one."""

    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i}", i) for i in range(300)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(7)
    assert found_manifest(docs, fanout=3, levels=levels) == plain_manifest(docs.collect(), 3)


def test_every_change_of_a_leaf_shows():
    digests = [sha(str(i)).encode() for i in range(40)]
    nodes = merkle_manifest.forward(0, digests, 40)
    top = nodes[max(nodes)]
    proofs = dict(merkle_manifest.backward(nodes, 40, (b"", b"", b"")))
    assert sorted(proofs) == list(range(40))
    for pos, proof in proofs.items():
        assert merkle_manifest.fold(digests[pos], *proof) == top
        assert merkle_manifest.fold(digests[pos - 1], *proof) != top


def test_manifest_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    assert found_manifest(docs) == plain_manifest(docs.collect())
    assert merkle_manifest.manifest(empty_docs(spark)).count() == 0
    alone = docs.filter("doc_id = 6")
    assert found_manifest(alone) == plain_manifest(alone.collect())


# -- lexical search -------------------------------------------------------------------

def plain_search(docs, items, k=20):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    words = [(d, pattern.findall((t or "").translate(LOW))) for d, t in docs]
    n = sum(bool(w) for _, w in words)
    total = sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item_id, text in set(items):
        asked = pattern.findall((text or "").translate(LOW))
        scores = []
        for d, w in words:
            m = 75 + (25 * len(w) * n) // max(total, 1)
            tf = Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                        for t in asked if tf[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def found_search(spark, docs, items, k=20, window=lexical_search.WINDOW, **shards):
    index = lexical_search.build_index(docs, **shards)
    return Counter(tuple(r) for r in lexical_search.search(index, items, k, window).collect())


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("k, window, shards", [(20, 4096, {}), (3, 16, {"shard_docs": 50}), (1, 8, {"shard_terms": 2000})])
def test_search_equals_brute_force(spark, k, window, shards):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search(pairs_of(docs, "doc_id", "text"), pairs_of(items, "item_id", "text"), k)
    assert found_search(spark, docs, items, k, window, **shards) == want


def test_search_with_ties_and_frequent_words(spark):
    """A word that all documents hold, ties over many documents, terms that the item repeats."""

    rng = random.Random(4)
    words = ["the", "the", "the"] + [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((3, 3, 4, 60)))), None, None, 1) for i in range(900)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    items = spark.createDataFrame([(1, "the w1"), (2, "w1 w2 w2, w3 THE the"), (3, "none"), (4, ""), (5, None)],
                                  "item_id long, text string")
    want = plain_search(pairs_of(docs, "doc_id", "text"), pairs_of(items, "item_id", "text"))
    assert found_search(spark, docs, items, window=64) == want


def test_block_maxima_keep_blocks_packed():
    """Once a threshold stands, blocks of a frequent word that can't reach it are never decompressed."""

    n = 8192
    tf = {b"rare": np.array([5, 900, 4000]), b"often": np.arange(n)}
    lengths = np.where(np.arange(n) < 64, 10, 1000)
    lists = {}
    for name, docs in tf.items():
        made = lexical_search.encode(np.zeros(len(docs), np.int64), docs, np.ones(len(docs), np.int64), lengths)
        blocks = np.stack([made[c] for c in ("first", "last", "size", "gap_width", "tf_width", "pairs")], 1)
        pairs = np.stack([made["pair_tf"], made["pair_length"]], 1)
        lists[name] = lexical_search.PostingList(blocks, pairs, made["data"].tobytes(),
                                                 lexical_search.damping(lengths, n, int(lengths.sum())), n, int(lengths.sum()))
    docs, scores = lexical_search.max_score([(9000, lists[b"rare"]), (1, lists[b"often"])], np.arange(n), 3)
    assert sorted(docs.tolist()) == [5, 900, 4000] and scores[0] >= scores[-1] > 0
    assert lists[b"often"].packed.mean() > 0.4


def test_search_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    items = docs.selectExpr("doc_id as item_id", "text", "n_chars as rank", "n_chars as score")
    want = plain_search(pairs_of(docs, "doc_id", "text"), pairs_of(items, "item_id", "text"))
    assert found_search(spark, docs, items) == want
    assert lexical_search.ranked_search(empty_docs(spark), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0


# -- exact dedup --------------------------------------------------------------------

def plain_duplicates(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOW)].append(d)
    out = []
    for text, ids in groups.items():
        kept = max(ids, key=lambda d: (d is not None, d or 0))
        first = True
        for d in ids:
            out.append((d, kept, len(ids), d == kept and first, sha(text)))
            first = first and d != kept
    return Counter(out)


def found_duplicates(docs, **sizes):
    return Counter(tuple(r)[:5] for r in exact_dedup.exact_duplicates(docs, **sizes).collect())


def test_exact_copies_equal_grouping_by_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain_duplicates(pairs_of(docs, "doc_id", "text"))
    assert found_duplicates(docs) == want
    assert found_duplicates(docs, chunk=100, huge=1000) == want


def test_fingerprints_compose():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 1000).astype(np.uint8)
    p = exact_dedup.MODULUS
    for chunk in (1000, 64, 7):
        got = exact_dedup.fingerprints(data, np.array([0, 0, 400]), np.array([1000, 0, 600]), 4, chunk=chunk)
        for row, part in zip(got, (data, data[:0], data[400:])):
            plain = [sum(int(x) * pow(exact_dedup.base(k, p), i, p) for i, x in enumerate(part)) % p for k in range(4)]
            assert row.tolist() == [plain[0] << 31 | plain[1], plain[2] << 31 | plain[3]]


def test_equal_fingerprints_of_different_texts_are_told_apart(spark):
    """A modulus of 13 makes most texts of a length collide, over several chunks and in huge texts."""

    rng = random.Random(6)
    texts = ["".join(rng.choices("abAB", k=n)) for n in (1, 2, 5, 9, 40, 40, 90) for _ in range(12)]
    rows = [(i, rng.choice(texts), None, None, 1) for i in range(400)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    found = exact_dedup.exact_duplicates(docs, modulus=13, chunk=8, huge=64)
    assert found.first().n_bases > 2
    assert Counter(tuple(r)[:5] for r in found.collect()) == plain_duplicates([r[:2] for r in rows])


def test_exact_copies_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    assert found_duplicates(docs) == plain_duplicates(pairs_of(docs, "doc_id", "text"))
    assert exact_dedup.exact_duplicates(empty_docs(spark)).count() == 0
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(pairs_of(kept, "doc_id")) == Counter((d,) for d, _, _, k, _ in plain_duplicates(
        pairs_of(docs, "doc_id", "text")).elements() if k)
