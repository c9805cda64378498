"""Token counts, byte-level BPE and packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from llm_rows import DOC_SCHEMA, awkward_docs, empty_docs
from tokenizers import Tokenizer

from attrition.llm import byte_bpe, packing, token_counts

ALPHABET = "abcdefgh éè  \n\t日本語😀-=#▁'stßñ1234567"


def random_texts(n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return token_counts._model(None)


def test_splices_give_the_whole_encoding(pieces):
    sp, joined = pieces
    texts = random_texts(60, 3000) + ["ab" * 900, "a" * 700 + " " * 300 + "word word " * 50, " " * 2000, "日" * 900]
    widened = 0
    for text in texts:
        for chunk, overlap in ((100, 10), (256, 32), (1000, 1)):
            n, w = token_counts.count_long(text, sp, joined, chunk, overlap)
            assert n == len(sp.encode(text))
            widened += w
    assert widened  # overlaps without a stable place did occur


def test_no_piece_spans_a_stable_place(pieces):
    sp, joined = pieces
    assert not token_counts.is_stable("ab", 1, joined)
    assert token_counts.is_stable("a b", 1, joined)  # before a space
    assert token_counts.is_stable("a\U0001f9ffb", 1, joined)  # a character outside the vocabulary


def test_token_counts_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    got = token_counts.count_tokens(docs, chunk_chars=64, overlap_chars=8).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.collect()
    assert len(got) == len(rows)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert token_counts.count_tokens(empty_docs(spark)).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe._coder(None)


def test_matrix_rounds_equal_the_library(bpe):
    coder, _ = bpe
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    find = regex.compile(public_tokenizers.PATTERN).findall
    texts = random_texts(200, 400, seed=2) + ["a" * 3000, "ab" * 2000, "=-" * 700, "<|endoftext|>", " " * 1500]
    for text in texts:
        split = find(text)
        ids = [i for got in coder.encode_pieces([p.encode() for p in split]) for i in got]
        assert ids == encoding.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_long_pieces_take_the_same_merges(bpe):
    coder, _ = bpe
    rng = random.Random(5)
    for _ in range(30):
        piece = "".join(rng.choice("abcdeé") for _ in range(300)).encode()
        assert coder._encode_long(piece) == coder._encode_bucket([piece])[0]


def test_byte_bpe_of_awkward_rows(spark, bpe):
    coder, _ = bpe
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    docs = awkward_docs(spark)

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    want = []
    for r in docs.collect():
        ids = encoding.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.encode_documents(docs, output="digest").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    full = byte_bpe.encode_documents(docs).collect()
    assert sorted(hashlib.sha256(bytes(r.decoded)).hexdigest() for r in full) == sorted(w[3] for w in want)
    assert sorted(len(r.ids) for r in full) == sorted(w[1] for w in want)
    assert byte_bpe.encode_documents(empty_docs(spark)).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    placed = packing.first_fit_decreasing(sizes, 100)
    rooms, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bin_ = next((b for b, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        if bin_ == len(rooms):
            rooms.append(100)
        want[i] = (bin_, 100 - rooms[bin_])
        rooms[bin_] -= sizes[i]
    assert placed == [want[i] for i in range(len(sizes))]


def test_packing_ids_are_those_of_the_tokenizers_file():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing._encoder(None)
    every = "".join(chr(c) for c in range(0x20, 0x3000))
    for text in [*random_texts(200, 200, seed=4), "a <|endoftext|> b<|endoftext|>", "x y\u0085z  w", every]:
        assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == tokenizer.encode(
            text, add_special_tokens=False).ids


def test_packing_ids_of_long_runs():
    """Runs beyond what the pattern search of the fast library can take."""

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = packing._encoder(None)
    n = 1_100_000
    for text in ("\n" * n, "a b" + " " * n + "c d", "a" + "\n" * n + "c", "x<|endoftext|>" + "\t" * n + "<|endoftext|> y",
                 "a" + " \n\u3000" * (n // 3) + " b" + "\x1c" * 3 + "\n" * n + ".", "a" * n + " " + "1" * n + "." * n):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert packing.encode(encoder, text).tolist() == want


def test_packing_keeps_every_id_once(spark):
    docs = awkward_docs(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, capacity=16, group_docs=8).collect()
    sequences = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    want = sorted(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
    pieces = {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 16):
            key = (r.doc_id, start, len(ids), tuple(ids[start:start + 16]))
            pieces[key] = pieces.get(key, 0) + 1
    for r in got:
        pieces[r.doc_id, r.start, r.doc_tokens, tuple(r.ids)] -= 1
    assert not any(pieces.values()) and sum(map(len, want)) == sum(r.length for r in got)
    thin = packing.pack_documents(docs, keep_ids=False)
    assert "ids" not in thin.columns and thin.filter("start = 0").count() == docs.count()
    assert packing.pack_documents(empty_docs(spark)).count() == 0


def test_packing_pads_little(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 700))), None, None, 0)
            for i in range(600)]
    got = packing.pack_documents(spark.createDataFrame(rows, DOC_SCHEMA), keep_ids=False).collect()
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used.values())
    assert padding < 0.02 * sum(used.values())


def test_rank_files_agree():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert len({base64.b64decode(line.split()[0]) for line in f}) == 50256
