"""Language ID, line dedup, SimHash, PII and quality rules against plain versions of the same rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from llm_rows import DOC_SCHEMA, awkward_docs, empty_docs
from pyspark.sql import functions as F

from attrition.llm import language_id, line_dedup, pii_semicrf, quality_rules, simhash_golay

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


# -- language ID ----------------------------------------------------------------

def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_prediction_uses_the_text_alone(small):
    model = language_id.fit(small)
    texts = [r.text for r in small.orderBy("doc_id").limit(20).collect()]
    first = model.predict(texts)
    again = model.predict(texts[::-1])
    assert first[0] == again[0][::-1] and np.allclose(first[1], again[1][::-1])


def test_far_texts_are_rejected(small):
    model = language_id.fit(small)
    letters = random.Random(1)
    far = "".join(letters.choice("авгдежзиклмнопрстуфхцчшщъыьэюя ") for _ in range(4000))
    near = small.filter("lang = 'en' and length(text) > 500").first().text
    languages, _, rejected = model.predict([far, near, "123 !!", "", None or ""])
    assert rejected.tolist() == [True, False, True, True, True]
    assert languages[2:] == ["und"] * 3 and languages[1] == "en"


@pytest.mark.parametrize("wrong", [1, 8])
def test_wrong_labels_teach_nothing(spark, wrong):
    """One and a few per cent of the texts labelled en are in letters that no other text has."""

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang in ('en', 'de')")
    letters = random.Random(3)
    words = ["".join(letters.choices("авгдежзиклмнопрстуфхцчшщъыьэюя", k=letters.randint(2, 9))) for _ in range(400)]
    far = [" ".join(letters.choices(words, k=200)) for _ in range(40)]
    en = docs.filter("lang = 'en'").orderBy("doc_id").select("doc_id", "text").limit(400).collect()
    learned = [i for i, r in enumerate(en) if zlib.crc32(str(r.doc_id).encode()) % 4 != 2][:240]
    rows = [(en[i].doc_id, far[k] if k < wrong else en[i].text, "en", None, 1) for k, i in enumerate(learned)]
    model = language_id.fit(spark.createDataFrame(rows, DOC_SCHEMA))
    unseen = [r.text for r in en[340:]]
    assert model.predict(far[20:])[2].all()
    assert model.predict(unseen)[2].sum() <= 0.02 * len(unseen)


def test_a_language_keeps_several_centroids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(docs)
    assert Counter(model.languages) == {lang: language_id.CENTROIDS for lang in ("de", "en", "es", "fr")}
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)


def test_two_varieties_of_a_language_have_their_own_centroids():
    """Half the texts are in other letters: halving tells them apart, and no text is far from its centroid."""

    rng = random.Random(9)
    words = [["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(300)]
             for letters in ("abcdefghijklm", "nopqrstuvwxyz")]
    texts = [" ".join(rng.choices(words[i % 2], k=150)) for i in range(120)]
    x = language_id.weighted(np.array([language_id.ngram_counts(t) for t in texts], np.float32), np.ones(language_id.DIMS))
    centroids = language_id.spherical_kmeans(x, 2)
    own = (x @ centroids.T).argmax(axis=1)
    assert len(set(own[::2])) == len(set(own[1::2])) == 1 and own[0] != own[1]
    for c in range(2):  # a centroid is the sum of its rows, of length one
        total = sum(x[i] for i in range(120) if own[i] == c)
        assert np.allclose(centroids[c], total / math.sqrt(float((total * total).sum())), atol=1e-6)
    more, bound = language_id.language_centroids(x, 4)
    sizes = np.bincount((x @ more.T).argmax(axis=1))
    assert len(more) == 4 and sizes.min() >= 0.04 * len(x) and 0 < bound < 1
    assert len(language_id.spherical_kmeans(x[:1], 4)) == len(language_id.spherical_kmeans(np.repeat(x[:1], 9, 0), 4)) == 1


def test_prediction_equals_plain_vectors(small):
    """Counts, idf, cosines, scores and rejection once more, with dictionaries."""

    sample = [r for r in language_id.labelled_sample(small).collect()]
    seen = Counter(a for r in sample for a in r["at"])
    model = language_id.fit(small)
    idf = [math.log((1 + len(sample)) / (1 + seen[i])) + 1 for i in range(language_id.DIMS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    texts = [r.text for r in small.orderBy("doc_id").limit(60).collect() if r.text]
    languages, scores, rejected = model.predict(texts)
    for text, lang, score, gone in zip(texts, languages, scores, rejected):
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()
        if not any(c.isalpha() for c in text):
            assert (lang, score, gone) == ("und", 0, True)
            continue
        data = (" " + " ".join(words) + " ").encode()
        grams = Counter([data[i] << 8 | data[i + 1] for i in range(len(data) - 1)]
                        + [1 << 24 | data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)])
        hashed = Counter()
        for gram, n in grams.items():
            hashed[(gram * 2654435761 % 2**32) >> 19] += n
        vector = {i: math.log1p(n) * idf[i] for i, n in hashed.items()}
        length = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[i]) for i, v in vector.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(score - cosines[best]) < 1e-4 and max(
            cosines[i] for i in range(len(cosines)) if model.languages[i] == lang) > cosines[best] - 1e-4
        covered = math.sqrt(min(len(vector), language_id.FULL_NGRAMS) / language_id.FULL_NGRAMS)
        if abs(cosines[best] / covered - model.least[best]) > 1e-3:
            assert gone == (cosines[best] / covered < model.least[best])


def test_languages_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = language_id.identify(docs).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7, 9)} == {"und"}
    kept = language_id.drop_rejected(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert language_id.identify(empty_docs(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


# -- line dedup -------------------------------------------------------------------

def plain_windows(lines):
    """From each line on, and up to each line, the fewest lines that hold 50 words."""

    n, found = [len(line.split()) for line in lines], set()
    for i in range(len(lines)):
        j = next((j for j in range(i, len(lines)) if sum(n[i:j + 1]) >= 50), None)
        found |= {(i, j)} if j is not None else set()
        k = next((k for k in range(i, -1, -1) if sum(n[k:i + 1]) >= 50), None)
        found |= {(k, i)} if k is not None else set()
    return sorted((i, j) for i, j in found if j > i or lines[i].count(" ") < 49)


def plain_dedup(rows):
    """``{(doc_id, text): new text}``: one pass in order of id, chunks and windows compared as strings."""

    out, first = {}, {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        gone, seen, at = [False] * len(lines), {}, 0
        spans = []
        for chunk in line_dedup.chunks(text):
            i, at = at, at + len(chunk)
            long = len(chunk) == 1 and chunk[0].count(" ") >= 49 and chunk[0].strip()
            if long or len(chunk) >= 2 and "".join(chunk).strip():
                spans.append(("chunk", i, at - 1))
        spans += [("window", i, j) for i, j in plain_windows(lines)]
        for kind, i, j in spans:
            name = (kind, *lines[i:j + 1])
            end = seen.setdefault(name, j)
            if first.setdefault(name, doc_id) != doc_id or end < (j if kind == "chunk" else i):
                gone[i:j + 1] = [True] * (j + 1 - i)
        out[doc_id, text] = "\n".join(line for line, g in zip(lines, gone) if not g)
    return out


def test_chunks_are_shift_resistant():
    rng = random.Random(2)
    passage = [f"line {rng.random()}" for _ in range(40)]
    a = line_dedup.chunks("\n".join(["x", "y", "z"] + passage))
    b = line_dedup.chunks("\n".join([f"other {i}" for i in range(10)] + passage + ["end"]))
    shared = {tuple(c) for c in a} & {tuple(c) for c in b}
    assert sum(map(len, shared)) > 25
    assert "\n".join(line for c in a for line in c) == "\n".join(["x", "y", "z"] + passage)
    assert all(len(c) >= 2 for c in a[:-1])


def test_a_long_passage_on_one_line_stays_once(spark):
    passage = " ".join(f"w{k}" for k in range(55))
    docs = spark.createDataFrame([(i, f"own {i}\n{passage}\nend {i}", None, None, 1) for i in range(4)], DOC_SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: f"own 0\n{passage}\nend 0"} | {i: f"own {i}\nend {i}" for i in (1, 2, 3)}


def test_passages_of_short_lines_stay_once(spark):
    """Passages of 2 to 6 lines at random places; nothing but a passage's first copy stays, and no own line goes."""

    rng = random.Random(8)
    sizes = [rng.randint(2, 6) for _ in range(60)]
    passages = [[" ".join(f"p{p}-{i}-{w}" for w in range(max(2, rng.randint(50, 58) // n + 1))) for i in range(n)]
                for p, n in enumerate(sizes)]
    passages += [[" ".join(f"q{p}-{i}-{w}" for w in range(n)) for i, n in enumerate((45, 4, 3))] for p in range(10)]
    rows, want, used = [], {}, set()
    for d in range(150):
        lines, kept = [], []
        for k in range(rng.randint(1, 4)):
            own = [f"own {d} {k} {rng.random()}" for _ in range(rng.randint(1, 4))]
            p = rng.randrange(len(passages))
            lines += own + passages[p]
            kept += own + ([] if p in used else passages[p])
            used.add(p)
        rows.append((d, "\n".join(lines), None, None, 1))
        want[d] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got == want


def test_a_line_repeated_in_a_document_is_not_lost():
    text = "\n".join(["one two three four five six"] * 100)
    [(kept, removed)] = line_dedup.kept_texts([text], [set()])
    assert removed == 100 - kept.count("\n") - 1 and kept.startswith("one two three four five six")


@pytest.mark.parametrize("bits", [64, 5])
def test_line_dedup_equals_one_pass(spark, bits):
    """Five hash bits: many different chunks share a hash and must be told apart by their text."""

    rng = random.Random(4)
    passages = [[f"p{i} line {rng.randint(0, 99)}" for _ in range(rng.randint(2, 12))] for i in range(15)]
    passages += [[" ".join(f"w{i}-{k}" for k in range(60))] for i in range(5)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [f"own {d} {rng.random()}" for _ in range(3)]
        rows.append((d, "\n".join(lines)))
    want = {k[0]: v for k, v in plain_dedup(rows).items()}
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], DOC_SCHEMA)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, hash_bits=bits, report="gone").collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert sum(r.gone for r in got.values()) > 100


def test_line_dedup_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = out.collect()
    assert Counter(r.text is None for r in rows)[True] == 2
    by_id = [(r.doc_id, r.text) for r in rows if r.doc_id in (1, 2)]
    assert ((1, "Hello there.\nA second line here.\nA third one stands here.") in by_id)
    assert len({t for d, t in by_id if d == 2}) == 1 and len([1 for d, t in by_id if d == 2]) == 2
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_many_rows_of_one_id(spark):
    """All rows of an id are one document; what is looked up for a row is bounded by its own text."""

    passage = "\n".join(f"shared line {k} of the passage" for k in range(20))
    rows = [(0, passage, None, None, 1)] + [(7, f"own {i}\n{passage}\nend {i}", None, None, 1) for i in range(60)]
    got = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOC_SCHEMA)).collect()]
    assert sorted(got) == sorted([passage] + [f"own {i}\nend {i}" for i in range(60)])


def test_equal_hashes_of_different_bytes_are_seen(spark):
    docs = spark.createDataFrame([(i, f"a {i % 7}\nb {i % 5}\nc {i % 3}\nd", None, None, 1) for i in range(50)], DOC_SCHEMA)

    def wrong(bits):
        table = line_dedup.span_table(docs, 0, bits)
        repeated = table.groupBy("h", "g").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last")
        return line_dedup.ambiguous(docs, repeated, 0, bits).count()

    assert wrong(64) == 0 and wrong(3) > 0


# -- SimHash ----------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def plain_components(prints):
    """``{fingerprint: root}`` over all pairs two bits apart or less."""

    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_golay_words_two_bits_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 4000)
    b = a ^ (1 << rng.integers(0, 23, 4000)) ^ (1 << rng.integers(0, 23, 4000))
    near_a, near_b = simhash_golay.codeword_indices(a), simhash_golay.codeword_indices(b)
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(near_a, near_b))
    assert set((near_a >= 0).sum(axis=1)) == {1, 6}


@pytest.mark.parametrize("bucket", [0, 4, 1000])
def test_components_of_dense_clusters(spark, bucket):
    """Chains and clouds of fingerprints, by pairs alone, by named words alone, and by both."""

    rng = random.Random(6)
    prints = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            prints.append(at)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "bits long")
    got = {r.bits: r.root for r in simhash_golay.components(simhash_golay.links(frame, bucket)).collect()}
    groups, want = {}, {}
    for s, p in zip(signed, prints):
        groups.setdefault(got.get(s, s), set()).add(p)
    for p, r in plain_components(prints).items():
        want.setdefault(r, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(1000 + i, t) for i, t in enumerate(["", None, "one", "One two"])]
    docs = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], DOC_SCHEMA)
    prints = {d: plain_fingerprint(t) for d, t in rows}
    root = plain_components(list(dict.fromkeys(prints.values())))
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_golay.near_duplicates(docs).collect()}
    assert got == {d: (format(p, "016x"), least[root[p]]) for d, p in prints.items()}


def test_one_of_each_component_stays(spark):
    docs = awkward_docs(spark)
    linked = simhash_golay.near_duplicates(docs).collect()
    assert len(linked) == docs.count()
    out = simhash_golay.keep_one_of_each(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    fingerprints = {(r.doc_id, plain_fingerprint(r.text)) for r in rows}
    assert len(rows) == len(fingerprints) == len({r.fingerprint for r in linked})
    assert [r.doc_id for r in rows if r.text and r.text.startswith("Hello")] == [1]
    assert simhash_golay.near_duplicates(empty_docs(spark)).count() == 0
    assert simhash_golay.keep_one_of_each(empty_docs(spark)).count() == 0


# -- personal data ------------------------------------------------------------------

def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii_semicrf.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_time_grows_with_the_number_of_spans():
    """One stretch of addresses and many separate ones: ten times the text takes no more than about ten times as long."""

    import time

    model = pii_semicrf.SemiCrf({("ip", "bias"): 1.0})

    def seconds(text):
        began = time.process_time()
        base = pii_semicrf.base_spans(text)
        pii_semicrf.model_spans(text, base, model)
        return time.process_time() - began, len(base)

    for piece in ("10.20.30.40 ", "someone@example.org, ", "10.1.2.3\n+1 743 555 3824 or "):
        few, n = seconds(piece * 1500)
        many, ten = seconds(piece * 15000)
        assert ten >= 10 * n - 10 and n >= 1500
        assert many < 25 * few + 0.5, piece


def test_closed_tokens_are_those_under_a_span():
    rng = random.Random(12)
    text = "".join(rng.choice("0123456789. ()-") for _ in range(300))
    for _ in range(200):
        start = rng.randrange(250)
        closed = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(300) for _ in range(4))]
        cuts, found = pii_semicrf.candidates(text, start, start + 50, closed)
        assert all(not (a < cuts[j] and cuts[i] < b) for i, j, *_ in found for a, b in closed)
        every = pii_semicrf.candidates(text, start, start + 50)[1]
        open_ = {(i, j) for i, j, *_ in every if not any(a < cuts[j] and cuts[i] < b for a, b in closed)}
        assert {(i, j) for i, j, *_ in found} == open_


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("a1@.-+ ()%9é0\n2@.5") for _ in range(rng.randint(0, 40)))
        assert pii_semicrf.base_spans(text) == plain_spans(text)


def test_best_labelling_is_the_best_of_all():
    """The dynamic program against all segmentations."""

    rng = random.Random(9)

    def best(n, scored):
        values = {0: 0.0}
        for t in range(1, n + 1):
            values[t] = max([values[t - 1]] + [values[i] + s for i, j, s in scored if j == t])
        return values[n]

    def brute(t, n, scored):
        if t == n:
            return 0.0
        return max([brute(t + 1, n, scored)] + [s + brute(j, n, scored) for i, j, s in scored if i == t])

    for _ in range(50):
        n = rng.randint(1, 7)
        cands = [(i, j, ("card", "phone"), [f"{i}-{j}"]) for i in range(n) for j in range(i + 1, n + 1)]
        model = pii_semicrf.SemiCrf({(k, f"{i}-{j}"): rng.uniform(-2, 2) for i, j, ks, _ in cands for k in ks})
        scored = [(i, j, max(model.score(k, f) for k in ks)) for i, j, ks, f in cands]
        got = sum(model.score(k, [f"{i}-{j}"]) for i, j, k in model.decode(n, cands, margin=0.0))
        assert abs(got - brute(0, n, scored)) < 1e-9 and abs(got - best(n, scored)) < 1e-9


def test_personal_data_of_a_corpus(spark, small):
    rows = small.collect()
    want = {r.doc_id: plain_spans(r.text) for r in rows}
    model = pii_semicrf.fit(small)
    assert model.weights
    got = pii_semicrf.find_spans(small, model).collect()
    for r in got:
        base = [f"{k}:{a}:{b}" for k, a, b in want[r.doc_id]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[0] == k for s in want[r.doc_id]) for k in pii_semicrf.KINDS)
    assert sum(r.n_added for r in got) <= 0.2 * sum(map(len, want.values()))


def test_the_model_finds_what_the_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii_semicrf.fit(docs)
    text = "so 4111111111111111 55 it is"  # the pattern takes all digits and fails
    assert pii_semicrf.base_spans(text) == []
    assert pii_semicrf.model_spans(text, [], model) == [("card", 3, 19)]
    assert pii_semicrf.model_spans("in the year 2024 there were 15 of 300", [], model) == []


def test_masking_awkward_rows(spark):
    docs = awkward_docs(spark)
    out = pii_semicrf.mask_personal_data(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[8].text.startswith("mail <EMAIL> or <PHONE>, <IP> <|endo") and rows[8].n_chars == len(rows[8].text)
    assert rows[3].text is None
    assert pii_semicrf.find_spans(docs).count() == docs.count()
    assert pii_semicrf.find_spans(empty_docs(spark)).count() == 0


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1 " * 100_000, "+1" * 100_000, "1." * 100_000, "x@" * 50_000):
        pii_semicrf.base_spans(text)
        pii_semicrf.model_spans(text, [], pii_semicrf.SemiCrf({("card", "bias"): -1.0}))


# -- quality rules --------------------------------------------------------------------

def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(lines))


def plain_distances(rows, steps=quality_rules.STEPS, least=quality_rules.GROUP_ROWS):
    """``{doc_id: squared distance or None}``, group by group with numpy."""

    x, group = {}, {}
    for d, lang, source, text in rows:
        n, chars, symbols, _, repeat, lines = plain_base(text)
        if n >= 10 and 100 * repeat <= 20 * n:
            m = n + 50
            x[d] = np.floor(0.5 + 1000 * np.array([(chars + 250) / m, 10 * symbols / m, 10 * repeat / m,
                                             np.log(m / (lines + 5))])) / 1000
            group[d] = (lang, source)
    sizes = Counter(group.values())
    group = {d: g if sizes[g] >= least else g[0] for d, g in group.items()}
    out = {}
    for g in set(group.values()):
        ids = [d for d in x if group[d] == g]
        if len(ids) < least:
            continue
        a = np.array([x[d] for d in ids])
        median = np.array([np.floor(np.sort(a[:, k] * 1000 + 1e-6) / 10)[(len(a) - 1) // 2] / 100 for k in range(4)])
        squared = ((a - median) ** 2).sum(axis=1) / quality_rules.FLOOR
        for _ in range(steps + 1):
            bins = np.floor(np.log1p(squared) * 200)
            order = np.sort(bins)
            last = order[int(np.ceil(quality_rules.SUPPORT * len(a))) - 1]
            part = a[bins <= last]
            cov = np.cov(part.T, bias=True) * quality_rules.CONSISTENCY + np.eye(4) * quality_rules.FLOOR
            off = a - part.mean(axis=0)
            squared = (off @ np.linalg.inv(cov) * off).sum(axis=1)
        out.update(zip(ids, squared))
    return out


def test_quality_rules_against_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in docs.collect()]
    want = plain_distances(rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows) and want
    for d, _, _, text in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text)[:5]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if d in want:
            assert r.distance == pytest.approx(want[d], rel=1e-3, abs=1e-3)
            assert r.kept == (r.distance <= quality_rules.CUTOFF)
        else:
            assert r.distance is None and r.kept == (not r.base_failed)


def test_quality_rules_reject_junk_and_keep_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_rules.quality_rules(docs).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id] == 1]
    bad = [r.kept for r in rows if labels[r.doc_id] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_quality_of_rare_languages_and_sources(spark):
    """Few documents of a language or source: pool, whole language, then all documents; each has a distance."""

    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(100))
    junk = " ".join(f"#{w}$%&*|" for w in range(100))
    counts = {("en", "web"): 60, ("en", "rare"): 3, ("de", "a"): 12, ("de", "b"): 12, ("sw", "x"): 2, ("fr", "y"): 30}
    rows = [(lang, source, prose()) for (lang, source), n in counts.items() for _ in range(n)]
    rows += [("en", "rare", junk), ("de", "a", junk), ("sw", "x", junk), ("fr", "y", junk), ("en", "web", "short")]
    docs = spark.createDataFrame([(i, t, la, so, 1) for i, (la, so, t) in enumerate(rows)], DOC_SCHEMA)
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.distance is None) == r.base_failed
        if not r.base_failed:
            assert r.kept == (rows[r.doc_id][2] != junk)


def test_quality_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_rules_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    rows = quality_rules.quality_rules(docs).collect()
    assert len(rows) == docs.count()
    want = Counter(plain_base(r.text)[:5] for r in docs.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.quality_rules(empty_docs(spark)).count() == 0
