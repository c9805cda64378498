"""Personal data by fixed patterns and a semi-Markov conditional random field (operator 2).

*Base spans* come from four patterns (e-mail, IP address, payment card, phone),
leftmost and non-overlapping per kind, without retries; their places are those of
the patterns, found in time linear in the text.

*Model.*  Around an ``@`` and in runs of digits and separators, a text is cut into
tokens; every segment of at most ``MAX_TOKENS`` tokens that could be an entity is
a candidate with features of the whole span (digits, groups, separators, checksum,
what stands beside it), one weight vector per kind.  A labelling of a stretch is a
sequence of single outside tokens and segments; its score is the sum of its
segments' scores.  Weights are those of the greatest likelihood (forward and
backward sums over all segmentations) on a bounded sample of stretches whose base
spans serve as labels.  Decoding is the bounded-entity dynamic program over all
segmentations, choosing boundaries and kinds together.  Base spans stay: what the
model adds never overlaps one, and must win by ``MARGIN``.

Stretches are maximal, so segments of different stretches never compete and
long texts need no windows.

Defined results: null text is empty and has no span; places are code points, end
exclusive; repeated rows each give a row; an empty table gives no rows; without
any base span to learn from the model adds nothing; other columns are ignored or
pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.llm.common import map_rows, text_blocks

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Longest entity in tokens: with an ``@``, and of numbers; most digits of the latter.
MAX_TOKENS, MAX_NUMBER_TOKENS, MAX_DIGITS = 24, 16, 19
SAMPLE_PER_KIND = 250
EPOCHS, RATE, DECAY = 6, 0.3, 0.002
MARGIN = 2.0

# -- base patterns (fixed by the contract of the query) -----------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits: from the run's start it ends the same way.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """By kind as listed in ``KINDS``, then by start."""

    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# -- stretches and candidate segments ------------------------------------------

_NUMBERS = re.compile(r"(?<![A-Za-z0-9_])[+(]?[0-9](?:[0-9().+/ -]*[0-9])?(?![A-Za-z0-9_])")
_AROUND_AT = re.compile(r"(?<![^\s@,;:<>()\[\]\"'])[^\s@,;:<>()\[\]\"']+(?: ?@ ?[^\s@,;:<>()\[\]\"']+)+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.DOTALL)
_GROUP = re.compile(r"[0-9]+")


def stretches(text: str) -> list[tuple[int, int]]:
    """Places that may hold entities: runs of numbers and words around an ``@``."""

    found = [m.span() for m in _AROUND_AT.finditer(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBERS.finditer(text)
                  if m.end() - m.start() >= 7 and sum(map(str.isdigit, m.group())) >= 4]
    return sorted(found)


class Overlaps:
    """Spans by kind; those of a kind don't overlap, so both ends ascend and a look-up is a bisection."""

    def __init__(self, spans: list[Span]):
        self.kinds: dict[str, tuple[list[int], list[int]]] = {}
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            starts, ends = self.kinds.setdefault(kind, ([], []))
            starts.append(a)
            ends.append(b)

    def of(self, start: int, end: int) -> list[Span]:
        out = []
        for kind in KINDS:
            starts, ends = self.kinds.get(kind, ((), ()))
            out += [(kind, starts[k], ends[k]) for k in range(bisect_right(ends, start), bisect_left(starts, end))]
        return out


def _beside(c: str) -> str:
    return "^" if not c else "s" if c.isspace() else "a" if c.isalpha() else "d" if c.isdigit() else c


def features(segment: str, before: str, after: str) -> list[str]:
    """Of a whole span."""

    groups = _GROUP.findall(segment)
    n = sum(map(len, groups))
    signs = "".join(sorted({c for c in segment if not c.isalnum()}))
    out = ["bias", f"n={min(n, 21)}", f"signs={signs}", f"left={_beside(before)}", f"right={_beside(after)}",
           f"first={_beside(segment[0])}", f"last={_beside(segment[-1])}", f"groups={min(len(groups), 8)}"]
    if "@" in segment:
        domain = segment.rpartition("@")[2]
        out += [f"dots={min(domain.count('.'), 3)}", f"tld={domain.rpartition('.')[2].isalpha()}",
                f"ats={min(segment.count('@'), 2)}"]
    else:
        out.append("shape=" + "-".join(str(min(len(g), 9)) for g in groups[:6]))
        if len(groups) == 4:
            out.append(f"bytes={all(map(_small, groups))}{signs}")
        if 12 <= n <= 19:
            out.append(f"luhn={luhn(''.join(groups))}")
            out.append(f"luhn{n}={luhn(''.join(groups))}")
    return out


def candidates(text: str, start: int, end: int, closed: list[tuple[int, int]] = ()) -> tuple[list[int], list[tuple]]:
    """(token starts and the end, candidates ``(i, j, kinds, features)`` over token numbers).

    ``closed``: spans that no candidate may overlap.
    """

    cuts = [start + m.start() for m in _TOKEN.finditer(text[start:end])] + [end]
    free = [True] * (len(cuts) - 1)
    for a, b in closed:
        for t in range(max(0, bisect_right(cuts, a) - 1), min(len(free), bisect_left(cuts, b))):
            free[t] = False
    out = []
    for i in range(len(cuts) - 1):
        head = text[cuts[i]]
        if not (head.isalnum() or head in "+("):
            continue
        digits = at = letters = dots = 0
        for j in range(i, min(i + MAX_TOKENS, len(cuts) - 1)):
            if not free[j]:
                break
            piece = text[cuts[j]:cuts[j + 1]]
            if "0" <= piece[0] <= "9":
                digits += len(piece)
            elif piece == "@":
                at += 1
            elif piece[0].isalpha():
                letters += 1
            elif piece == ".":
                dots += 1
            if at > 1 or not at and not letters and (digits > MAX_DIGITS or j - i >= MAX_NUMBER_TOKENS):
                break
            if not piece[0].isalnum():
                continue
            numbers = not letters and (digits >= 7 or digits >= 4 and dots == 3)
            kinds = ("email",) if at else ("ip", "card", "phone") if numbers else ()
            if kinds:
                a, b = cuts[i], cuts[j + 1]
                out.append((i, j + 1, kinds, features(text[a:b], text[a - 1:a], text[b:b + 1])))
    return cuts, out


# -- semi-Markov conditional random field --------------------------------------

def _logadd(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


@dataclass
class SemiCrf:
    weights: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, kind: str, feats: list[str]) -> float:
        get = self.weights.get
        return sum([get((kind, f), 0.0) for f in feats])

    def train(self, examples: list[tuple[int, list[tuple], set]], epochs: int = EPOCHS) -> SemiCrf:
        """``(tokens, candidates, {(i, j, kind) that are entities})``; adaptive gradient ascent."""

        squares: dict[tuple[str, str], float] = {}
        for _ in range(epochs):
            for n, cands, gold in examples:
                segments = [(i, j, kind, feats, self.score(kind, feats)) for i, j, kinds, feats in cands
                            for kind in kinds]
                ends: list[list] = [[] for _ in range(n + 1)]
                begins: list[list] = [[] for _ in range(n + 1)]
                for s in segments:
                    ends[s[1]].append(s)
                    begins[s[0]].append(s)
                forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
                for t in range(1, n + 1):
                    forward[t] = forward[t - 1]  # an outside token scores nothing
                    for i, _, _, _, value in ends[t]:
                        forward[t] = _logadd(forward[t], forward[i] + value)
                for t in range(n - 1, -1, -1):
                    backward[t] = backward[t + 1]
                    for _, j, _, _, value in begins[t]:
                        backward[t] = _logadd(backward[t], backward[j] + value)
                gradient: dict[tuple[str, str], float] = {}
                for i, j, kind, feats, value in segments:
                    step = ((i, j, kind) in gold) - math.exp(forward[i] + value + backward[j] - forward[n])
                    if abs(step) > 1e-4:
                        for f in feats:
                            gradient[kind, f] = gradient.get((kind, f), 0.0) + step
                for key, g in gradient.items():
                    g -= DECAY * self.weights.get(key, 0.0)
                    squares[key] = squares.get(key, 1e-6) + g * g
                    self.weights[key] = self.weights.get(key, 0.0) + RATE * g / math.sqrt(squares[key])
        return self

    def decode(self, n: int, cands: list[tuple], margin: float = MARGIN) -> list[tuple[int, int, str]]:
        """Segments ``(i, j, kind)`` of the best labelling of ``n`` tokens."""

        best, back = [0.0] * (n + 1), [None] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for i, j, kinds, feats in cands:
            value, kind = max((self.score(kind, feats), kind) for kind in kinds)
            if value > margin:
                ends[j].append((i, value - margin, kind))
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            for i, value, kind in ends[t]:
                if best[i] + value > best[t]:
                    best[t], back[t] = best[i] + value, (i, t, kind)
        out, t = [], n
        while t:
            if back[t]:
                out.append(back[t])
                t = back[t][0]
            else:
                t -= 1
        return out[::-1]


def model_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """What the model adds to the base spans."""

    if not model.weights:
        return []
    out, last, overlaps = [], 0, Overlaps(base)
    for start, end in stretches(text):
        closed = [(a, b) for _, a, b in overlaps.of(start, end)] + ([(start, last)] if last > start else [])
        if any(a <= start and end <= b for a, b in closed):
            continue
        cuts, cands = candidates(text, start, end, closed)
        for i, j, kind in model.decode(len(cuts) - 1, cands):
            out.append((kind, cuts[i], cuts[j]))
            last = max(last, cuts[j])
    return out


# -- fitting and applying --------------------------------------------------------

def training_stretches(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> DataFrame:
    """At most ``per_kind`` stretches (with their neighbours) for each kind, and without any: ``kind, snippet``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                kinds, snippets = [], []
                for text in texts:
                    overlaps = Overlaps(base_spans(text))
                    for start, end in stretches(text):
                        if end - start <= 160:
                            own = [kind for kind, _, _ in overlaps.of(start, end)]
                            kinds.append(own[0] if own else "none")
                            snippets.append(text[max(0, start - 1):end + 1])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(snippets, pa.string())],
                                                 names=["kind", "snippet"])

    texts = docs.select("text").filter(F.col("text").rlike("[0-9@]"))
    total = texts.count()
    # about forty texts for each stretch wanted, by hash, whatever the table's size
    share = F.pmod(F.xxhash64("text", F.lit("stretch sample")), F.lit(1_000_000)) / 1e6
    thin = texts.filter(share < 40.0 * per_kind * 5 / max(1, total))
    found = thin.mapInArrow(run, "kind string, snippet string").distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("snippet"), "snippet")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= per_kind).drop("r")


def fit(docs: DataFrame, per_kind: int = SAMPLE_PER_KIND) -> SemiCrf:
    examples = []
    rows = sorted(training_stretches(docs, per_kind).collect(), key=lambda r: hashlib.md5(r["snippet"].encode()).digest())
    for row in rows:
        text = row["snippet"]
        base = [(a, b, k) for k, a, b in base_spans(text)]
        for start, end in stretches(text):
            cuts, cands = candidates(text, start, end)
            place = {c: t for t, c in enumerate(cuts)}
            gold = {(place[a], place[b], k) for a, b, k in base if a in place and b in place}
            examples.append((len(cuts) - 1, cands, gold))
    return SemiCrf().train(examples) if any(gold for *_, gold in examples) else SemiCrf()


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for kind, a, b in spans])


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_spans(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans`` (base and added) and ``n_added`` of every row."""

    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                counts: dict[str, list] = {kind: [] for kind in KINDS}
                digests, spans, added = [], [], []
                for text in texts:
                    base = base_spans(text)
                    more = model_spans(text, base, model)
                    for kind in KINDS:
                        counts[kind].append(sum(s[0] == kind for s in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    spans.append(_joined(_in_order(base + more)))
                    added.append(len(more))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()),
                     pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
             "spans string, n_added long")


def masked(text: str, spans: list[Span]) -> str:
    """Every span as ``<KIND>``; overlapping spans become one, named by the first."""

    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_personal_data(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """All rows and columns of ``docs``; in ``text`` every span is masked, ``n_chars`` follows where it exists."""

    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch):
                at = part.schema.get_field_index("text")
                null = part.column(at).is_null().to_pylist()
                new = []
                for text, gone in zip(texts, null):
                    base = base_spans(text)
                    new.append(None if gone else masked(text, base + model_spans(text, base, model)))
                columns = part.columns
                columns[at] = pa.array(new, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = map_rows(docs, run)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
