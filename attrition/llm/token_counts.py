"""Token counts by overlap resynchronisation (operator 1).

A text longer than ``chunk_chars`` is not encoded in one go: overlapping chunks
are encoded with offsets and spliced where the two encodings provably agree with
the encoding of the whole text.

*Stable boundary.*  The model merges neighbouring symbols, starting from single
characters, into pieces of its vocabulary.  If no piece holds characters ``a b``
side by side, no merge can ever span a place between an ``a`` and a ``b``, so
the encoding of the whole text has a boundary there, whatever surrounds it, and
what stands left and right of it is encoded independently.  ``stable_pairs`` of
the vocabulary gives those places (spaces are pieces' first characters only, so
every word start is one; so is any character outside the vocabulary).

*Splice.*  Two neighbouring chunks are joined at a stable place inside their
overlap at which both encodings have a token boundary.  Where the overlap holds
none, it is widened (doubled); in the limit the chunks become one.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings
inside texts are ordinary text (the library's default); repeated rows each give
a row; an empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import text_blocks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


@lru_cache(maxsize=2)
def _model(path: str | None):
    """(processor, adjacent character pairs that some piece holds) of a worker."""

    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    joined = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i)
            joined.update(zip(piece, piece[1:]))
    return sp, frozenset(joined)


def is_stable(text: str, p: int, joined: frozenset) -> bool:
    """Whether no piece can span the place before character ``p``."""

    a, b = text[p - 1], text[p]
    return (SPACE if a == " " else a, SPACE if b == " " else b) not in joined


def _boundaries(sp, text: str, start: int, end: int) -> list[int]:
    """Token start offsets (in the whole text) of ``text[start:end]``, encoded alone.

    The library puts a space before each text it is given; the token of that
    space starts at ``start`` as does the first of the text, hence the list may
    repeat an offset.  Pieces of a character's bytes share its offset too.
    """

    return [start + begin for begin, _ in sp.encode_as_offset_mapping(text[start:end])["offsets"]]


def count_long(text: str, sp, joined: frozenset, chunk: int, overlap: int) -> tuple[int, int]:
    """(tokens of the whole text, number of times an overlap was widened)."""

    total, widened = 0, 0
    start, splice = 0, 0  # the chunk's first character; tokens before ``splice`` are counted
    while True:
        end = min(len(text), start + chunk + overlap)
        own = _boundaries(sp, text, start, end)
        if end == len(text):
            return total + sum(1 for o in own if o >= splice), widened
        width = overlap
        while True:
            back = max(splice, end - width)  # the next chunk starts here
            nxt = _boundaries(sp, text, back, end)
            mine, theirs = set(own), set(nxt)
            at = next((p for p in range(end - 1, back, -1)
                       if p in mine and p in theirs and is_stable(text, p, joined)), None)
            if at is not None and at > splice:
                total += sum(1 for o in own if splice <= o < at)
                start, splice = back, at
                break
            widened += 1
            if end == len(text):
                return total + sum(1 for o in own if o >= splice), widened
            if back == splice:  # no place at all in what is left of this chunk: take more text
                end = min(len(text), 2 * end - start)
                own = _boundaries(sp, text, start, end)
            width *= 2


def count_tokens(docs: DataFrame, model_path: str | None = None, chunk_chars: int = 32_768,
                 overlap_chars: int = 512, limit: int = 4_096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_widened`` of every row of ``docs``.

    ``model_path``: the sentencepiece model, by default the public one installed
    beside the library.  Row-local: no shuffle, and memory in a task is bounded
    by its largest text and chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, joined = _model(model_path)
        for batch in batches:
            for part, texts in text_blocks(batch):
                counts, widened = [0] * len(texts), [0] * len(texts)
                short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars + overlap_chars]
                for i, ids in zip(short, sp.encode([texts[i] for i in short], num_threads=1)):
                    counts[i] = len(ids)
                done = set(short)
                for i, t in enumerate(texts):
                    if i not in done:
                        counts[i], widened[i] = count_long(t, sp, joined, chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(widened, pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "n_widened"])

    source = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_widened long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
