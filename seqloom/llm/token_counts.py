"""Token counts of whole documents; huge ones by overlapping chunks that are spliced at proven boundaries.

A document of more than ``HUGE`` code points is encoded by the library in chunks of ``CHUNK`` that overlap by
``OVERLAP``. Two neighbours are spliced at a position p of their overlap where

* a token starts at p in both encodings,
* the text has ASCII white space before p and an ASCII letter or digit at p, and
* both encodings agree on every token from p to the last white space before the first chunk's end.

Neither normalisation, pieces, merges nor special strings reach across such a p, so what lies before it is right in the
first chunk (whose end may cut a word) and what follows in the second (whose start may cut one, before p). Where no such
p exists the overlap is doubled; once it is the whole chunk, the first chunk grows instead, up to the whole document.

Shorter documents are encoded whole (:mod:`seqloom.llm.wordbpe`). Null texts count as empty: 0 bytes and
tokens. Repeated rows are counted alike; an empty table gives no rows. One task holds one batch of texts, never a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.wordbpe import WordBpe, marked

HUGE, CHUNK, OVERLAP = 8192, 4096, 256
_SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long"


class _Chunk:
    """A part of a text, encoded: ids and where each token starts and ends in the text."""

    def __init__(self, library, text: str, start: int, stop: int):
        self.start, self.stop = start, stop
        found = library.encode(text[start:stop], add_special_tokens=False)
        self.ids = np.array(found.ids, dtype=np.uint32)
        spans = np.array(found.offsets, dtype=np.int64).reshape(-1, 2) + start
        self.starts, self.ends = spans[:, 0], spans[:, 1]

    def between(self, a: int, b: int) -> np.ndarray:
        return self.ids[(self.starts >= a) & (self.ends <= b)]


def _last_space(text: str, a: int, b: int) -> int:
    return max(text.rfind(c, a, b) for c in _SPACE)


def boundary(text: str, first: _Chunk, second: _Chunk) -> int | None:
    """The first proven boundary in the overlap of two chunks."""
    last = _last_space(text, second.start, first.stop)
    for p in np.intersect1d(first.starts, second.starts).tolist():
        if second.start < p <= last and text[p - 1] in _SPACE and text[p].isascii() and text[p].isalnum():
            if np.array_equal(first.between(p, last), second.between(p, last)):
                return p
    return None


def spliced(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int]:
    """The ids of ``text`` through overlapping chunks, and how many chunks were spliced."""
    parts, used = [], 1
    first = _Chunk(library, text, 0, min(chunk, len(text)))
    since = 0
    while first.stop < len(text):
        width, at = overlap, None
        while at is None and first.stop - width > first.start:
            second = _Chunk(library, text, first.stop - width, min(first.stop - width + max(chunk, 2 * width), len(text)))
            at = boundary(text, first, second)
            width *= 2
        if at is None:
            first = _Chunk(library, text, first.start, min(first.stop + (first.stop - first.start), len(text)))
            continue
        parts.append(first.between(since, at))
        first, since, used = second, at, used + 1
    parts.append(first.between(since, len(text)))
    return np.concatenate(parts), used


def token_counts(docs: DataFrame, path: str, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``), n_chunks.

    ``path``: the tokenizer's file, at the same place on every machine. Other columns are not read.
    """

    def counted(batches):
        words = WordBpe.of(path)
        for batch in batches:
            tokens = [len(ids) // 4 for ids in words.encode_batch(batch)]
            chunks = [1] * len(tokens)
            for k, text in enumerate(batch.column("huge").to_pylist()):
                if text is not None:
                    ids, chunks[k] = spliced(words.library, text, chunk, overlap)
                    tokens[k] = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, type=pa.int64()), pa.array([n > limit for n in tokens], type=pa.bool_()), pa.array(chunks, type=pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    is_huge = F.length(text) > huge
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.when(is_huge, text).alias("huge"),
        F.when(is_huge, F.lit("")).otherwise(text).alias("text"),
    )
    prepared = sized.withColumn("marked", marked(F.col("text")))
    prepared = prepared.withColumn("text", F.when(F.col("marked").isNull(), F.col("text")))
    return prepared.mapInArrow(counted, SCHEMA)
