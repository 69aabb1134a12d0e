"""Packing tokens into sequences by cutting stock.

A document's tokens (its ids and the end id) are cut into full pieces and a rest. The histogram of piece lengths, in
units of ``QUANTUM`` tokens rounded up, goes to :mod:`seqloom.llm.cutting_stock` on the driver; its size is bounded by
the sequence length, not by the corpus. The plan comes back as slots: for each unit length, ranges of ranks that take a
place in copies of a pattern. Pieces get their rank within their length and look their sequence up.

Ranks need no window over a whole length, which copies of one document may fill: pieces of a length are dealt by hash
into buckets of about ``BUCKET`` (at most ``BUCKETS`` of them), ranked in each by doc_id, and offset by the buckets before.
Texts are tokenised once; what follows moves about fifty bytes a piece. Null texts are empty: their only token is the end
id. Repeated rows are packed each. A sequence shorter than the full length is padded by whoever reads it; :func:`padding`
counts that, with sequences of a power of two tokens left as they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.cutting_stock import plan
from seqloom.llm.shared import materialise
from seqloom.llm.wordbpe import WordBpe, for_words

LENGTH, END_ID, QUANTUM = 2048, 1, 8
BUCKET, BUCKETS = 512, 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, none longer than ``length``, with the CRC-32 of their ids."""
    last = np.uint32(end_id).tobytes()

    def pieces(batches):
        words = WordBpe.of(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode_batch(batch), strict=True):
                ids += last
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return for_words(docs).mapInArrow(pieces, PIECES)


def _slots(plan_: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank beyond, copies in a sequence, first sequence) for each pattern and size."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in plan_:
        for size, copies in pattern.items():
            first = taken.get(size, 0)
            taken[size] = first + copies * n
            out.append((size, first, taken[size], copies, sequence))
        sequence += n
    return out


def assign(pieces: DataFrame, length: int = LENGTH, quantum: int = QUANTUM) -> DataFrame:
    """``pieces`` (materialised) with sequence_id and offset."""
    spark = pieces.sparkSession
    if length % quantum:
        raise ValueError("the length must be a multiple of the quantum")
    size = F.ceil(F.col("length") / F.lit(quantum)).cast("int")
    pieces = pieces.withColumn("size", size)
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(histogram, length // quantum))
    # both tables are bounded by the length alone: a size each, and the patterns of a basis and of its remainders
    buckets = spark.createDataFrame([(s, max(1, min(BUCKETS, -(-n // BUCKET)))) for s, n in histogram.items()], "size int, buckets int")
    slots = spark.createDataFrame(slots, "size int, first long, beyond long, copies int, base long")

    dealt = pieces.join(F.broadcast(buckets), "size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.col("buckets"))).drop("buckets")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(counts, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    placed = ranked.join(F.broadcast(slots), (ranked["size"] == slots["size"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("beyond")))
    placed = placed.withColumn("sequence_id", F.col("base") + F.expr("(rank - first) div copies"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32", "doc_tokens")
    total = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (total - F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No documents give no rows."""
    return assign(materialise(cut(docs, path, length, end_id), "pieces"), length, quantum)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: sequences, tokens, padding."""
    tokens = F.col("tokens")
    sequences = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    padded = F.when(tokens.bitwiseAND(tokens - 1) == 0, F.lit(0)).otherwise(F.lit(length) - tokens)
    return sequences.agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(padded).alias("padding"))
