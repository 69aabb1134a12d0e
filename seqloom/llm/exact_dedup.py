"""Exact deduplication by a Grace hash: partition, spill and recurse until a bucket fits an open-addressing table.

Texts are equal when identical after every run of white space ``[\\x20\\x09-\\x0D]+`` is replaced by one space; null
counts as empty. Of equal texts the row with the smallest order column stays (null last, then the smaller text, then
the smaller ``repr`` of the row), so a tie between repeated rows has one winner.

Plan. Each map task folds its own rows first (:func:`_combine`), so a text that a third of all rows share leaves a task
once. The folded rows are dealt by the leading 64 bits of SHA-256 of the normalised text, the first level of the Grace
partitioning; a task that gets more than ``table_bytes`` writes its records to 16 spill files by the next hash bits and
recurses into each. Spill files are private to a task attempt and deleted with it: a lost executor only repeats tasks.
A table compares complete texts; two different texts with one SHA-256 raise instead of being merged.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from seqloom.llm.shared import byte_texts, free_names

_SPACE_BYTES = frozenset(b" \t\n\x0b\x0c\r")
#: Bytes of texts that one table holds before it spills.
TABLE_BYTES = 64 << 20
_FAN_BITS = 4
_LEVELS = 64 // _FAN_BITS


def normalised(text: bytes) -> bytes:
    """``text`` with every run of white space replaced by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    lead = b" " if text[0] in _SPACE_BYTES else b""
    tail = b" " if text[-1] in _SPACE_BYTES else b""
    return lead + b" ".join(words) + tail


def digest(text: bytes) -> bytes:
    return hashlib.sha256(normalised(text)).digest()


class Record:
    """A distinct text so far: its winner's row, and how many rows it stands for."""

    __slots__ = ("count", "order", "row", "sha", "text")

    def __init__(self, sha: bytes, text: bytes, order, row: tuple, count: int):
        self.sha, self.text, self.order, self.row, self.count = sha, text, order, row, count

    def __reduce__(self):
        return Record, (self.sha, self.text, self.order, self.row, self.count)

    @property
    def hash(self) -> int:
        return int.from_bytes(self.sha[:8], "big")

    def beats(self, other: Record) -> bool:
        mine, theirs = (self.order is None, self.order), (other.order is None, other.order)
        if mine != theirs:
            return mine[0] < theirs[0] if mine[0] != theirs[0] else self.order < other.order
        return (self.text, repr(self.row)) < (other.text, repr(other.row))


class OpenTable:
    """Open addressing with linear probing, at most half full; equality is that of the complete normalised texts."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.records: list[Record] = []
        self.keys: list[bytes] = []
        self.bytes = 0

    def _slot(self, record: Record, key: bytes) -> int:
        mask = len(self.slots) - 1
        at = record.hash & mask
        while (i := self.slots[at]) >= 0:
            if self.records[i].sha == record.sha:
                if self.keys[i] != key:
                    raise ValueError("two different texts have one SHA-256; refusing to merge them")
                return at
            at = (at + 1) & mask
        return at

    def add(self, record: Record) -> None:
        key = normalised(record.text)
        at = self._slot(record, key)
        if (i := self.slots[at]) >= 0:
            held = self.records[i]
            total = held.count + record.count
            if record.beats(held):
                self.bytes += len(record.text) - len(held.text)
                self.records[i] = held = record
            held.count = total
            return
        self.slots[at] = len(self.records)
        self.records.append(record)
        self.keys.append(key)
        self.bytes += len(record.text) + len(key)
        if 2 * len(self.records) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, (held, held_key) in enumerate(zip(self.records, self.keys, strict=True)):
                self.slots[self._slot(held, held_key)] = i


class _Spill:
    """Sixteen files of records, by the hash bits of one level."""

    def __init__(self, folder: str, level: int):
        self.shift = 64 - _FAN_BITS * (level + 1)
        self.paths = [os.path.join(folder, f"{level}-{k}-{id(self)}") for k in range(1 << _FAN_BITS)]
        self.files = [open(p, "wb") for p in self.paths]  # noqa: SIM115

    def write(self, record: Record) -> None:
        pickle.dump(record, self.files[(record.hash >> self.shift) & ((1 << _FAN_BITS) - 1)], pickle.HIGHEST_PROTOCOL)

    def buckets(self) -> Iterator[Iterator[Record]]:
        for f in self.files:
            f.close()
        for path in self.paths:
            with open(path, "rb") as f:
                yield self._read(f)
            os.unlink(path)

    @staticmethod
    def _read(f) -> Iterator[Record]:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records: Iterable[Record], table_bytes: int, folder: str, level: int = 0) -> Iterator[Record]:
    """One record for each distinct text of ``records``, in bounded memory.

    A table spills once its texts exceed ``table_bytes`` and it holds more than one. At the last level all hash bits
    are equal, which only one text can reach (two would share 64 bits of SHA-256), so that level never spills.
    """
    table, spill = OpenTable(), None
    for record in records:
        if spill is not None:
            spill.write(record)
            continue
        table.add(record)
        if table.bytes > table_bytes and len(table.records) > 1 and level < _LEVELS:
            spill = _Spill(folder, level)
            for held in table.records:
                spill.write(held)
            table.clear()
    if spill is None:
        yield from table.records
        return
    for bucket in spill.buckets():
        yield from grace(bucket, table_bytes, folder, level + 1)


def _rows(batch: pa.RecordBatch, text: str, order: str, own: tuple[str, str], counted: bool) -> Iterator[Record]:
    names = batch.schema.names
    texts = byte_texts(batch.column(text))
    others = [n for n in names if n not in (text, *own)]
    rows = zip(*(batch.column(n).to_pylist() for n in others), strict=True)
    orders = batch.column(order).to_pylist()
    shas = batch.column(own[0]).to_pylist() if counted else map(digest, texts)
    counts = batch.column(own[1]).to_pylist() if counted else [1] * len(texts)
    nulls = batch.column(text).is_null().to_pylist()
    for sha, value, key, row, count, null in zip(shas, texts, orders, rows, counts, nulls, strict=True):
        yield Record(sha, value, key, (*row, null), count)


def _batches(records: Iterator[Record], schema: pa.Schema, text: str, own: tuple[str, str], batch_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    others = [n for n in schema.names if n not in (text, *own)]

    def made(part: list[Record]) -> pa.RecordBatch:
        columns = {}
        for k, name in enumerate(others):
            columns[name] = pa.array([r.row[k] for r in part], type=schema.field(name).type)
        if text in schema.names:
            columns[text] = pa.array([None if r.row[-1] else r.text for r in part], type=pa.binary()).cast(schema.field(text).type)
        columns[own[0]] = pa.array([r.sha for r in part], type=pa.binary())
        columns[own[1]] = pa.array([r.count for r in part], type=pa.int64())
        return pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema=schema)

    part, size = [], 0
    for record in records:
        part.append(record)
        size += len(record.text) + 100
        if size > batch_bytes:
            yield made(part)
            part, size = [], 0
    if part:
        yield made(part)


def winners(df: DataFrame, text: str, order: str, own: tuple[str, str], table_bytes: int = TABLE_BYTES, with_text: bool = True) -> DataFrame:
    """One row of ``df`` for each distinct text: all its columns, then digest (binary) and count under the names ``own``.

    ``with_text=False`` leaves the text column out of the result (it still travels to the tables).
    """
    full = T.StructType([*df.schema.fields, T.StructField(own[0], T.BinaryType()), T.StructField(own[1], T.LongType())])
    final = T.StructType([f for f in full.fields if with_text or f.name != text])
    full_arrow, final_arrow = to_arrow_schema(full), to_arrow_schema(final)

    def _combine(batches):
        table = OpenTable()
        for batch in batches:
            for record in _rows(batch, text, order, own, counted=False):
                table.add(record)
                if table.bytes > table_bytes:
                    yield from _batches(iter(table.records), full_arrow, text, own)
                    table.clear()
        yield from _batches(iter(table.records), full_arrow, text, own)

    def _reduce(batches):
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            records = (r for batch in batches for r in _rows(batch, text, order, own, counted=True))
            yield from _batches(grace(records, table_bytes, folder), final_arrow, text, own)

    dealt = df.mapInArrow(_combine, full).repartition(F.col(own[0]))
    return dealt.mapInArrow(_reduce, final)


_MEMBER = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sha", T.BinaryType())])


def _members(batches):
    for batch in batches:
        shas = [digest(t) for t in byte_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shas, type=pa.binary())], names=["doc_id", "sha"])


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat the staying doc_id with an equal text are the same document and are all marked kept; the stage
    :func:`deduplicated` returns exactly one row. A null doc_id sorts last. An empty table gives no rows. Other columns
    are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = winners(narrow, "text", "doc_id", ("sha", "group_size"), table_bytes, with_text=False).withColumnRenamed("doc_id", "keep_id")
    members = narrow.mapInArrow(_members, _MEMBER)
    return members.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with one row of each group of equal texts, its columns (whatever their names) unchanged."""
    own = free_names(docs.columns, "sha", "count")
    return winners(docs, "text", "doc_id", own, table_bytes).drop(*own)
