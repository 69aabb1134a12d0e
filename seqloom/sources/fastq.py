"""FASTQ as a Spark data source: byte-range partitions that find their own first record.

    spark.dataSource.register(FastqDataSource)
    spark.read.format("fastq").option("chunk", 1 << 20).load("/a.fastq,/b.fastq")

Rows are (sample, name, seq, qual, at); sample is the ordinal of the path and ``at`` the byte at which the record begins in
its sample, so (sample, at) is the order of arrival. A path may be a folder: its files, by name, are one sample. A record
belongs to the chunk in which its first byte lies. A chunk that begins inside a record looks for a line that starts with
``+`` two lines below one that starts with ``@``: that can only be a record's third line. A last record without a line end
is read whole, carriage returns are stripped, and a truncated record is an error. Blocks are split at once and leave as
Arrow batches. Paths are local or any URI that Arrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.session import ship_package

CHUNK, BLOCK = 64 << 20, 1 << 20
SCHEMA = "sample int, name string, seq string, qual string, at long"


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, inner


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the visible files of a folder by name."""
    from pyarrow import fs

    system, inner = _open(path)
    info = system.get_file_info(inner)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _first_record(stream, start: int, block: int) -> int | None:
    """Where the first record at or after byte ``start`` begins; None if none does."""
    if start == 0:
        return 0
    held, ended = b"", False
    stream.seek(start - 1)
    while True:
        more = stream.read(block)
        ended = not more
        held += more
        # the first line is the rest of one, or just the line end before a fresh one
        lines = held.split(b"\n", 9)
        whole = lines if ended else lines[:-1]
        at = start - 1 + len(whole[0]) + 1 if whole else 0
        heads, starts = [], []
        for line in whole[1:]:
            heads.append(line[:1])
            starts.append(at)
            at += len(line) + 1
            if len(heads) >= 3 and heads[-1] == b"+" and heads[-3] == b"@":
                return starts[-3]
        if ended or len(whole) >= 9:
            return None


def batches(path: str, start: int, stop: int, block: int = BLOCK) -> Iterator[tuple[list[bytes], list[bytes], list[bytes], list[int]]]:
    """(names, sequences, qualities, places) of the records that begin in bytes start .. stop-1, about a block at a time."""
    system, inner = _open(path)
    with system.open_input_file(inner) as stream:
        at = _first_record(stream, start, min(block, 1 << 16))
        if at is None or at >= stop:
            return
        stream.seek(at)
        held: list[bytes] = []  # blocks since the last whole record
        ended = False
        while at < stop and not ended:
            more = stream.read(block)
            ended = not more
            held.append(more)
            if not ended and b"\n" not in more:
                continue
            data = b"".join(held)
            lines = data.split(b"\n")
            if ended and not lines[-1]:
                lines.pop()  # what follows the last line end
            n = len(lines) // 4 if ended else (len(lines) - 1) // 4
            rest = lines[4 * n :]
            if ended and any(r.strip(b"\r") for r in rest):
                raise ValueError(f"{path}: a truncated record near byte {at}")
            places = [at]
            for k in range(0, 4 * n, 4):
                places.append(places[-1] + len(lines[k]) + len(lines[k + 1]) + len(lines[k + 2]) + len(lines[k + 3]) + 4)
            own = n if places[-1] <= stop else next(k for k, p in enumerate(places) if p >= stop)
            names, seqs, marks, quals = (lines[k : 4 * own : 4] for k in range(4))
            if b"\r" in data:
                names, seqs, quals = ([x.removesuffix(b"\r") for x in part] for part in (names, seqs, quals))
            if not (all(x[:1] == b"@" for x in names) and all(x[:1] == b"+" for x in marks) and list(map(len, seqs)) == list(map(len, quals))):
                raise ValueError(f"{path}: a malformed record between bytes {at} and {places[own]}")
            if own:
                yield [x[1:] for x in names], seqs, quals, places[:own]
            at = places[n] if own == n else stop
            held = [b"\n".join(rest)]


def records(path: str, start: int, stop: int, block: int = BLOCK) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of the records that begin in bytes start .. stop-1."""
    for names, seqs, quals, _ in batches(path, start, stop, block):
        yield from ((n.decode(), s.decode(), q.decode()) for n, s, q in zip(names, seqs, quals, strict=True))


class _Part(InputPartition):
    def __init__(self, sample: int, path: str, start: int, stop: int, before: int):
        self.sample, self.path, self.start, self.stop, self.before = sample, path, start, stop, before


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], chunk: int):
        self.paths, self.chunk = paths, chunk

    def partitions(self):
        out = []
        for k, path in enumerate(self.paths):
            before = 0
            for file, n in files_of(path):
                out += [_Part(k, file, at, min(at + self.chunk, n), before) for at in range(0, n, self.chunk)]
                before += n
        return out or [_Part(0, "", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        for names, seqs, quals, places in batches(partition.path, partition.start, partition.stop):
            sample = pa.array([partition.sample] * len(names), pa.int32())
            at = pa.array([partition.before + p for p in places], pa.int64())
            yield pa.RecordBatch.from_arrays([sample, text(names), text(seqs), text(quals), at], names=["sample", "name", "seq", "qual", "at"])


class FastqDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p.strip() for p in self.options["path"].split(",")], int(self.options.get("chunk", CHUNK)))


def scan(spark: SparkSession, paths: list[str], chunk: int = CHUNK, places: bool = False) -> DataFrame:
    """All records of the files, one sample a path, with ``at`` where ``places``. An unreadable path is an error at once."""
    for path in paths:
        files_of(path)
    ship_package(spark)
    spark.dataSource.register(FastqDataSource)
    found = spark.read.format("fastq").option("chunk", chunk).load(",".join(paths))
    return found if places else found.drop("at")


def genome(spark: SparkSession, path: str) -> DataFrame:
    """rid, name, s, len of a FASTA file, read by Spark's text source a contig a row.

    ``rid`` is a number in the order of the file, whatever the names; write the result before using it twice, since another
    split of the file would number anew. Only a ``>`` at the start of a line begins a contig.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    name = F.regexp_extract("value", r"^(\S*)", 1)
    s = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", ""))
    return rows.where("value <> ''").select(F.monotonically_increasing_id().alias("rid"), name.alias("name"), s.alias("s"), F.length(s).cast("long").alias("len"))
