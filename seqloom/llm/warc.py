"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records by joins.

An archive is two Parquet tables in the shared folder. ``payloads``: each distinct payload once, under its SHA-256.
``headers``: the exact header block of each record with the SHA-256 of its payload. Of records with equal payloads of at
least ``LEAST`` bytes the one with the largest page_id is the response and the others are revisits of it; smaller ones
are all responses. A null html is an empty payload and a null page_id is less than any other. Repeated rows get a record
each; of rows that share the largest page_id all are responses. An empty table gives an archive without records.

"Verified": copies under one SHA-256 must agree in length and SHA-1 too when they are merged (else the write fails), and
reading hashes the stored bytes again and compares both digests and the length with the header.

Copies are merged by a pre-aggregated group-by, so a payload that a third of all rows share leaves each task once; the
first join carries narrow header rows, the second rebuilds whole records (:func:`records`), from which :func:`index` and
:func:`export` work. :func:`parse` reads a plain WARC file back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shared import fresh_path

LEAST = 1000
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records are given this date: the pages carry none, and equal input then gives equal archives.
DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"
_PAGE_URN = "urn:page:"


def _described(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).select(
        "page_id",
        "url",
        "payload",
        F.octet_length("payload").cast("long").alias("n"),
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha256"),
    )


def _one_line(value: Column) -> Column:
    """Header values hold no line ends; those of a URL are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_PAGE_URN}"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _header(response: Column, keeper: Column) -> Column:
    revisit = F.concat(F.lit(f"{_CRLF}WARC-Profile: {REVISIT_PROFILE}{_CRLF}WARC-Refers-To: "), _id(keeper))
    return F.concat(
        F.lit(f"{VERSION}{_CRLF}WARC-Type: "),
        F.when(response, F.lit("response")).otherwise(F.lit("revisit")),
        F.lit(f"{_CRLF}WARC-Record-ID: "),
        _id(F.col("page_id")),
        F.lit(f"{_CRLF}WARC-Target-URI: "),
        _one_line(F.col("url")),
        F.lit(f"{_CRLF}WARC-Date: {DATE}{_CRLF}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.lit(f"{_CRLF}X-Payload-Length: "),
        F.col("n").cast("string"),
        F.when(response, F.lit("")).otherwise(revisit),
        F.lit(f"{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "),
        F.when(response, F.col("n").cast("string")).otherwise(F.lit("0")),
        F.lit(_CRLF + _CRLF),
    )


def write_archive(pages: DataFrame, path: str) -> str:
    """Write the archive of ``pages`` (page_id, url, html) under ``path`` and return that."""
    spark = pages.sparkSession
    described = _described(pages)
    merged = described.groupBy("sha256").agg(
        F.any_value("payload").alias("payload"),
        F.max("page_id").alias("keeper"),
        F.min("n").alias("n"),
        F.max("n").alias("most"),
        F.min("sha1").alias("sha1"),
        F.max("sha1").alias("last_sha1"),
    )
    agree = (F.col("n") == F.col("most")) & (F.col("sha1") == F.col("last_sha1"))
    checked = F.when(agree, F.col("payload")).otherwise(F.raise_error(F.lit("different payloads share a SHA-256")).cast("binary"))
    merged.select("sha256", "keeper", "n", "sha1", checked.alias("payload")).write.parquet(f"{path}/payloads")
    keepers = spark.read.parquet(f"{path}/payloads").select("sha256", "keeper")
    joined = described.drop("payload").join(keepers, "sha256")
    response = (F.col("n") < LEAST) | F.col("page_id").eqNullSafe(F.col("keeper"))
    joined.select("sha256", _header(response, F.col("keeper")).alias("header")).write.parquet(f"{path}/headers")
    return path


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)


def _number(value: Column) -> Column:
    """The page number of a record id; null for the id of a null page."""
    return F.regexp_extract(value, rf"^<{_PAGE_URN}(.*)>$", 1).try_cast("long")


def _verified(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and payload of what is stored, read again: bytes whose SHA-256 is not their key are an error."""
    failed = F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")
    return spark.read.parquet(f"{path}/payloads").select("sha256", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(failed).alias("payload"))


def records(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """header and block of each record; a revisit's block is empty unless ``full``, then it is the original payload."""
    joined = spark.read.parquet(f"{path}/headers").join(_verified(spark, path), "sha256")
    block = F.col("payload") if full else F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("header", block.alias("block"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """A row a record, from the rebuilt records: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Every record is put together from its header and the original payload. The header must be one block that begins with
    the version, its Content-Length must be that of the record's own block (none for a revisit), and its payload digest
    and length those of the bytes it was put together with; they are computed from these bytes.
    """
    rebuilt = records(spark, path, full=True)
    length, digest = F.octet_length("block").cast("long"), F.sha1("block")
    told = rebuilt.select("header", length.alias("payload_bytes"), digest.alias("payload_digest"))
    shaped = F.col("header").startswith(VERSION + _CRLF) & (F.instr("header", _CRLF + _CRLF) == F.length("header") - 3)
    own = F.when(_field("WARC-Type") == "revisit", F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    agrees = (
        shaped
        & (F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field("WARC-Payload-Digest"))
        & (F.col("payload_bytes").cast("string") == _field("X-Payload-Length"))
        & (own.cast("string") == _field("Content-Length"))
    )
    record_type = F.when(agrees, _field("WARC-Type")).otherwise(F.raise_error(F.lit("a header does not match its record")).cast("string"))
    return told.select(
        _number(_field("WARC-Record-ID")).alias("page_id"), "payload_bytes", "payload_digest", record_type.alias("record_type"), _number(_field("WARC-Refers-To")).alias("refers_to")
    )


def export(spark: SparkSession, path: str, target: str, records_a_file: int = 10_000) -> None:
    """Plain WARC files: headers, blocks and the two line ends after each, through Spark's own text writer."""
    text = records(spark, path).select(F.concat("header", F.decode("block", "UTF-8")).alias("value"))
    text.write.option("lineSep", _CRLF + _CRLF).option("maxRecordsPerFile", records_a_file).text(target)


def parse(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record of a plain WARC file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at) + 4
        header = data[at:stop].decode()
        if not header.startswith(VERSION + _CRLF):
            raise ValueError(f"no record at byte {at}")
        n = int(re.search(r"^Content-Length: (\d+)\r$", header, re.MULTILINE)[1])
        if data[stop + n : stop + n + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield header, data[stop : stop + n]
        at = stop + n + 4


def archived(pages: DataFrame) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder, rebuild its records and read the columns off them."""
    spark = pages.sparkSession
    return index(spark, write_archive(pages, fresh_path(spark, "warc")))
