"""SAM records: header, one line for each read name and hit, or one for each hit with counts of all samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.seq import mapq, reverse_complement
from seqloom.operators.collapse import arrival

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nh", "hi", "ih", "nm")


def named(contigs: DataFrame) -> DataFrame:
    """rid, rname, len: contigs without names are called by their numbers."""
    name = F.col("name") if "name" in contigs.columns else F.col("rid").cast("string")
    return contigs.select("rid", name.alias("rname"), "len")


def header(contigs: DataFrame) -> DataFrame:
    """n, line: the version line, then a line for each contig."""
    first = contigs.sparkSession.createDataFrame([(0, "@HD\tVN:1.6\tSO:unsorted")], "n long, line string")
    line = F.concat(F.lit("@SQ\tSN:"), F.col("rname"), F.lit("\tLN:"), F.col("len").cast("string"))
    return first.unionAll(named(contigs).select((F.col("rid") + 1).alias("n"), line.alias("line")))


def _body(hits: DataFrame, limited: DataFrame, qualities: DataFrame, contigs: DataFrame) -> DataFrame:
    """The fields after qname and s, the sequence they are of."""
    placed = hits.join(qualities, "s").join(named(contigs).select("rid", "rname"), "rid")
    back = F.col("st") == 0
    on = placed.select(
        "s", "flag", "rname", "pos", "mapq", "cigar",
        F.when(back, reverse_complement(F.col("s"))).otherwise(F.col("s")).alias("seq"),
        F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), "nh", "hi", F.col("n_errors").cast("long").alias("nm"),
    )
    zero = F.lit(0).cast("long")
    off = limited.join(qualities, "s").select(
        "s", F.lit(4).cast("long").alias("flag"), F.lit("*").alias("rname"), zero.alias("pos"), mapq(F.col("nh"), F.col("nm")).alias("mapq"),
        F.lit("*").alias("cigar"), F.col("s").alias("seq"), "qual", "nh", zero.alias("hi"), F.col("nm").cast("long").alias("nm"),
    )
    return on.unionByName(off)


def _fields(df: DataFrame, *more: str) -> DataFrame:
    full = df.withColumns({"rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long"), "ih": F.col("nh")})
    return full.select(*more, *FIELDS)


def lines(reads: DataFrame, hits: DataFrame, limited: DataFrame, qualities: DataFrame, contigs: DataFrame) -> DataFrame:
    """sample and the fields: a row for each read and hit of its sequence. Reads are joined, never gathered by sequence."""
    return _fields(reads.select("sample", F.col("name").alias("qname"), "s").join(_body(hits, limited, qualities, contigs), "s"), "sample")


def unified(reads: DataFrame, counts: DataFrame, hits: DataFrame, limited: DataFrame, qualities: DataFrame, contigs: DataFrame) -> DataFrame:
    """The fields: a row for each hit; qname is the first read's name (by sample and place, or name) and all samples' counts."""
    samples = [c for c in counts.columns if c != "s"]
    first = reads.groupBy("s").agg(F.min(F.struct("sample", *arrival(reads))).alias("first"))
    named_ = first.join(counts, "s").select("s", F.concat_ws("_", F.col("first.name"), *(F.col(c).cast("string") for c in samples)).alias("qname"))
    return _fields(named_.join(_body(hits, limited, qualities, contigs), "s"))


def text(fields: DataFrame) -> Column:
    tags = [F.concat(F.lit(f"{t}:i:"), F.col(t.lower()).cast("string")) for t in ("NH", "HI", "IH", "NM")]
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in FIELDS[:11]), *tags)


def write(fields: DataFrame, contigs: DataFrame, path: str) -> None:
    """A folder of SAM text whose parts, put together by name, are one SAM file: the header is its first part."""
    top = header(contigs).coalesce(1).sortWithinPartitions("n").select(F.col("line").alias("value"))
    top.unionAll(fields.select(text(fields).alias("value"))).write.text(path)
