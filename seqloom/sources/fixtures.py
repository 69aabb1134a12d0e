"""Reads, a genome and planted reads, derived from the driver's text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.seq import reverse_complement

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CODES = "".join("ACGT"[i % 4] for i in range(26))
_COMPLEMENTS = "".join("TGCA"[i % 4] for i in range(26))


def encoded(text: Column, codes: str = _CODES) -> Column:
    """Letters as nucleotides (a=A, b=C, c=G, d=T, e=A, ...), all else removed."""
    return F.regexp_replace(F.translate(text, _LETTERS + _LETTERS.upper(), codes + codes), "[^ACGT]+", "")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer partitions than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Longest read of the fixtures, and a seed below which no code of such a read comes from a sum over 0.
_MOST = 32
_BELOW = -41 * (_MOST * _MOST // 41 + 1)


def _code(n: int) -> str:
    """The letter of code 33 + n % 41 as Spark counts: a remainder has the sign of n, and there is none (a mark) below 0."""
    c = 33 + (n % 41 if n >= 0 else -(-n % 41))
    return chr(c) if c >= 0 else "~"


def _quality(length: Column, seed: Column) -> Column:
    """Codes 33 + (seed + p * p) % 41 of p = 1 to ``length``, looked up by the seed's remainder."""
    table = "|".join("".join(_code(k + p * p) for p in range(1, _MOST + 1)) for k in range(_BELOW - 40, 41))
    k = F.when(seed >= 0, seed % 41).otherwise(F.greatest(seed, seed % 41 + _BELOW))
    cut = F.substring(F.get(F.split(F.lit(table), "[|]"), (k - (_BELOW - 40)).cast("int")), F.lit(1), length)
    return F.when(seed >= 0, cut).otherwise(F.replace(cut, F.lit("~"), F.lit("")))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, name, seq, qual: all windows of documents, some with an N, some too short."""
    length = F.when(F.col("doc_id") % 25 == 0, 8 + F.col("doc_id") % 3).otherwise(18 + F.col("doc_id") % 8).cast("int")
    # texts whose windows are reversed are complemented as they are encoded
    s = F.when(F.col("doc_id") % 2 == 1, encoded(F.col("text"), _COMPLEMENTS)).otherwise(encoded(F.col("text")))
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", s.alias("s"), length.alias("L"))
    # one pass over a text, and rows that carry their own window only
    cut = F.regexp_extract_all("s", F.concat(F.lit(".{"), F.col("L").cast("string"), F.lit("}")), F.lit(0))
    d = d.select("doc_id", "L", F.posexplode(cut).alias("i", "w"))
    d = d.withColumn("w", F.when(F.col("doc_id") % 2 == 1, F.reverse("w")).otherwise(F.col("w")))
    with_n = F.concat(F.substring("w", 1, 4), F.lit("N"), F.substring(F.col("w"), F.lit(6), F.length("w")))
    return d.select(
        (F.col("doc_id") % 3).cast("int").alias("sample"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("name"),
        F.when((F.col("doc_id") + F.col("i")) % 97 == 0, with_n).otherwise(F.col("w")).alias("seq"),
        _quality(F.col("L"), F.col("doc_id") * 7 + F.col("i") * 3).alias("qual"),
    )


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, s, len: the forward genome."""
    s = encoded(F.col("text"))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("rid"), s.alias("s"), F.length(s).cast("long").alias("len"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, name, seq, qual: genome windows with planted edits, half of them reverse-complemented."""
    g = contigs(spark, sf_dir).where("len >= 37").withColumn("L", (18 + F.col("rid") % 8).cast("int"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.expr("cast((len - 30) div 7 as int)"))))
    g = g.withColumn("w", F.substring(F.col("s"), F.col("i") * 7 + 1, F.col("L")))

    def swap(seq: Column, p: Column, table: str) -> Column:
        return F.concat(F.substring(seq, F.lit(1), p - 1), F.translate(F.substring(seq, p, F.lit(1)), "ACGT", table), F.substring(seq, p + 1, F.length(seq)))

    w, kind = F.col("w"), F.col("i") % 5
    edited = (
        F.when(kind == 0, w)
        .when(kind == 1, swap(w, F.col("L") - F.col("i") % F.col("L"), "CGTA"))
        .when(kind == 2, F.concat(F.substring(w, F.lit(1), F.lit(6)), F.substring(w, F.lit(8), F.length(w))))
        .when(kind == 3, F.concat(F.substring(w, F.lit(1), F.lit(9)), F.lit("A"), F.substring(w, F.lit(10), F.length(w))))
        .otherwise(swap(swap(w, F.lit(4), "GTAC"), F.lit(12), "TGCA"))
    )
    g = g.withColumn("seq", F.when((F.col("rid") + F.col("i")) % 2 == 1, reverse_complement(edited)).otherwise(edited))
    return g.select(
        (F.col("rid") % 3).cast("int").alias("sample"),
        F.concat(F.lit("p"), F.col("rid").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("name"),
        "seq",
        _quality(F.length("seq"), F.col("rid") * 7 + F.col("i") * 3).alias("qual"),
    )
