"""Fixture reads: qualities looked up are those computed, and no letter is stepped through by a lambda."""

from pyspark.sql import functions as F

from seqloom.functions.seq import letters
from seqloom.sources import fixtures


def test_looked_up_qualities(spark):
    df = spark.range(-3000, 3000, 7).crossJoin(spark.createDataFrame([(n,) for n in (1, 8, 25, 32)], "n int"))
    stepped = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda p: F.char(33 + (F.col("id") + p * p) % 41)), "")
    assert df.where(~fixtures._quality(F.col("n"), F.col("id")).eqNullSafe(stepped)).count() == 0


def test_reads_without_lambdas(spark, sf_dir):
    assert "lambda" not in fixtures.reads(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_letters(spark):
    df = spark.createDataFrame([("acgu",), ("UuTtN",), ("ACGT",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(letters(F.col("x"))).collect()] == ["ACGT", "TTTTN", "ACGT", "", None]
