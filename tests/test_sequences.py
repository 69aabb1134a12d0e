"""Scalar functions, filters and aggregates on hand-made reads."""

from pyspark.sql import functions as F

from seqloom.functions import seq
from seqloom.operators import collapse


def _reads(spark, rows):
    return spark.createDataFrame(rows, "sample int, name string, seq string, qual string")


def test_letters_and_complement(spark):
    row = spark.sql("select 'acguN' s").select(seq.letters(F.col("s")), seq.reverse_complement(F.col("s"))).first()
    assert tuple(row) == ("ACGTN", "NACGT")


def test_ambiguous_bases_are_resolved_alike(spark):
    reads = _reads(spark, [(0, "a", "ACGTNACGTN", "IIIIIIIIII"), (1, "a", "ACGTNACGTN", "IIIIIIIIII"), (1, "b", "ACGTNACGTN", "IIIIIIIIII")])
    got = [r["s"] for r in collapse.normalised(reads).collect()]
    assert got[0] == got[1] and all(set(s) <= set("ACGT") and s[:4] == "ACGT" for s in got)


def test_lengths_eight_and_nine(spark):
    reads = _reads(spark, [(0, "a", "ACGTACGT", "IIIIIIII"), (0, "b", "ACGTACGTA", "IIIIIIIII")])
    assert [r["name"] for r in collapse.long_enough(collapse.normalised(reads)).collect()] == ["b"]


def test_collapse_merges_counts_qualities_and_names(spark):
    reads = _reads(spark, [(0, "x", "ACGTACGTAC", "!I!!!!!!!!"), (1, "y", "ACGTACGTAC", "I!!!!!!!!!")])
    n = collapse.normalised(reads)
    row = collapse.collapsed(n, 2).first()
    assert (row["c0"], row["c1"], row["qual"]) == (1, 1, "II!!!!!!!!")
    assert sorted((r["sample"], r["names"]) for r in collapse.names(n).collect()) == [(0, ["x"]), (1, ["y"])]


def _brute_low(s, most):
    back, seen = s[::-1], {}
    for p in range(2, len(back)):
        t = back[p - 2 : p + 1]
        seen[t] = seen.get(t, 0) + 1
        if p >= 8 and seen[t] > most:
            return True
    return False


def test_low_complexity_is_the_exact_form(spark):
    import random

    r = random.Random(4)
    texts = ["A" * 9, "A" * 20, "ACGTACGTA", "AAAAAAAA"] + ["".join(r.choice("ACGT"[: r.randint(1, 4)]) for _ in range(r.randint(8, 26))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for most in (1, 3, 6):
        got = {r["s"]: r["low"] for r in df.select("s", collapse.is_low_complexity(F.col("s"), most).alias("low")).collect()}
        assert got == {t: len(t) >= 9 and _brute_low(t, most) for t in texts}


def test_dump_numbers_reversed_order(spark):
    df = spark.createDataFrame([("ACGTACGTA", 1, "I" * 9), ("CCGTACGTC", 2, "I" * 9), ("GGGTACGTA", 0, "I" * 9)], "s string, c0 long, qual string")
    got = collapse.dump(df, 1).orderBy("n").collect()
    want = sorted((r["s"] for r in df.collect()), key=lambda s: s[::-1])
    assert [r["n"] for r in got] == [1, 2, 3]
    assert [r["record"].split("\n")[1] for r in got] == want
