"""Places to reported hits: hit limit, forward positions, near-duplicate clusters, ordinals, flags and CIGARs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.align import operations, run_lengths
from seqloom.functions.seq import flag, mapq
from seqloom.operators.mapping import intervals, with_indels
from seqloom.session import ship_package


def positioned(places: DataFrame, contigs: DataFrame) -> DataFrame:
    """``places`` with pos: the leftmost base on the forward strand, 1-based."""
    sized = places.join(contigs.select("rid", "len"), "rid")
    return sized.withColumn("pos", F.when(F.col("st") == 1, F.col("start")).otherwise(F.col("len") - F.col("start") - F.col("glen") + 2)).drop("len")


def within_limit(hits: DataFrame, most_hits: int) -> DataFrame:
    return hits.where(F.col("n_hits_raw") <= most_hits)


def over_limit(hits: DataFrame, most_hits: int) -> DataFrame:
    """One row for each sequence with more raw hits than allowed: it keeps no place."""
    return hits.where(F.col("n_hits_raw") > most_hits).groupBy("s").agg(F.max("n_hits_raw").alias("nh"), F.max("n_errors").alias("nm"))


def _clusters(rows: Column) -> Column:
    """Fold sorted hits into clusters anchored at their first hit, keeping the hit with fewest indels of each."""
    state = F.struct(F.filter(rows, lambda x: F.lit(False)).alias("done"), rows[0].alias("anchor"), rows[0].alias("best"))

    def step(a: Column, x: Column) -> Column:
        near = (x["rid"] == a["anchor"]["rid"]) & (x["st"] == a["anchor"]["st"]) & (x["pos"] - a["anchor"]["pos"] <= x["n_errors"])
        better = F.when(x["n_indels"] < a["best"]["n_indels"], x).otherwise(a["best"])
        return F.struct(
            F.when(near, a["done"]).otherwise(F.concat(a["done"], F.array(a["best"]))).alias("done"),
            F.when(near, a["anchor"]).otherwise(x).alias("anchor"),
            F.when(near, better).otherwise(x).alias("best"),
        )

    return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), state, step, lambda a: F.concat(a["done"], F.array(a["best"])))


def deduplicated(hits: DataFrame) -> DataFrame:
    """s, rid, st, pos, glen, g, n_errors, n_indels, hi, nh: clusters of near-duplicate hits reduced to one.

    Hits are bounded by the hit limit, so a sequence's hits are folded as one small array.
    """
    row = F.struct("rid", "pos", "st", "n_indels", "glen", "g", "n_errors")
    folded = hits.groupBy("s").agg(_clusters(F.array_sort(F.collect_list(row))).alias("hits"))
    each = folded.select("s", F.size("hits").cast("long").alias("nh"), F.posexplode("hits").alias("k", "h"))
    return each.select("s", *(F.col(f"h.{c}").alias(c) for c in ("rid", "st", "pos", "glen", "g", "n_errors", "n_indels")), (F.col("k") + 1).cast("long").alias("hi"), "nh")


def flagged(hits: DataFrame) -> DataFrame:
    """Deduplicated hits with flag and mapq."""
    return hits.withColumn("flag", flag(F.col("st"), F.col("hi"))).withColumn("mapq", mapq(F.col("nh"), F.col("n_errors")))


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two sequences."""
    return F.length(F.regexp_extract(F.concat(a, F.lit("|"), b), r"^([^|]*)[^|]*\|\1", 1))


def _run(n: Column, what: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(what))).otherwise("")


def _one_edit() -> Column:
    """CIGAR, from the read's 5' end, of a hit with one error: the edit as early as the common suffix allows, and its mirror
    for the reverse strand."""
    s, g, n = F.col("s"), F.col("g"), F.length("s")
    same = F.length("g") == n
    prefix, suffix = _common_prefix(s, g), _common_prefix(F.reverse(s), F.reverse(g))
    before = F.when(same, prefix).when(n > F.length("g"), n - 1 - F.least(suffix, n - 1)).otherwise(n - F.least(suffix, n))
    kept = F.when(n < F.length("g"), n).otherwise(n - 1)
    op = F.when(same, F.lit("1X")).when(n > F.length("g"), F.lit("1I")).otherwise(F.lit("1D"))
    first, last = _run(before, "="), _run(kept - before, "=")
    return F.when(F.col("st") == 1, F.concat(first, op, last)).otherwise(F.concat(last, op, first))


def _two_mismatches() -> Column:
    """CIGAR of a hit with two mismatches and no indel."""
    a, b = _common_prefix(F.col("s"), F.col("g")), _common_prefix(F.reverse("s"), F.reverse("g"))
    first, last = F.when(F.col("st") == 1, a).otherwise(b), F.when(F.col("st") == 1, b).otherwise(a)
    between = F.length("s") - a - b - 2
    inner = F.when(between > 0, F.concat(F.lit("1X"), between.cast("string"), F.lit("=1X"))).otherwise("2X")
    return F.concat(_run(first, "="), inner, _run(last, "="))


@F.pandas_udf(T.StringType())
def _edited(read: pd.Series, g: pd.Series, strand: pd.Series) -> pd.Series:
    steps = [operations(r, x) for r, x in zip(read, g, strict=True)]
    return pd.Series([run_lengths(x if st == 1 else x[::-1]) for x, st in zip(steps, strand, strict=True)])


def with_cigar(hits: DataFrame) -> DataFrame:
    """``hits`` (with n_indels) and cigar, along the forward strand.

    Exact hits, hits with one error and those with two mismatches are expressions; only two errors with an indel, and more
    than two, go to Python.
    """
    ship_package(hits.sparkSession)
    told = F.when(F.col("n_errors") == 0, F.concat(F.length("s").cast("string"), F.lit("="))).when(F.col("n_errors") == 1, _one_edit()).otherwise(_two_mismatches())
    plain = (F.col("n_errors") <= 1) | ((F.col("n_errors") == 2) & (F.col("n_indels") == 0))
    return hits.where(plain).withColumn("cigar", told).unionByName(hits.where(~plain).withColumn("cigar", _edited("s", "g", "st")))


def reported(places: DataFrame, contigs: DataFrame, most_hits: int = 5, most_errors: int = 2) -> tuple[DataFrame, DataFrame]:
    """(flagged hits within the limit, sequences over it)."""
    hits = positioned(intervals(with_indels(places, most_errors)), contigs)
    return flagged(deduplicated(within_limit(hits, most_hits))), over_limit(hits, most_hits)
