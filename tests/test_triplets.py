"""Triplets are counted within a sequence: no row is grouped by triplet."""

from collections import Counter

from seqloom.operators import collapse


def test_counts_without_a_group_a_triplet(spark):
    own = ["AAAAAAAAAAAA", "ACGTACGTACG", "ACACACACACA", "AC", "ACG", "GATTACAGATTACA", "GATTACAGATTACA", None]
    out = collapse.triplet_counts(spark.createDataFrame([(x,) for x in own], "s string"))
    want = Counter((s, s[::-1][k : k + 3]) for s in own if s for k in range(len(s) - 2))
    assert {(r["s"], r["triplet"]): r["n"] for r in out.collect()} == want
    grouped = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert grouped and not any("triplet" in x for x in grouped)
