"""Tries are counted in one sorted pass: as if built, over any number of tasks, and no prefix is a row."""

import random
from collections import Counter

import pytest

from seqloom.operators import collapse

QUERIES = ("branch_lengths", "prefix_stats", "read_nodes")


def _built(own):
    nodes = {t[::-1][:d] for t in own for d in range(len(t) + 1)}
    children = Counter(x[:-1] for x in nodes if x)
    runs = Counter()
    for x in nodes:
        if children[x] != 1:
            run = 0
            while run < len(x) and children[x[: len(x) - run - 1]] == 1:
                run += 1
            runs[run] += 1
    return {"branch_lengths": sorted(runs.items()), "prefix_stats": sorted((*k, n) for k, n in Counter((len(x), children[x]) for x in nodes).items()), "read_nodes": [(len(nodes) - 1, len(own))]}


@pytest.mark.parametrize("name", QUERIES)
def test_trie_over_many_tasks(spark, name):
    r = random.Random(5)
    own = {"".join(r.choice("ACGT"[: r.randint(1, 4)]) for _ in range(r.randint(1, 12))) for _ in range(400)} | {"A" * k for k in range(1, 30)}
    own |= {t[k:] for t in list(own)[:80] for k in (1, 3) if len(t) > k}  # reads that end inside others
    df = spark.createDataFrame([(t,) for t in [*own, *list(own)[:50], None]], "s string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, getattr(collapse, name)(df).collect())) == _built(own)[name]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", QUERIES)
def test_no_prefix_is_a_row(spark, name):
    r = random.Random(6)
    tails = ["".join(r.choice("ACGT") for _ in range(4000)) for _ in range(3)]
    own = {"".join(r.choice("ACGT") for _ in range(r.randint(1, 9))) + t[k:] for t in tails for k in (0, 7, 300)}
    out = getattr(collapse, name)(spark.createDataFrame([(t,) for t in own], "s string"))
    assert "Generate" not in out._jdf.queryExecution().toString()
    total = {"branch_lengths": 1, "prefix_stats": 2, "read_nodes": 0}[name]
    nodes = len({t[::-1][:d] for t in own for d in range(len(t) + 1)})
    got = sum(row[total] for row in out.collect())
    assert got == nodes - 1 if name == "read_nodes" else got == nodes if name == "prefix_stats" else got >= len(own)
