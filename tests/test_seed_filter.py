"""Places that a seed only meets by chance leave a mapping round inside its join, and none that holds is lost."""

import random

from seqloom.operators import mapping


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_round_two_filters_in_the_join(spark):
    r = random.Random(9)
    text = "".join(r.choice("AACGT") for _ in range(90))
    contigs = spark.createDataFrame([(1, text, len(text))], "rid long, s string, len long")
    reads = {"".join(r.choice("ACGT") for _ in range(3)) + text[k + 3 : k + 17] for k in range(0, 70, 6)} | {text[2:16] + "AC", "GG" + text[:12], text[-12:] + "TT"}
    sequences = spark.createDataFrame([(x,) for x in reads], "s string")
    tiled = mapping.tiles(mapping.strands(contigs), 30)
    out = mapping.round_of(sequences, sorted({len(x) for x in reads}), tiled, 2)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("levenshtein" in x for x in joins)
    both = {1: text, 0: text[::-1].translate(str.maketrans("ACGT", "TGCA"))}
    want = {(x, st, i + 1, n) for x in reads for st, g in both.items() for i in range(len(g)) for n in range(max(1, len(x) - 2), len(x) + 3) if i + n <= len(g) and distance(x, g[i : i + n]) == 2}
    assert {(p["s"], p["st"], p["start"], p["glen"]) for p in out.collect()} == want and want
