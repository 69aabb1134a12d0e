"""Mapping, hits, CIGARs and records against brute force and hand-made cases."""

import random
import re

from pyspark.sql import functions as F

from seqloom.operators import hits, mapping
from seqloom.plans import pipeline

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _brute(read, genome, most):
    best, out = most + 1, set()
    for rid, fwd in genome.items():
        for st, s in ((1, fwd), (0, fwd[::-1].translate(COMPLEMENT))):
            for glen in range(max(1, len(read) - most), len(read) + most + 1):
                for at in range(len(s) - glen + 1):
                    d = _distance(read, s[at : at + glen])
                    if d < best:
                        best, out = d, set()
                    if d == best <= most:
                        out.add((rid, st, at + 1, glen, d))
    return out


def _contigs(spark, genome):
    return spark.createDataFrame([(k, s, len(s)) for k, s in genome.items()], "rid long, s string, len long")


def test_all_places_at_the_least_distance(spark):
    r = random.Random(3)
    genome = {k: "".join(r.choice("ACGT") for _ in range(70)) for k in range(2)}
    reads = set()
    for _ in range(10):
        w = list(genome[r.randrange(2)][(p := r.randrange(45)) : p + 16])
        for _ in range(r.randrange(3)):
            w[r.randrange(16)] = r.choice("ACGT")
        if r.random() < 0.4:
            del w[r.randrange(16)]
        reads.add("".join(w))
    got = mapping.best_places(spark.createDataFrame([(x,) for x in reads], "s string"), _contigs(spark, genome), 2).collect()
    want = {(x, *p) for x in reads for p in _brute(x, genome, 2)}
    assert {(g["s"], g["rid"], g["st"], g["start"], g["glen"], g["n_errors"]) for g in got} == want


def test_clusters_are_anchored(spark):
    row = "s string, rid long, st int, pos long, glen int, g string, n_errors int, n_indels long"

    def left(rows):
        df = spark.createDataFrame([("r", 1, st, pos, 9, "g", 2, indels) for pos, st, indels in rows], row)
        return [(h["pos"], h["hi"], h["nh"]) for h in hits.deduplicated(df).orderBy("hi").collect()]

    assert left([(10, 1, 2), (100, 1, 1), (101, 1, 0)]) == [(10, 1, 2), (101, 2, 2)]
    assert left([(10, 1, 0), (12, 1, 0), (14, 1, 0)]) == [(10, 1, 2), (14, 2, 2)]
    assert left([(10, 1, 0), (11, 0, 0), (12, 1, 0)]) == [(10, 1, 3), (11, 2, 3), (12, 3, 3)]


def test_cigars():
    assert hits.run_lengths(hits.operations("ACGTT", "ACGTT")) == "5="
    assert hits.run_lengths(hits.operations("TCGTT", "ACGTT")) == "1X4="
    assert hits.run_lengths(hits.operations("CAAAG", "CAAAAG")) == "1=1D4="
    assert hits.run_lengths(hits.operations("CAAAAG", "CAAAG")) == "1=1I4="


def test_cigars_reproduce_reads():
    r = random.Random(9)
    for _ in range(200):
        g = "".join(r.choice("ACG") for _ in range(r.randint(6, 12)))
        read = list(g)
        for _ in range(r.randrange(3)):
            k = r.randrange(len(read))
            r.choice([lambda k=k: read.pop(k), lambda k=k: read.insert(k, "T"), lambda k=k: read.__setitem__(k, "T")])()
        read = "".join(read)
        steps = hits.operations(read, g)
        assert sum(c in "=XI" for c in steps) == len(read) and sum(c in "=XD" for c in steps) == len(g)
        assert sum(c != "=" for c in steps) == _distance(read, g)
        assert "".join(f"{n}{c}" for n, c in re.findall(r"(\d+)(.)", hits.run_lengths(steps))) == hits.run_lengths(steps)


def test_whole_run(spark):
    r = random.Random(5)
    genome = {0: "".join(r.choice("ACGT") for _ in range(80))}
    w = genome[0][20:38]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    first = next(b for b in "ACGT" if b not in (w[0], genome[0][19]))
    reads = [
        (0, "exact", w, "I" * 18),
        (1, "exact2", w, "J" * 18),
        (0, "back", w[::-1].translate(COMPLEMENT), "ABCDEFGHIJKLMNOPQR"),
        (0, "end5", first + w[1:], "I" * 18),
        (0, "end3", w[:-1] + other[w[-1]], "I" * 18),
        (0, "poly", "A" * 20, "I" * 20),
        (0, "none", "ACGGTCATTCGGAATCCGTA"[::-1], "I" * 20),
    ]
    df = spark.createDataFrame(reads, "sample int, name string, seq string, qual string")
    m = pipeline.mapped(df, _contigs(spark, genome), 2)
    lines = {x["qname"]: x for x in m.lines().collect()}
    assert {"exact", "exact2", "back", "end5", "end3"} <= set(lines) and "poly" not in lines
    assert (lines["exact"]["cigar"], lines["exact"]["pos"], lines["exact"]["mapq"], lines["exact"]["qual"]) == ("18=", 21, 40, "J" * 18)
    assert (lines["back"]["flag"], lines["back"]["seq"], lines["back"]["qual"]) == (16, w, "ABCDEFGHIJKLMNOPQR"[::-1])
    assert (lines["end5"]["cigar"], lines["end5"]["nh"], lines["end5"]["nm"], lines["end5"]["mapq"]) == ("1X17=", 1, 1, 39)
    assert lines["end3"]["cigar"] == "17=1X"
    assert sorted(x["qname"] for x in m.unified().where(F.col("cigar") == "18=").collect()) == ["back_1_0", "exact_1_1"]


def test_hit_limit(spark):
    genome = {0: "ACGTTGCAAGTCCTGAC", 1: "ACGTTGCAAGTCCTGAC", 2: "ACGTTGCAAGTCCTGAC"}
    df = spark.createDataFrame([(0, "a", "ACGTTGCAAGTCCTGAC", "I" * 17)], "sample int, name string, seq string, qual string")
    for most, want in ((3, [(0, 1, 3), (256, 2, 3), (256, 3, 3)]), (2, [(4, 0, 3)])):
        got = pipeline.mapped(df, _contigs(spark, genome), 1, most_hits=most).lines().collect()
        assert sorted((x["flag"], x["hi"], x["nh"]) for x in got) == want


def test_every_tile_edge_and_length(spark):
    """Reads of any length at every place: nothing is cut off where tiles end."""
    r = random.Random(17)
    genome = {0: "".join(r.choice("ACGT") for _ in range(3000)), 1: "".join(r.choice("ACGT") for _ in range(300))}
    reads = {}
    for length in (20, 150, 200, 263, 300, 1000):
        for start in {0, 1, 250, 255, 256, 257, 511, 512, 900, 1023, 1024, 1025, 2999 - length, 3000 - length}:
            for errors in (0, 1, 2):
                w = list(genome[0][start : start + length])
                for p in r.sample(range(3, length - 3), errors):
                    w[p] = {"A": "C", "C": "G", "G": "T", "T": "A"}[w[p]]
                w = "".join(w)
                if r.random() < 0.5:
                    reads[w[::-1].translate(COMPLEMENT)] = (0, 0, 3000 - start - length + 1, errors)
                else:
                    reads[w] = (0, 1, start + 1, errors)
    got = mapping.best_places(spark.createDataFrame([(x,) for x in reads], "s string"), _contigs(spark, genome), 2).collect()
    found = {}
    for g in got:
        found.setdefault(g["s"], set()).add((g["rid"], g["st"], g["start"], g["n_errors"]))
        assert _distance(g["s"], g["g"]) == g["n_errors"] if len(g["s"]) < 30 else len(g["g"]) == g["glen"]
    assert all(reads[x] in found.get(x, ()) for x in reads)


def test_three_errors(spark):
    r = random.Random(23)
    genome = {k: "".join(r.choice("ACGT") for _ in range(60)) for k in range(2)}
    reads = set()
    for _ in range(4):
        w = list(genome[r.randrange(2)][(p := r.randrange(35)) : p + 20])
        for _ in range(3):
            r.choice([lambda w=w: w.pop(r.randrange(len(w))), lambda w=w: w.__setitem__(r.randrange(len(w)), r.choice("ACGT"))])()
        reads.add("".join(w))
    contigs = _contigs(spark, genome)
    places = mapping.best_places(spark.createDataFrame([(x,) for x in reads], "s string"), contigs, 3)
    assert {(g["s"], g["rid"], g["st"], g["start"], g["glen"], g["n_errors"]) for g in places.collect()} == {(x, *p) for x in reads for p in _brute(x, genome, 3)}
    found, _ = hits.reported(places, contigs, 50, 3)
    for h in hits.with_cigar(found).collect():
        counts = {c: sum(int(n) for n, x in re.findall(r"(\d+)(.)", h["cigar"]) if x == c) for c in "=XID"}
        assert counts["X"] + counts["I"] + counts["D"] == h["n_errors"] and counts["I"] + counts["D"] == h["n_indels"]
        assert counts["="] + counts["X"] + counts["I"] == len(h["s"])


def test_cigar_expressions_equal_the_alignment(spark):
    r = random.Random(29)
    rows = []
    for k in range(400):
        g = "".join(r.choice("ACG" if k % 2 else "AC") for _ in range(r.randint(9, 16)))
        read = list(g)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(read))
            r.choice([lambda at=at: read.pop(at), lambda at=at: read.insert(at, "A"), lambda at=at: read.__setitem__(at, "T")])()
        read = "".join(read)
        steps = hits.operations(read, g)
        errors = sum(c != "=" for c in steps)
        rows.append((read, g, k % 2, errors, sum(c in "ID" for c in steps), hits.run_lengths(steps if k % 2 else steps[::-1])))
    df = spark.createDataFrame(rows, "s string, g string, st int, n_errors int, n_indels long, want string").withColumn("glen", F.length("g"))
    assert hits.with_cigar(df).where("cigar <> want").count() == 0
    assert mapping.with_indels(df.withColumnRenamed("n_indels", "told")).where("n_indels <> told").count() == 0
