"""Whole inputs: nothing of a text, a sequence or a source is left out."""

import random
import re
from collections import Counter

import duckdb
import pytest

from seqloom.operators import collapse
from seqloom.plans import queries, sql
from seqloom.sources import fixtures

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _brute_reads(docs):
    for d, text in docs:
        s = "".join("ACGT"[(ord(c) - ord("a")) % 4] for c in re.sub("[^a-z]", "", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
        length = 8 + d % 3 if d % 25 == 0 else 18 + d % 8
        for i in range(len(s) // length):
            w = s[i * length : (i + 1) * length]
            w = w[::-1].translate(COMPLEMENT) if d % 2 else w
            qual = "".join(chr(33 + (d * 7 + i * 3 + p * p) % 41) for p in range(1, length + 1))
            yield d % 3, f"d{d}_{i}", w[:4] + "N" + w[5:] if (d + i) % 97 == 0 else w, qual


def test_every_window_is_a_read(spark, tmp_path):
    docs = [(k, "Whole texts, to the last letter " * (k + 1)) for k in (0, 1, 2, 25, 50, 96)] + [(7, ""), (8, "short")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(_brute_reads(docs))
    assert max(int(name.split("_")[1]) for _, name, _, _ in want) >= 40
    assert sorted(tuple(r) for r in fixtures.reads(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("name", ["normalize", "kmer_code", "collapse_counts", "collapse_quality", "low_complexity_f3", "map_reads_e0"])
def test_whole_texts_equal_sql_without_its_cap(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.execute(sql.oracle_sql()[name].replace("least(40, length(s) // l)", "length(s) // l"))
    got = queries.queries()[name](spark, sf_dir).select(*(c[0] for c in want.description))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_prefixes_to_full_length(spark):
    r = random.Random(12)
    texts = {"".join(r.choice("ACGT"[: r.randint(1, 4)]) for _ in range(r.randint(9, 26))) for _ in range(150)}
    texts |= {t[k:] for t in list(texts)[:20] for k in (1, 4) if len(t) - k >= 9}  # reads that end inside others
    for own in (texts, {"ACGTACGTAC"}, {"ACGTACGTAC", "GTACGTAC"}):
        nodes = {t[::-1][:d] for t in own for d in range(len(t) + 1)}
        children = {x: sum(x + b in nodes for b in "ACGT") for x in nodes}
        runs = Counter()
        for x in nodes:
            if children[x] != 1:
                run = 0
                while run < len(x) and children[x[: len(x) - run - 1]] == 1:
                    run += 1
                runs[run] += 1
        df = spark.createDataFrame([(t,) for t in own], "s string")
        assert {tuple(g)[:2]: g["nodes"] for g in collapse.prefix_stats(df).collect()} == Counter((len(x), children[x]) for x in nodes)
        assert dict(map(tuple, collapse.branch_lengths(df).collect())) == runs
        assert tuple(collapse.read_nodes(df).first()) == (len(nodes) - 1, len(own))
    assert collapse.branch_lengths(df.limit(0)).count() == 0 and tuple(collapse.read_nodes(df.limit(0)).first()) == (0, 0)
