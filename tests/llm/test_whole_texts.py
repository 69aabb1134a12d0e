"""The operators on whole texts and sources: nothing of a text or a source is left out."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import mixing, near_copies, simhash
from seqloom.session import materialise, shared_dir


def _mixed(spark, rows, shard_docs):
    """words taken and target of each source"""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shard_docs=shard_docs).join(docs.select("doc_id", "source"), "doc_id")
    return {g["source"]: (g["taken"], g["target"]) for g in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}


def test_small_sources_meet_their_targets(spark):
    big = "w " * 300_000
    got = _mixed(spark, [(1, big, "a"), (2, big, "b"), (3, "five words and no more", "c"), (4, "w " * 100, "d")], 4096)
    assert got["c"] == (15, 15.0) and got["d"] == (300, 300.0)
    assert all(taken == pytest.approx(target, rel=0.001) for taken, target in got.values())


def test_small_shards_meet_their_targets(spark):
    rows = [(k, "w " * 9, "a") for k in range(1000)] + [(1000 + k, "w " * 50_000, f"b{k:02}") for k in range(59)]
    got = _mixed(spark, rows, 1)
    assert got["a"][1] < 3 * 9000 and all(taken == pytest.approx(target, rel=0.01) for taken, target in got.values())


def _shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("often", [1, 3, 10**6])
def test_near_copies_are_exact(spark, sf_dir, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    r = random.Random(21)
    texts = [None, "", " \n", "a b", "A  b", "one two three four five", "one two three four six"]
    for _ in range(8):
        base = [f"w{r.randrange(400)}" for _ in range(r.randint(5, 160))]
        for _ in range(8):  # chains of copies about the bound, with a passage that all texts share
            for _ in range(r.randint(0, 3)):
                base[r.randrange(len(base))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(base + ["this passage is in all of these long texts"] * (len(base) > 60)))
    rows = [(k if k % 9 else None, t, None, "s", 1, "x") for k, t in enumerate(texts)]
    rows += rows[10:13]
    sets = [_shingles(t) for _, t, *_ in rows]
    label, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and label[j] < label[i]:
                    label[i], changed = label[j], True
    best = {}
    for (d, *_), x in zip(rows, label, strict=True):
        best[x] = min([v for v in (best.get(x), d) if v is not None], default=None)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th string").repartition(3)
    left = corpus_pipeline.near(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert sorted(map(repr, (x["doc_id"] for x in left.collect()))) == sorted(map(repr, best.values()))
    assert 1 < len(best) < len(rows) - 20
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_blocks_lose_no_link(spark, sf_dir, monkeypatch):
    """A star of near copies whose sets share all their keys, cut into many blocks."""
    monkeypatch.setattr(near_copies._across, "__defaults__", (400, 7))
    r = random.Random(4)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(120):
        words = list(base)
        for p in r.sample(range(100), r.choice((1, 2, 3, 4, 6))):
            words[p] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    left = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(set(label)) and 2 < len(set(label)) < 110


def test_rows_that_share_id_and_text_leave_one(spark):
    """Repeated rows, with and without an id, extra columns with clashing names, and what was written on the way."""
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, "b", 1), (1, words, "a", 2), (1, words, "a", 2), (2, words + " x", "c", 3), (None, None, "d", 4), (None, "", "e", 5), (3, "alone", "f", 6), (9, "alone", "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, own_th string, stay_copies int")
    for frame in (docs, docs.repartition(5)):
        before = set(os.listdir(shared_dir(spark)))
        left = near_copies.one_of_each(frame)
        made = {x.split("-")[1] for x in set(os.listdir(shared_dir(spark))) - before}
        assert made == {"stay"} and left.columns == docs.columns
        got = sorted(map(tuple, left.collect()), key=repr)
        assert [g[0] for g in got] == [1, 3, None] and got[0] in rows[:3] and got[1] == rows[6]
        first = got if frame is docs else first
        assert got == first


def test_simhash_groups_are_linked_without_keys(spark):
    """The vantage-point search finds near copies by itself; each is held against the exact similarity."""
    r = random.Random(8)
    rows = []
    for k in range(30):
        words = [f"w{r.randrange(10**6)}" for _ in range(400)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words, "more"])), (3 * k + 2, " ".join(words[:200]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = docs.select(F.col("doc_id").alias("id"), near_copies._text_hash().alias("th"), "text")
    signed = given.mapInArrow(near_copies._signer(np.empty(0, np.uint64)), "id long, th long, fp long, bits long, n long, first array<long>, counts binary")
    signed = materialise(signed.withColumn("first", F.expr("filter(first, x -> false)")), "signed")
    of = {x["fp"]: x["id"] for x in signed.select("fp", "id").collect()}
    got = {tuple(sorted((of[x["u"]], of[x["v"]]))) for x in near_copies.links(signed, docs).collect()}
    bits = {k: simhash.of_hashes(near_copies.shingles(t.encode())) for k, t in rows}
    want = {(k, k + 1) for k in range(0, 90, 3) if (bits[k] ^ bits[k + 1]).bit_count() <= 2}
    assert got == want and len(want) > 20


def test_buckets_bound_what_sets_share():
    """Never less than two sets share, and for long texts with one passage in common too little to be compared."""
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 64, size=20_000, dtype=np.uint64)
    sets = [np.unique(r.choice(pool[: 2 * n], n, replace=False)) for n in (1, 5, 16, 31, 32, 38, 300, 310, 500, 540, 5000, 5200)]
    sets += [np.unique(np.concatenate([pool[:500], r.integers(0, 1 << 64, size=4500, dtype=np.uint64)])) for _ in range(3)]
    sets.append((np.arange(40, dtype=np.uint64) << np.uint64(32)) + np.uint64(7))  # one bucket has all
    sketches = near_copies.Sketches([near_copies.bucket_counts(s) for s in sets])
    for q, own in enumerate(sets):
        others = np.array([k for k, s in enumerate(sets) if 5 * min(len(s), len(own)) >= 4 * max(len(s), len(own))])
        most = sketches.shared(q, others)
        assert all(x >= len(np.intersect1d(own, sets[k])) for k, x in zip(others, most, strict=True))
        assert q not in (12, 13, 14) or all(9 * x < 8 * 4900 for k, x in zip(others, most, strict=True) if k != q)


def test_marks_miss_none(spark):
    """The bitmap that keeps other texts where they are tells of every text that is asked for."""
    hashed = spark.range(40_000).select(F.xxhash64("id").alias("th"), "id")
    marked = near_copies._marked(hashed, hashed.where("id % 40 = 0").select("th"))
    got = {x["id"]: x["marked"] for x in marked.collect()}
    assert len(got) == 40_000 and all(got[k] for k in range(0, 40_000, 40)) and sum(got.values()) < 1100
