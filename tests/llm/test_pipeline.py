"""The rows of the whole pipeline against brute force, stage by stage, from a table on disk to packed pieces."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from seqloom.llm import sql
from seqloom.llm.packing import LENGTH
from seqloom.llm.queries import tokenizer_path
from seqloom.llm.wordbpe import WordBpe


def _documents(r):
    rows = []
    for k in range(160):
        base = " ".join(f"w{r.randrange(900)}" for _ in range(r.randint(40, 300)))
        rows.append((k, base, "en", f"s{k % 4}" if k % 9 else None, len(base)))
    rows.append((500, " ".join(f"v{r.randrange(9000)}" for _ in range(5000)), "en", "s1", 0))
    for k in range(600, 640):  # copies, other spacing, and near copies of one long text and of others
        d = r.choice(rows[:120])
        words = d[1].split(" ")
        if k % 3 == 1:
            words[r.randrange(len(words))] = "changed"
        rows.append((k, ("  " if k % 3 == 2 else " ").join(words), "en", d[3], 1))
    rows += [(700, None, None, None, None), (701, "", "en", "s0", 0), (702, "spam spam spam " * 40, "en", "s0", 0), rows[3]]
    return rows


def _kept(rows):
    out = []
    for d in rows:
        words = (d[1] or "").split()
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words):
            out.append(d)  # no document here has symbols or repeated lines
    return out


def _one_of(rows, alike):
    """The row of least doc_id of each group that ``alike`` links."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    best = {}
    for x, d in zip(label, rows, strict=True):
        if x not in best or d[0] < best[x][0]:
            best[x] = d
    return list(best.values())


def test_rows_of_all_stages(spark, tmp_path):
    rows = _documents(random.Random(77))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()))

    left = _kept(rows)
    texts = [re.sub("[\x20\x09-\x0d]+", " ", d[1]) for d in left]
    left = _one_of(left, lambda i, j: texts[i] == texts[j])
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (d[1].split() for d in left)]
    left = _one_of(left, lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    assert 100 < len(left) < 175
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", left)
    taken = {r[0]: (r[1], r[4]) for r in con.execute(sql.OP8).fetchall()}
    library = WordBpe.of(tokenizer_path()).library
    want, passes = Counter(), Counter()
    for d in left:
        size, words = taken[d[0]]
        times = int(words / size + 0.5)
        passes[times] += 1
        ids = np.array([*library.encode(d[1], add_special_tokens=False).ids, 1], dtype="<u4")
        for start in range(0, len(ids), LENGTH):
            part = ids[start : start + LENGTH]
            want[(d[0], start, len(part), zlib.crc32(part.tobytes()), len(ids))] += times
    assert got == +want and len(passes) > 1


def test_nothing_is_left_behind(spark, tmp_path):
    """Of what the stages wrote only the pieces that the result reads are still there."""
    import os

    from seqloom.session import shared_dir

    spark.createDataFrame(_documents(random.Random(3))[:40], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert {x.split("-")[1] for x in left} == {"pieces"} and out.count() > 0


def test_whole_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        for given, want in (("10000", "1024"), ("0", "1024"), ("50", "50")):
            spark.conf.set(name, given)
            corpus_pipeline.exact(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.unset(name)
