"""Each operator against brute force on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import classifier, exact_dedup, html_text, mixing, packing, quality_rules, secrets, simhash, token_counts, warc
from seqloom.llm.components import spanning, stars
from seqloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, fp string"


def _words(r, n):
    return " ".join(r.choice(["the", "thnti", "on", "of,", "é", "x9", "!!", "don't", "re"]) for _ in range(n))


def _rows():
    r = random.Random(1)
    long = _words(r, 6000)
    texts = [None, "", " ", "\n\t", "a", " a", "a ", "a\tb", "a  b", "a b", "a b", long, long + " tail", long.replace(" ", "  "), "日本語 ｔ " * 30, "😀 password=abcdefghijkl " * 8]
    texts += [_words(r, r.randint(1, 150)) for _ in range(40)]
    rows = [(k, t, None, f"s{k % 3}" if k % 4 else None, None, 1, True, "f") for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[20], (None, "a b", None, "s1", 0, 2, False, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_dedup(docs, rows, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(_normal(t), []).append(d)
    want = sorted(repr((d, min((x for x in groups[_normal(t)] if x is not None), default=None), len(groups[_normal(t)]), hashlib.sha256(_normal(t).encode()).hexdigest())) for d, t, *_ in rows)
    assert sorted(repr((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"])) for g in got) == want
    assert all(g["kept"] == (g["doc_id"] == g["keep_id"]) for g in got)
    for size in (1, 200, 1 << 20):  # tables that spill at once, soon and never
        left = exact_dedup.deduplicated(docs, size)
        assert left.columns == docs.columns and left.count() == len(groups)
        assert {x["doc_id"] for x in left.collect()} == {min((x for x in g if x is not None), default=None) for g in groups.values()}
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.deduplicated(none).count() == 0


def test_colliding_digests_raise():
    table = exact_dedup.OpenTable()
    table.add(exact_dedup.Record(b"x" * 32, b"one", 1, (1, False), 1))
    with pytest.raises(ValueError):
        table.add(exact_dedup.Record(b"x" * 32, b"two", 2, (2, False), 1))


def _fingerprint(t):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, rows, none):
    prints = [_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    best = {}
    for (d, *_), x in zip(rows, label, strict=True):
        best[x] = min([v for v in (best.get(x), d) if v is not None], default=None)
    want = sorted(repr((d, f"{p:016x}", best[x])) for (d, *_), p, x in zip(rows, prints, label, strict=True))
    assert sorted(repr(tuple(g)) for g in simhash.near_duplicates(docs).collect()) == want
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == len(set(label))
    assert {x["doc_id"] for x in left.collect()} == set(best.values())
    assert simhash.near_duplicates(none).count() == simhash.one_of_each(none).count() == 0


@pytest.mark.parametrize("dense", [False, True])
def test_shards_lose_no_link(dense):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, size=1500, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, size=rng.integers(1, 6)).astype(np.uint64)) for b in (base[:3] if dense else base[:200]) for _ in range(500 if dense else 3)]
    points = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64)]))
    want = spanning(len(points), *np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2, 1)))
    assert (spanning(len(points), *simhash.near_pairs(points)) == want).all()
    tree = simhash.fit(points[::2], 2.0, 200)
    a, b = [], []
    for _, part, own, keys in simhash.route(tree, points):
        distinct = np.unique(own)
        at = np.searchsorted(distinct, own)
        i, j = simhash.by_keys(own, keys) if part else simhash.near_pairs(distinct)
        i, j = (at[i], at[j]) if part else (i, j)
        a.append(np.searchsorted(points, distinct[i]))
        b.append(np.searchsorted(points, distinct[j]))
    assert (spanning(len(points), np.concatenate(a), np.concatenate(b)) == want).all()


def test_stars_agree_with_one_task(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {tuple(x) for x in stars(df).collect()} == {tuple(x) for x in stars(df, small=0).collect()}


def _counts(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = {w: windows.count(w) for w in set(windows)} if len(windows) < 500 else {}
    if not n:
        for w in windows:
            n[w] = n.get(w, 0) + 1
    covered = {p for k, w in enumerate(windows) if n[w] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, rows, none):
    got = quality_rules.quality_rules(docs)
    want = sorted(repr((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])) for d, t, *_ in rows for c in [_counts(t)])
    assert sorted(repr(tuple(g)) for g in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == want
    left = quality_rules.kept_documents(docs)
    assert left.columns == docs.columns and left.count() == got.where("kept").count() > 0
    assert quality_rules.quality_rules(none).count() == quality_rules.kept_documents(none).count() == 0
    bad = [(k, "word " * 3, None, "bad", None, 0, True, "") for k in range(400)] + [(k, " ".join(f"w{i}" for i in range(60)), None, "bad" if k == 500 else f"good{k % 5}", None, 0, True, "") for k in range(500, 900)]
    judged = {g["doc_id"]: g for g in quality_rules.quality_rules(spark.createDataFrame(bad, SCHEMA)).collect()}
    assert judged[500]["host_rejected"] and not judged[500]["base_failed"] and not judged[500]["kept"] and judged[501]["kept"]


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(docs, shard_docs=5).collect()
    assert len(got) == len(rows) and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5), shard_docs=5).collect()))
    total = sum(g["size"] for g in got)
    assert all(g["size"] == 0 or 0 <= g["taken"] <= 3 * g["size"] for g in got)
    assert sum({g["source_size"]: g["target"] for g in got}.values()) == pytest.approx(total)
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    r = random.Random(8)
    many = [(k, "w " * r.randint(1, 200), None, r.choice(["a", "a", "a", "a", "b", None]), None, 0, True, "") for k in range(3000)]
    mixed = mixing.mix(spark.createDataFrame(many, SCHEMA), shard_docs=200)
    for x in mixed.join(spark.createDataFrame(many, SCHEMA).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect():
        assert x["taken"] == pytest.approx(x["target"], rel=0.01) and x["target"] <= 3 * x["size"]


def test_apportion_is_by_highest_quotients(spark):
    r = random.Random(6)
    votes = [("g", k, r.choice([0, 1, 7, 50, 1000, 20000])) for k in range(40)]
    for seats in (0, 1, 17, 500):
        df = spark.createDataFrame([(*v, seats, 10**9) for v in votes], "g string, id long, votes long, seats long, cap long")
        got = {x["id"]: x["won"] for x in mixing.apportion(df, ["g"], "votes", "seats", "cap", "won", ["id"]).collect()}
        order = sorted(((-n / (2 * i + 1), k, i) for _, k, n in votes if n for i in range(seats)))[:seats]
        assert got == {k: sum(o[1] == k for o in order) for _, k, _ in votes}


@pytest.fixture(scope="module")
def library():
    return token_counts.WordBpe.of(tokenizer_path()).library


def test_token_counts(docs, rows, none, library):
    want = sorted(repr((d, len((t or "").encode()), n, n > 20)) for d, t, *_ in rows for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    for huge, chunk, overlap in ((65_536, 16_384, 256), (300, 100, 8)):
        got = token_counts.token_counts(docs, tokenizer_path(), 20, huge, chunk, overlap)
        assert sorted(repr((g["doc_id"], g["n_bytes"], g["n_tokens"], g["over_limit"])) for g in got.collect()) == want
    assert token_counts.token_counts(none, tokenizer_path()).count() == 0


def test_splices_are_exact(library):
    r = random.Random(7)
    texts = ["x" * 900 + " " + "y" * 700, "<|endoftext|>" * 90, "a<|startoftext|> b" * 90, "é ́x " * 300, "日本語" * 300, "ab " * 900, ("!" * 70 + " ") * 9, _words(r, 1500)]
    for t in texts:
        for chunk, overlap in ((400, 16), (97, 8)):
            assert token_counts.spliced(library, t, chunk, overlap)[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_fast_words_equal_the_library(spark, library):
    r = random.Random(11)
    alphabet = [chr(c) for c in [*range(32, 127), *range(0xA1, 0x250)]]
    texts = ["".join(r.choice(alphabet[:95] if r.random() < 0.8 else alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["ΣΑΣ Σ", "İstanbul", "é ́a", "x y z", "\x1c\x1dfoo\x85bar", "1234 ½²3 a_b", "\x00\x01\x02 \x01", "Å Å ﬁ", "ǅ Ⱥ ß ẞ", "don’t it's '' 's 'LL", "a­b ªº", "<|endoftext|>x"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {g["doc_id"]: g for g in packing.cut(df, tokenizer_path(), length=100_000).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[k]["ids_crc32"], got[k]["length"]) == (zlib.crc32(ids.tobytes()), len(ids)), repr(t)


def test_packing(docs, rows, none, library):
    got = packing.pack(docs, tokenizer_path()).collect()
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t, *_ in rows if d is not None}
    assert sum(g["length"] for g in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    sequences = {}
    for g in got:
        if g["doc_id"] is not None:
            part = ids[g["doc_id"]][g["start"] : g["start"] + g["length"]]
            assert g["doc_tokens"] == len(ids[g["doc_id"]]) and len(part) == g["length"] and zlib.crc32(part.tobytes()) == g["ids_crc32"]
        sequences.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, tokenizer_path()).count() == 0


def _base_spans(t):
    out = []
    for k, p in (("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        out += [(m.start(), ("assign", "access", "hex").index(k), m.end(), k) for m in re.finditer(p, t or "") if (len(m[1]) >= 12 if k == "assign" else len(m[0]) >= (18 if k == "access" else 16))]
    return sorted(out)


def test_secrets(spark, docs, rows, none):
    r = random.Random(3)
    parts = ["password", "PassWord", "token", " ", "=", ":", '"', "secret", "api_key", "AKIA", "abcdef0123456789", "deadbeef", "é", "日", "ſecret", "x", "Z9", "-", "passwd", "APIKEY"]
    texts = [*(t for _, t, *_ in rows), *("".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(3000))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for g in secrets.secret_spans(df).collect():
        want = _base_spans(texts[g["doc_id"]])
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(w[3] == k for w in want) for k in ("assign", "access", "hex")]
    assert secrets.secret_spans(docs).count() == len(rows) and secrets.secret_spans(none).count() == 0


def test_checksums():
    words = secrets.automaton()
    body = b"ghijklmnopqrstuvwxyzGHIJKLMNOP"
    good = (body + secrets.base62_crc(body)).decode()
    assert secrets.render(secrets.scan(f"x ghp_{good} npm_{good}.", words)) == "github:2:42,npm:43:83"
    assert secrets.scan(f"ghp_{good[:-1]}{'0' if good[-1] != '0' else '1'}", words) == [] and secrets.bech32_valid("A12UEL5L") and not secrets.bech32_valid("A12UEL5M")


def test_html():
    page = """<!doctype html><title>no</title><script>"</p>"</script><p>one<p hidden>no<p style="visibility:hidden">no <b style="visibility:visible">yes</b>
<ul><li>a<li>b<ol start=9><li>n<li>m</ol><li>c</ul><table><tr><th>Name<th>Qty<tr><td>Apple &amp; pear<td>3<tr><td rowspan=2>x<td>1<tr><td>22</table><pre> k
  l</pre>a<b> c </b>d<br>e<details><summary>S</summary>no</details>"""
    want = "one\n\nyes\n\n- a\n- b\n  9. n\n  10. m\n- c\n\nName          Qty\nApple & pear  3\nx             1\n              22\n\n k\n  l\n\na c d\ne\nS"
    assert html_text.text_of(page) == want
    for bad in ("<", "<p", '<p a="', "</p>", "<script>x", "<!--", "<div>" * 20000 + "deep", "<table><tr><td>" * 40 + "t", "&#x110000;&bogus;"):
        html_text.text_of(bad)


def test_page_texts(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", None), (None, "<p>x", "u")], "page_id long, html string, text string")
    assert sorted(map(repr, html_text.page_texts(df).collect())) == sorted(["Row(page_id=1, text='', n_chars=0, n_lines=0)", "Row(page_id=2, text='', n_chars=0, n_lines=0)", "Row(page_id=None, text='x', n_chars=1, n_lines=1)"])


def test_warc(spark, tmp_path):
    big, small = "<p>é\r\n\r\nWARC/1.1" + "x" * 1000, "tiny"
    rows = [(1, "http://a\nb", big, "c"), (2, "u", big, "c"), (3, None, small, "c"), (4, "u", small, "c"), (5, "u", None, "c"), (None, "u", big, "c"), (2, "u", big, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, header string")
    path = warc.write_archive(pages, str(tmp_path / "archive"))
    got = sorted(map(repr, warc.index(spark, path).collect()))
    want = []
    for d, _, h, _ in rows:
        data = (h or "").encode()
        revisit = h == big and d != 2
        want.append(f"Row(page_id={d}, payload_bytes={len(data)}, payload_digest='{hashlib.sha1(data).hexdigest()}', record_type='{'revisit' if revisit else 'response'}', refers_to={2 if revisit else None})")
    assert got == sorted(want)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    warc.export(spark, path, str(tmp_path / "files"))
    parsed = [(h, b) for f in (tmp_path / "files").glob("*.txt") for h, b in warc.parse(f.read_bytes())]
    assert sorted(parsed) == sorted((x["header"], bytes(x["block"])) for x in warc.records(spark, path).collect()) and len(parsed) == len(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_classifier(spark, sf_dir, docs, rows, none):
    d, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.quality_scores(d, labels).persist()
    assert scored.count() == d.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    held = scored.where("held_out").join(labels, "doc_id")
    right = held.where("predicted = quality").count() / held.count()
    assert right >= held.where("quality = 1").count() / held.count() and right > 0.9
    assert classifier.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert classifier.quality_scores(docs, labels).count() == len(rows) and classifier.quality_scores(none, labels).count() == 0


def test_stages(spark, docs, none, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    for start in (docs, none):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, stage(spark, at, sf_dir)
            assert name == "packing" or at.columns == before.columns
        at.count()
