"""Near copies by SimHash and exact Jaccard similarity of 5-word shingles, at least 4/5: the pipeline's near-dedup stage.

A text is lower-cased in A-Z, cut into words and 5-word shingles (fewer words: the whole sequence; none: no shingle), each
as its XXH64; ``fp`` is the XXH64 of the sorted set. Texts with equal sets, and sets with at least 4/5 of their union in
common, are linked, and a component is what links reach.

The search is that of :mod:`seqloom.llm.simhash`: a SimHash of each set, linked at 2 bits or fewer through vantage-point trees; each
set of such a group is held exactly against the least one. SimHash alone would lose links, as sets with 4/5 in common differ
in about 10 bits, so what it leaves is searched by keys: two such sets share a shingle among the first n - ceil(4n/5) + 1
of each, in any order that is the same for all; those are the only keys that meet, and no pair is lost. The order puts
shingles last that a sample of texts has often, which steers only the cost. All sets of a key are first compared with the
least one. Where a key still has several components, its texts meet in one task, or in a task for each two blocks, by the
numbers of their shingles in about as many buckets as a set has shingles, which bound what two can share. What may be
similar is joined to groups over all keys, and the sets of a group meet in one task (those of a group over ``BLOCK`` in
blocks, by group or by key), where an inverted list counts what a set has in common with all others at once. Sets are read
off the texts where they are sent from, and are never written. Edges that span groups leave a task, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm import simhash
from seqloom.llm.components import spanning, stars
from seqloom.llm.shared import byte_texts, materialise, settled

SHINGLE = 5
#: Texts whose shingles are counted for the order; a shingle that OFTEN of them have goes last, the HOT commonest at most.
SAMPLE, OFTEN, HOT = 4096, 3, 1 << 16
#: Buckets that a set has at least; a larger one has the power of two at or below its size. A bucket counts to FULL.
BUCKETS, FULL = 16, 15
#: Shingles that a block of a key's sets holds: 8 MB, and a task has two.
BLOCK = 1 << 20
#: Bits, by hash, that tell in the task that reads a text whether it may be asked for.
BITS = 1 << 23
#: Texts that a block has where only the numbers by bucket meet, and its shingles in units of a block: 4 MB.
ROWS, SKETCHED = 1 << 14, 8


def shingles(text: bytes) -> np.ndarray:
    """The set of shingles, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(flat[a:b]) for a, b in spans), dtype=np.uint64, count=n))


def first_of(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The shingles by which a set meets those like it."""
    common = np.isin(own, hot, assume_unique=True)
    return np.concatenate([own[~common], own[common]])[: len(own) - (4 * len(own) + 4) // 5 + 1] if len(own) else own


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)))


def _pieces(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets(batches):
    for batch in _pieces(batches):
        own = _lists([shingles(t) for t in byte_texts(batch.column("text"))])
        yield pa.RecordBatch.from_arrays([batch.column("fp"), batch.column("to"), own], names=["fp", "to", "own"])


def _counted(batches):
    for batch in _pieces(batches):
        yield pa.RecordBatch.from_arrays([_lists([shingles(t) for t in byte_texts(batch.column("text"))])], names=["own"])


def bucket_counts(own: np.ndarray) -> bytes:
    """Shingles by bucket, 4 bits each: byte k has buckets k and k + half, so that its two numbers add up to half as many buckets."""
    buckets = max(BUCKETS, 1 << (len(own).bit_length() - 1 if len(own) else 0))
    counts = np.minimum(np.bincount((own & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), FULL).astype(np.uint8)
    return (counts[: buckets // 2] | counts[buckets // 2 :] << 4).tobytes()


class Sketches:
    """The numbers by bucket of many sets, by how many buckets they have."""

    def __init__(self, packed: list[bytes]):
        self.width = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed))
        self.at = np.empty(len(packed), dtype=np.int64)
        self.fine, self.coarse, self.full = {}, {}, np.empty(len(packed), dtype=bool)
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            both = np.frombuffer(b"".join([packed[k] for k in rows]), np.uint8).reshape(-1, width)
            low, high = both & 15, both >> 4
            self.at[rows] = np.arange(len(rows))
            self.fine[width], self.coarse[width] = np.concatenate([low, high], axis=1), low + high
            self.full[rows] = (self.fine[width] == FULL).any(axis=1)

    def shared(self, q: int, others: np.ndarray) -> np.ndarray:
        """What set q can share with each of ``others`` at most, whose sizes differ by less than a factor 2."""
        out, own = np.empty(len(others), dtype=np.int64), int(self.width[q])
        for width in np.unique(self.width[others]).tolist():
            rows = np.flatnonzero(self.width[others] == width)
            mine = (self.coarse if width < own else self.fine)[own][self.at[q]]
            theirs = (self.coarse if width > own else self.fine)[width]
            for k in range(0, len(rows), step := max(1, (1 << 22) // theirs.shape[1])):
                part = rows[k : k + step]
                out[part] = np.minimum(theirs[self.at[others[part]]], mine).sum(axis=1, dtype=np.int64)
        out[self.full[others] | self.full[q]] = np.iinfo(np.int64).max // 16  # bounds nothing
        return out


def _possible(batches):
    """Pairs of sizes that allow it which may have enough in common: 9 * common >= 4 * (n + m)."""
    for batch in _pieces(batches, 1024):
        n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
        count = batch.num_rows
        sketches = Sketches(batch.column("x").to_pylist() + batch.column("y").to_pylist())
        both = np.array([sketches.shared(k, np.array([count + k]))[0] for k in range(count)], dtype=np.int64)
        keep = pa.array(9 * both >= 4 * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b", "m")], names=["a", "b", "m"])


def _signer(hot: np.ndarray):
    def signed(batches):
        for batch in _pieces(batches):
            own = [shingles(t) for t in byte_texts(batch.column("text"))]
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in own), dtype=np.uint64, count=len(own)).view(np.int64)
            bits = np.fromiter(map(simhash.of_hashes, own), dtype=np.uint64, count=len(own)).view(np.int64)
            columns = [batch.column("id"), batch.column("th"), pa.array(fp), pa.array(bits), pa.array([len(s) for s in own], pa.int64()), _lists([first_of(s, hot) for s in own]), pa.array(map(bucket_counts, own), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "fp", "bits", "n", "first", "counts"])

    return signed


def _text_hash() -> Column:
    return F.xxhash64(F.col("text"))


def _hot(docs: DataFrame) -> np.ndarray:
    texts, n = docs.select(_text_hash().alias("th"), "text"), docs.count()
    if n > SAMPLE:
        texts = texts.where(F.pmod("th", F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    counted = texts.select("text").mapInArrow(_counted, "own array<long>").select(F.explode("own").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    rows = counted.where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "x").limit(HOT).select("x").collect()
    return np.sort(np.array([r["x"] for r in rows], dtype=np.int64).view(np.uint64))


def _word() -> Column:
    return F.expr(f"shiftright(th & {BITS - 1}L, 6)")


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(th & 63L as int))")


def _marked(hashed: DataFrame, marks: DataFrame) -> DataFrame:
    """``hashed`` (th and more) with a boolean ``marked``: true wherever th is one of ``marks`` (th), and by chance elsewhere.

    A bitmap of BITS bits, 2 MB at most however many marks there are, tells it in the task that reads a row.
    """
    words = marks.groupBy(_word().alias("word")).agg(F.bit_or(_bit()).alias("mask"))
    told = hashed.withColumn("at_word", _word()).join(F.broadcast(words), F.col("at_word") == F.col("word"), "left")
    return told.withColumn("marked", F.coalesce(F.col("mask").bitwiseAND(_bit()) != 0, F.lit(False))).drop("at_word", "word", "mask")


def _sent(routes: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``routes`` (fp, and longs that name where its set goes) with own, the set of fp, for each distinct row.

    A set is worked out once, where its text is read, and dealt from there. A text of ``docs`` that is repeated together
    with its id gives its rows again.
    """
    places = [c for c in routes.columns if c != "fp"]
    wanted = routes.groupBy("fp").agg(F.collect_set(F.struct(*(F.col(c).cast("long").alias(c) for c in places))).alias("to"))
    wanted = wanted.join(texts.select("fp", "one.*"), "fp")
    wanted = materialise(wanted, "wanted")  # its size is then known: few are sent to the texts rather than all texts dealt
    read = docs.select(_text_hash().alias("th"), F.col("doc_id").cast("long").alias("own_id"), "text")
    read = _marked(read, wanted.select("th")).where("marked")  # so that other texts are not dealt
    read = read.join(wanted, (read["th"] == wanted["th"]) & read["own_id"].eqNullSafe(wanted["id"])).select("fp", "to", "text")
    kind = ", ".join(f"{c}: bigint" for c in places)
    sets = read.mapInArrow(_sets, f"fp long, to array<struct<{kind}>>, own array<long>")
    return sets.select("fp", F.explode("to").alias("to"), "own").select("to.*", "fp", "own")


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def linked_roots(roots: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(root, least root) of the roots that similar sets link, but for the least of each group.

    Only sets outside the commonest root look for others; each counts its shingles' owners in an inverted list.
    """
    names, comp = np.unique(roots, return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)  # a task holds fewer than 2^31
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[np.argsort(tokens, kind="stable")]
    ends = np.cumsum(np.bincount(tokens))
    begins, at = ends - np.bincount(tokens), np.cumsum(sizes) - sizes
    a, b = [], []
    for q in np.flatnonzero(comp != np.bincount(comp).argmax()):
        own = tokens[at[q] : at[q] + sizes[q]]
        both = np.bincount(np.concatenate([owners[x:y] for x, y in zip(begins[own], ends[own], strict=True)]), minlength=len(sets))
        near = np.unique(comp[5 * both >= 4 * (sizes[q] + sizes - both)])
        a.append(np.full(len(near), comp[q]))
        b.append(near)
    label = spanning(len(names), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(names))
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[rest], names[label[rest]]


def _linked(table: pa.Table) -> pa.Table:
    own = table.column("own").combine_chunks()
    flat, offsets = own.values.to_numpy().view(np.uint64), own.offsets.to_numpy()
    u, v = linked_roots(table.column("root").to_numpy(), [flat[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
    return pa.table([pa.array(u), pa.array(v)], schema=_EDGE)


def _with_least(table: pa.Table) -> pa.Table:
    """Edges to the set named a from those that are similar to it."""
    a, fp = table.column("a")[0].as_py(), table.column("fp").to_numpy()
    own = table.column("own").combine_chunks()
    flat, offsets = own.values.to_numpy(), own.offsets.to_numpy()
    begins, sizes = offsets[:-1], np.diff(offsets)
    least = np.flatnonzero(fp == a)[0]
    hits = np.concatenate([[0], np.cumsum(np.isin(flat, flat[begins[least] : begins[least] + sizes[least]]))])
    both = hits[offsets[1:]] - hits[begins]
    near = np.unique(fp[(fp != a) & (5 * both >= 4 * (sizes + sizes[least] - both))])
    return pa.table([pa.array(near), pa.array(np.full(len(near), a))], schema=_EDGE)


def _hopeful(table: pa.Table) -> pa.Table:
    """Edges that span the texts of different roots that may be similar, by sizes and bucket counts."""
    roots, n, fp = (table.column(c).to_numpy() for c in ("root", "n", "fp"))
    sketches = Sketches(table.column("counts").to_pylist())
    _, comp = np.unique(roots, return_inverse=True)
    label = np.arange(len(fp))
    for q in np.flatnonzero(comp != np.bincount(comp).argmax()):
        near = np.flatnonzero((comp != comp[q]) & (5 * np.minimum(n, n[q]) >= 4 * np.maximum(n, n[q])))
        near = near[9 * sketches.shared(q, near) >= 4 * (n[near] + n[q])]
        joined = np.unique(label[np.append(near, q)])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    rest = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table([pa.array(fp[rest]), pa.array(fp[label[rest]])], schema=_EDGE)


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """``members`` with low and high: each two blocks of a key, to which a member belongs by its hash."""
    more = [c for c in members.columns if c != "blocks"]
    dealt = members.withColumn("blocks", blocks.cast("int")).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.select(*more, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select(*more, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _open(rooted: DataFrame) -> DataFrame:
    """key, members, held of the keys with several roots, one of those that have the same sets."""
    marks = [F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("fp")).alias("mark"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("mark2")]
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("held"), *marks).where("low <> high")
    # two 64-bit marks and four numbers agree: they find the same
    return keys.groupBy("low", "high", "held", "members", "mark", "mark2").agg(F.min("key").alias("key")).select("key", "members", "held")


def _across(rooted: DataFrame, docs: DataFrame, texts: DataFrame, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """u, v: edges between roots of one key of ``rooted`` (key, fp, n, root) that have similar sets.

    Texts that may be similar form groups, through whatever keys: a group whose sets fit a task is sent to one, each set
    once. Sets of larger groups go, in blocks, to a task for each two blocks of the group or to wherever their keys go,
    whichever moves fewer shingles.
    """
    members = materialise(rooted.join(_open(rooted), "key"), "members")
    blocks = F.floor(F.greatest(F.col("members") / F.lit(rows), F.col("held") / F.lit(SKETCHED * block))) + 1
    counted = _in_blocks(members.select("key", "fp", "n", "root", blocks.alias("blocks")), F.col("blocks"))
    counted = counted.join(texts.select("fp", "counts"), "fp").select("key", "low", "high", "fp", "n", "root", "counts")
    reach = stars(counted.groupBy("key", "low", "high").applyInArrow(_hopeful, "u long, v long"))
    named = reach.select(F.col("u").alias("fp"), F.col("v").alias("team")).unionAll(reach.select(F.col("v").alias("fp"), F.col("v").alias("team")).distinct())
    teams = materialise(members.select("fp", "n", "root").distinct().join(named, "fp"), "teams")
    teams = teams.join(teams.groupBy("team").agg(F.sum("n").alias("held")), "team")
    small = _sent(teams.where(F.col("held") <= block).select("fp", "team", "root"), docs, texts).drop("fp")
    edges = small.groupBy("team").applyInArrow(_linked, "u long, v long")
    large = materialise(members.select("key", "fp", "n", "root").join(teams.where(F.col("held") > block).select("fp", "team", "held"), "fp"), "large")
    if large.isEmpty():
        return edges
    moved = F.sum(F.col("h") * (F.floor(F.col("h") / F.lit(block)) + 1))
    by_key = large.groupBy("team", "key").agg(F.sum("n").alias("h"), F.first("held").alias("held"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    cheap = by_key.groupBy("team").agg(moved.alias("moved"), F.first("held").alias("held")).where(F.col("moved") < F.col("held") * (F.floor(F.col("held") / F.lit(block)) + 1))
    cheap = materialise(cheap.select("team"), "by-key")
    whole = teams.where(F.col("held") > block).join(cheap, "team", "left_anti").select(F.col("team").alias("key"), "fp", "root", "held")
    left = large.join(cheap, "team", "left_semi").select("key", "fp", "n", "root")
    left = materialise(left.join(_open(left), "key"), "members").select("key", "fp", "root", "held")
    blocks = F.floor(F.col("held") / F.lit(block)) + 1
    for part in (whole, left):
        held = _sent(_in_blocks(part, blocks).select("fp", "key", "low", "high", "root"), docs, texts).drop("fp")
        edges = edges.unionAll(held.groupBy("key", "low", "high").applyInArrow(_linked, "u long, v long"))
    return edges


def _similar(pairs: DataFrame, docs: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Those of ``pairs`` (a, b: fp, of sizes that allow it) whose sets have at least 4/5 of their union in common, as u, v.

    Sets that are compared with one a meet it in one task, or in more by their hash where they are over ``block``.
    """
    sides = [texts.select(F.col("fp").alias(k), F.col("n").alias(n), F.col("counts").alias(x)) for k, n, x in (("a", "n", "x"), ("b", "m", "y"))]
    pairs = pairs.select("a", "b").distinct().join(sides[0], "a").join(sides[1], "b").mapInArrow(_possible, "a long, b long, m long")
    pairs = materialise(pairs, "pairs")
    parts = pairs.groupBy("a").agg((F.floor(F.sum("m") / F.lit(block)) + 1).alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("fp"), "a", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    least = parts.select(F.col("a").alias("fp"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = _sent(members.unionAll(least), docs, texts)
    return materialise(dealt.groupBy("a", "part").applyInArrow(_with_least, "u long, v long"), "similar")


def _alike(n: str, m: str) -> Column:
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _by_simhash(texts: DataFrame) -> DataFrame:
    """a, b: the least set of each SimHash group, and those of the group whose sizes allow what is asked for."""
    near = stars(simhash.links(texts.select(F.col("bits").alias("fp")).distinct()))
    group = texts.select("fp", "n", "bits").join(near.select(F.col("u").alias("bits"), F.col("v").alias("group")), "bits", "left")
    group = materialise(group.select("fp", "n", F.coalesce("group", "bits").alias("group")), "simhash")
    least = group.groupBy("group").agg(F.min(F.struct("fp", "n")).alias("least"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    least = least.select("group", F.col("least.fp").alias("a"), F.col("least.n").alias("m"))
    return group.join(least, "group").where("fp <> a").where(_alike("n", "m")).select("a", F.col("fp").alias("b"))


def links(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """u, v: each fp that is not the least of its component, and that least one."""
    texts = signed.groupBy("fp").agg(F.min(F.struct("th", "id")).alias("one"), *(F.first(c).alias(c) for c in ("n", "bits", "counts")))
    texts = materialise(texts, "texts")
    key = Window.partitionBy("key")
    keys = signed.select("fp", "n", F.explode("first").alias("key")).withColumns({"least": F.min(F.struct("fp", "n")).over(key), "most": F.max("fp").over(key)})
    shared = keys.where("least.fp <> most").select("key", "fp", "n", F.col("least.fp").alias("least"), F.col("least.n").alias("m")).distinct()
    shared = materialise(shared, "keys")
    by_key = shared.where("fp <> least").where(_alike("n", "m")).select(F.col("least").alias("a"), F.col("fp").alias("b"))
    edges = _similar(_by_simhash(texts).unionAll(by_key), docs, texts)
    rooted = shared.join(stars(edges).select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = materialise(rooted.select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "key-roots")
    return stars(edges.unionAll(_across(rooted, docs, texts)))


def _staying(docs: DataFrame) -> DataFrame:
    """id, th, copies, stays: each id and text, how many rows have them, and whether its row stays of its component."""
    given = docs.select(F.col("doc_id").cast("long").alias("id"), _text_hash().alias("th"), "text")
    signed = given.mapInArrow(_signer(_hot(docs)), "id long, th long, fp long, bits long, n long, first array<long>, counts binary")
    signed = materialise(signed, "signed")
    roots = links(signed, docs).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    each = signed.groupBy("fp", "id", "th").agg(F.count(F.lit(1)).alias("copies")).join(roots, "fp", "left")
    each = materialise(each.select(F.coalesce("root", "fp").alias("root"), "id", "th", "copies"), "each")
    best = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "th")).alias("best"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("th") == F.col("best.th"))
    return each.join(best, "root").select("id", "th", "copies", stays.alias("stays"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least doc_id of each component (one row, also where ids repeat or are null).

    Decided on ids and hashes, which alone are reduced. Rows whose text no row that goes, and no repeated one, may have
    are then taken where they are read; the others are looked up by a join, and only rows that share both id and text
    are reduced to one of them, the same in each run. The columns of ``docs``, whatever their names, are unchanged.
    """
    each = settled(docs.sparkSession, lambda: _staying(docs), "stay")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), _text_hash().alias("th"), order.alias("order"), F.struct(*columns).alias("row"))
    rows = _marked(rows, each.where("not stays or copies > 1").select("th"))
    stay = each.where("stays").select(F.col("id"), F.col("th").alias("stay_th"), "copies")
    found = rows.where("marked").join(stay, (F.col("th") == F.col("stay_th")) & F.col("own").eqNullSafe(F.col("id")))
    one = found.where("copies > 1").groupBy("own", "th").agg(F.min_by("row", "order").alias("row"))
    return rows.where("not marked").select("row.*").unionAll(found.where("copies = 1").select("row.*")).unionAll(one.select("row.*"))
