"""SimHash near-duplicates: exact pairs of fingerprints through vantage-point trees, then components.

A text is lower-cased in A-Z, cut into words and 3-word shingles (repeats included; fewer words: the whole sequence;
none: fingerprint zero); a bit is set if it is set in over half the shingles' XXH64 (seed 42). Fingerprints that differ
in at most ``RADIUS`` bits are linked, and a component is what links reach. Null texts are empty.

Only distinct fingerprints are linked; copies share one. A tree of vantage points is fitted on a sample of
``SAMPLE_PER_SHARD`` fingerprints a shard (it only steers the balance: any tree gives exact pairs) and routes every
fingerprint: at a node with vantage v and radius r, those with d <= r + 2 go inside and those with d > r outside. Of a
pair at distance 2 or less either both are outside, or one is within r and the other, by the triangle inequality, within
r + 2: so each pair meets in a shard, and a branch is pruned unless the boundary overlaps it. A shard continues with
such a tree in memory down to leaves that are compared directly.

Fingerprints that lie so close together that no vantage point separates them (a large group of near copies) are linked
without comparing pairs: each emits itself and its 64 neighbours at distance 1 as keys; two fingerprints share a key
exactly if they differ in at most 2 bits. That costs 65 keys each however many there are, and the keys of such a branch
are dealt over many shards. Shards return a spanning star for each group they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import spanning, stars
from seqloom.llm.shared import byte_texts, free_names, materialise

RADIUS = 2
SEED = 42
SHINGLE = 3
#: There are about SHARDS shards, more only beyond SHARD_MOST fingerprints a shard, fewer only under SHARD_LEAST. Their
#: number, not the input, decides how often a fingerprint is routed; a shard goes on splitting in memory.
SHARD_LEAST, SHARD_MOST, SHARDS = 256, 1 << 20, 64
SAMPLE_PER_SHARD = 64
#: Leaves compared directly; branches of which a split keeps more than this share inside are dense.
LEAF, DENSE = 128, 0.85
_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    hashes = np.fromiter((hashed(flat[a:b], SEED) for a, b in spans), dtype=np.uint64, count=n)
    return of_hashes(hashes)


def of_hashes(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``; zero where there are none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(column: str = "text"):
    """A column of fingerprints, as signed 64-bit numbers."""

    @F.arrow_udf("long")
    def of_texts(texts: pa.Array) -> pa.Array:
        values = np.fromiter(map(fingerprint, byte_texts(texts)), dtype=np.uint64, count=len(texts))
        return pa.array(values.view(np.int64))

    # dear: marked so that the optimizer neither repeats it nor moves filters below it
    return of_texts.asNondeterministic()(F.col(column))


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int64)


def split(points: np.ndarray, tries: int = 12):
    """(vantage, radius, share inside) that divides ``points`` best, or None where they are dense."""
    best = None
    for k in range(tries):
        vantage = points[(k * 2654435761 + 7) % len(points)]
        d = distances(points, vantage)
        radius = int(np.median(d))
        inside, outside = int((d <= radius + RADIUS).sum()), int((d > radius).sum())
        if outside and (best is None or inside + outside < best[0]):
            best = (inside + outside, vantage, radius, inside / len(points))
    return None if best is None or best[3] > DENSE else best[1:]


def fit(sample: np.ndarray, share: float, most: float) -> tuple:
    """A routing tree: ('node', vantage, radius, inside, outside), ('shard', k) or ('dense', k, parts).

    ``share``: fingerprints that one of the sample stands for; a branch with ``most`` at most is a shard.
    """
    numbers = iter(range(1 << 40))

    def grow(points: np.ndarray) -> tuple:
        size = len(points) * share
        if size <= most or len(points) < 8:
            return ("shard", next(numbers))
        found = split(points)
        if found is None:
            return ("dense", next(numbers), int(len(_FLIPS) * size // most) + 1)
        vantage, radius, _ = found
        d = distances(points, vantage)
        return ("node", np.uint64(vantage), radius, grow(points[d <= radius + RADIUS]), grow(points[d > radius]))

    return grow(sample)


def route(tree: tuple, points: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, points, keys) for all ``points``; keys are those of dense branches, else the points themselves."""
    out = []

    def down(node: tuple, points: np.ndarray) -> None:
        if not len(points):
            return
        if node[0] == "node":
            d = distances(points, node[1])
            down(node[3], points[d <= node[2] + RADIUS])
            down(node[4], points[d > node[2]])
        elif node[0] == "shard":
            out.append((node[1], 0, points, points))
        else:
            keys = (points[:, None] ^ _FLIPS[None, :]).ravel()
            owners = np.repeat(points, len(_FLIPS))
            part = (keys * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(node[2])
            for p in np.unique(part):
                out.append((node[1], int(p) + 1, owners[part == p], keys[part == p]))

    down(tree, points)
    return out


def by_keys(points: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of points linked by equal keys: neighbours in the order of keys."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return order[1:][same], order[:-1][same]


def near_pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span every group of ``points`` (distinct) whose neighbours differ in at most RADIUS bits."""
    a_all, b_all, held = [], [], 0
    work = [np.arange(len(points))]
    while work:
        index = work.pop()
        own = points[index]
        found = split(own, tries=3) if len(index) > LEAF else None
        if found is not None:
            d = distances(own, found[0])
            work += [index[d <= found[1] + RADIUS], index[d > found[1]]]
            continue
        if len(index) <= 8 * LEAF:
            a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS, 1))
        else:
            keys = (own[:, None] ^ _FLIPS[None, :]).ravel()
            a, b = (k // len(_FLIPS) for k in by_keys(own, keys))
        if len(a):
            a_all.append(index[a])
            b_all.append(index[b])
            held += len(a)
        if held > 4_000_000:  # keep a spanning star only
            label = spanning(len(points), np.concatenate(a_all), np.concatenate(b_all))
            a = np.nonzero(label != np.arange(len(points)))[0]
            a_all, b_all, held = [a], [label[a]], 0
    if not a_all:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a_all), np.concatenate(b_all)


_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _shard_edges(table: pa.Table) -> pa.Table:
    """A spanning star for each group of linked fingerprints of a shard."""
    points = table.column("fp").to_numpy().view(np.uint64)
    if table.column("part")[0].as_py():
        distinct, at = np.unique(points, return_inverse=True)
        a, b = by_keys(points, table.column("key").to_numpy().view(np.uint64))
        a, b = at[a], at[b]
    else:
        distinct = np.unique(points)
        a, b = near_pairs(distinct)
    label = spanning(len(distinct), a, b)
    at = np.nonzero(label != np.arange(len(distinct)))[0]
    return pa.table([pa.array(distinct[at].view(np.int64)), pa.array(distinct[label[at]].view(np.int64))], schema=_EDGE)


def _router(tree: tuple) -> Callable:
    def routed(batches):
        for batch in batches:
            for shard, part, points, keys in route(tree, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)):
                for at in range(0, len(points), 1 << 16):
                    p, k = points[at : at + (1 << 16)], keys[at : at + (1 << 16)]
                    columns = [pa.array(np.full(len(p), shard)), pa.array(np.full(len(p), part)), pa.array(p.view(np.int64)), pa.array(k.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "part", "fp", "key"])

    return routed


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that span every group of linked fingerprints; ``distinct`` has the column fp, each value once."""
    n = distinct.count()
    size = min(max(SHARD_LEAST, n // SHARDS), SHARD_MOST)
    wanted = SAMPLE_PER_SHARD * (n // size + 1)
    sample = distinct.select("fp")
    if n > wanted:
        # by hash, so that reruns fit the same tree
        sample = sample.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * wanted / n))
    points = np.sort(np.array([r["fp"] for r in sample.collect()], dtype=np.int64).view(np.uint64))
    tree = fit(points, n / max(1, len(points)), size)
    routed = distinct.select("fp").mapInArrow(_router(tree), "shard long, part long, fp long, key long")
    return routed.groupBy("shard", "part").applyInArrow(_shard_edges, "u long, v long")


def _labels(fps: DataFrame, best) -> DataFrame:
    """fp and ``best`` over its component, for each distinct fp of ``fps``; ``best``: an aggregate of column ``b``."""
    distinct = materialise(fps.groupBy("fp").agg(best.alias("b")), "fingerprints")
    star = stars(links(distinct))
    whole = star.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionAll(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    rooted = materialise(distinct.join(whole, "fp", "left").select("fp", "b", F.coalesce("root", "fp").alias("root")), "rooted")
    tops = materialise(rooted.groupBy("root").agg(best.alias("best")), "tops")
    return materialise(rooted.select("fp", "root").join(tops, "root").select("fp", "best"), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, fingerprint, component_id (least doc_id that links reach; null ids count last)."""
    fps = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints().alias("fp")), "signed")
    labels = _labels(fps.select("fp", F.col("doc_id").alias("b")), F.min("b"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least doc_id of each component (one row, also where ids repeat or are null).

    Only ids and fingerprints take part in the search. Whole rows are then reduced to one a fingerprint, in each task
    before they are dealt, and those of fingerprints that do not stay are dropped; no copy of the texts is written. The
    columns of ``docs``, whatever their names, are unchanged.
    """
    fp, row = free_names(docs.columns, "fp", "row")
    fps = materialise(docs.select(F.col("doc_id").cast("long").alias("id"), fingerprints().alias("fp")), "signed")
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("fp"))
    labels = _labels(fps.select("fp", rank.alias("b")), F.min("b"))
    stay = labels.where("best.fp = fp").select(F.col("fp").alias(fp))
    # an inner join with unique keys, which unlike a semi-join is not moved below the reduction
    rows = docs.select(fingerprints().alias(fp), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row))
    first = F.struct(F.col(row)["doc_id"].isNull(), F.col(row)["doc_id"], F.xxhash64(F.col(row)["text"]))
    return rows.groupBy(fp).agg(F.min_by(row, first).alias(row)).join(stay, fp).select(f"{row}.*")
