"""Distinct sequences to all genome places at their minimum edit distance, by seeds and verification.

Round e cuts each sequence that no earlier round mapped into e+1 pieces; an alignment with e edits leaves a piece intact,
so the pieces' first bases (at most ``SEED_MOST``) are equi-joined with the windows of both strands. A window carries the
bases around it, so a seed's places are verified with ``levenshtein(a, b, e)`` in the join's own stage and only places
that hold are dealt and deduplicated, by place. Sequences over ``INLINE`` bases, whose surroundings would make the windows
heavy and whose seeds are rarely found by chance, fetch the surrounding tile by an equi-join instead.

The genome is kept as small tiles with margins of the longest sequence and its errors, so no place is cut off and no task
scans a contig for a window. Both sides of a seed join come straight from an exchange: a seed that is everywhere is a
skewed key, which adaptive execution splits. Rounds are written to the shared folder: the next one reads what is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.align import operations
from seqloom.functions.seq import mismatches, reverse_complement
from seqloom.session import materialise, ship_package

SEED_MOST = 14
TILE = 256
#: Longest sequence whose windows carry their surroundings.
INLINE = 160
MAPPED = "s string, rid long, st int, start long, glen int, g string, n_errors int"


def strands(contigs: DataFrame) -> DataFrame:
    """rid, st (1 forward, 0 reverse complement), s, len."""
    forward = contigs.select("rid", F.lit(1).alias("st"), "s", "len")
    return forward.unionAll(contigs.select("rid", F.lit(0).alias("st"), reverse_complement(F.col("s")).alias("s"), "len"))


def tiles(both: DataFrame, margin: int, size: int = TILE) -> DataFrame:
    """rid, st, tile, lead, text: bases tile*size+1 .. (tile+1)*size of each strand, ``margin`` (at most ``size``) more on
    either side where the contig has them; ``lead`` of these come before. A contig is cut in one pass."""
    cut = both.select("rid", "st", F.regexp_extract_all("s", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("own"))

    def with_margins(i):
        # the first chunk's left neighbour is empty, and so is the last one's right neighbour
        left = F.when(i > 0, F.right(F.get(F.col("own"), i - 1), F.lit(margin))).otherwise("")
        right = F.coalesce(F.left(F.get(F.col("own"), i + 1), F.lit(margin)), F.lit(""))
        return F.struct(i.alias("tile"), F.length(left).alias("lead"), F.concat(left, F.get(F.col("own"), i), right).alias("text"))

    every = F.when(F.size("own") > 0, F.sequence(F.lit(0), F.size("own") - 1)).otherwise(F.array().cast("array<int>"))
    return cut.select("rid", "st", F.explode(F.transform(every, with_margins)).alias("x")).select("rid", "st", "x.*")


def windows(tiled: DataFrame, lengths: list[int], margin: int, inline: bool, size: int = TILE) -> DataFrame:
    """k, kmer, rid, st, p, tile, at, context: each place (1-based, on its strand) of each window of the given lengths.

    ``inline``: context holds the bases from ``margin`` before the place to ``margin`` beyond it, at its ``at``-th base the
    place; else it is left out and ``at`` counts in the tile's text.
    """
    each = tiled.select("rid", "st", "tile", "lead", "text", F.explode(F.array(*(F.lit(k) for k in lengths))).alias("k"))
    own = F.least(F.lit(size), F.length("text") - F.col("lead") - F.col("k") + 1)
    each = each.select("*", F.explode(F.when(own > 0, F.sequence(F.lit(1), own)).otherwise(F.array().cast("array<int>"))).alias("q"))
    at = F.col("lead") + F.col("q")
    kmer = F.substring(F.col("text"), at, F.col("k"))
    base = each.select("k", kmer.alias("kmer"), "rid", "st", (F.col("tile").cast("long") * size + F.col("q")).alias("p"), "tile", at.alias("at"), "text")
    if not inline:
        return base.drop("text")
    first = F.greatest(F.col("at") - margin, F.lit(1))
    context = F.substring(F.col("text"), first, F.col("at") - first + margin)
    return base.select("k", "kmer", "rid", "st", "p", (F.col("at") - first + 1).alias("at"), context.alias("context"))


def _lengths(sequences: DataFrame) -> list[int]:
    """Distinct lengths: a few numbers, whatever the corpus."""
    return sorted(r[0] for r in sequences.select(F.length("s").alias("n")).distinct().collect())


def _moves(e: int) -> list[tuple[int, int]]:
    """(shift of the start, change of the length) that e edits around an intact seed allow."""
    return [(a, c) for a in range(-e, e + 1) for c in range(-e, e + 1) if abs(a) + abs(a + c) <= e]


def _likely(e: int) -> Column:
    """Whether the bases where the seed (at base ``off`` + 1 of s, at base ``at`` of ``context``) puts a sequence are near it.

    A place at distance e begins and ends at most e bases in all from there, so these bases are at distance 2e at most.
    """
    start = F.greatest(F.lit(1), F.col("at") - F.col("off"))
    return F.levenshtein("s", F.substring(F.col("context"), start, F.col("at") - F.col("off") + F.col("L") - start), 2 * e) >= 0


def round_of(sequences: DataFrame, lengths: list[int], tiled: DataFrame, e: int, size: int = TILE, inline: bool = True) -> DataFrame:
    """All places at edit distance exactly ``e`` of ``sequences``, which have the given lengths and no place nearer."""
    margin = max(lengths) + e
    seeds = sorted({max(1, min(SEED_MOST, n // (e + 1))) for n in lengths})
    cut = sequences.select("s", F.length("s").alias("L"), F.explode(F.sequence(F.lit(0), F.lit(e))).alias("piece"))
    cut = cut.withColumn("off", F.expr(f"cast((L * piece) div {e + 1} as int)")).withColumn("k", F.greatest(F.lit(1), F.least(F.lit(SEED_MOST), F.expr(f"cast(L div {e + 1} as int)"))))
    cut = cut.select("s", "L", "off", "k", F.substring(F.col("s"), F.col("off") + 1, F.col("k")).alias("kmer"))
    met = cut.join(windows(tiled, seeds, margin, inline, size), ["k", "kmer"])
    if not inline:
        met = met.join(tiled.select("rid", "st", "tile", F.col("text").alias("context")), ["rid", "st", "tile"])
    if e:
        met = met.where(_likely(e))  # in the join itself, before a place is a row for each move
    moves = F.array(*(F.struct(F.lit(a).alias("shift"), F.lit(c).alias("change")) for a, c in _moves(e)))
    moved = met.select("*", F.explode(moves).alias("m"))
    at = F.col("at") - F.col("off") + F.col("m.shift")
    glen = F.col("L") + F.col("m.change")
    placed = moved.where((at >= 1) & (glen > 0)).select("s", "rid", "st", (F.col("p") - F.col("off") + F.col("m.shift")).alias("start"), glen.alias("glen"), F.substring(F.col("context"), at, glen).alias("g"))
    near = F.col("s") == F.col("g") if e == 0 else F.levenshtein("s", "g", e) == e
    found = placed.where((F.length("g") == F.col("glen")) & near)
    # one piece and one move find a place once
    return (found if e == 0 else found.distinct()).select("s", "rid", "st", "start", "glen", "g", F.lit(e).alias("n_errors"))


def best_places(sequences: DataFrame, contigs: DataFrame, most_errors: int = 2) -> DataFrame:
    """s, rid, st, start, glen, g, n_errors: all places at each sequence's minimum distance, if that is at most ``most_errors``.

    Sequences must be longer than ``most_errors``.
    """
    left = materialise(sequences.select("s").distinct(), "unmapped")
    lengths = _lengths(left)
    out = sequences.sparkSession.createDataFrame([], MAPPED)
    if not lengths:
        return out
    if lengths[0] <= most_errors:
        raise ValueError("sequences must be longer than the errors allowed")
    margin = lengths[-1] + most_errors
    size = max(TILE, margin)
    tiled = materialise(tiles(strands(contigs), margin, size), "tiles")
    for e in range(most_errors + 1):
        parts = []
        for inline in (True, False):
            own = [n for n in lengths if (n <= INLINE) == inline]
            if own:
                among = left.where(F.length("s") <= INLINE if inline else F.length("s") > INLINE)
                parts.append(round_of(among, own, tiled, e, size, inline))
        mapped = materialise(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), f"round{e}")
        out = mapped if e == 0 else out.unionByName(mapped)
        if e < most_errors:
            left = materialise(left.join(mapped.select("s").distinct(), "s", "left_anti"), "unmapped")
    return out


@F.pandas_udf(T.LongType())
def _counted_indels(read: pd.Series, g: pd.Series) -> pd.Series:
    return pd.Series([sum(c in "ID" for c in operations(r, x)) for r, x in zip(read, g, strict=True)], dtype="int64")


def with_indels(places: DataFrame, most_errors: int = 2) -> DataFrame:
    """``places`` and n_indels: the fewest insertions and deletions of an optimal alignment.

    Up to two errors the lengths and the mismatches tell; ``most_errors`` above that sends places with more to Python.
    """
    change = F.abs(F.length("s") - F.col("glen"))
    same = F.when((F.col("n_errors") < 2) | (mismatches(F.col("s"), F.col("g")) == F.col("n_errors")), F.lit(0)).otherwise(F.lit(2))
    few = places if most_errors <= 2 else places.where("n_errors <= 2")
    told = few.withColumn("n_indels", F.when(change > 0, change).otherwise(same).cast("long"))
    if most_errors <= 2:
        return told
    ship_package(places.sparkSession)
    return told.unionByName(places.where("n_errors > 2").withColumn("n_indels", _counted_indels("s", "g")))


def intervals(places: DataFrame) -> DataFrame:
    """``places`` (with n_indels), one for each set of occurrences and place, and n_hits_raw of each sequence.

    Places of one sequence that begin alike and whose texts occur equally often are the same set: the one with fewest
    indels stays (then the shortest). Counts are pre-aggregated and joined back, so a sequence that lies everywhere is
    never gathered in one task.
    """
    occurrences = places.groupBy("s", "g").agg(F.count(F.lit(1)).alias("occ"))
    best = F.struct("n_indels", "glen", "g", "n_errors")
    one = places.join(occurrences, ["s", "g"]).groupBy("s", "rid", "st", "start", "occ").agg(F.min(best).alias("best"))
    one = materialise(one.select("s", "rid", "st", "start", "occ", "best.*"), "intervals")
    counts = one.groupBy("s").agg(F.count(F.lit(1)).alias("n_hits_raw"))
    return one.join(counts, "s")
