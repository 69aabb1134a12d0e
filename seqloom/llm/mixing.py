"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Sizes are words (null text: 0). Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words;
a target stops at three times its source's words and the excess is shared again by weight until none is above.

Every source is dealt by a seeded hash of doc_id into shards of about ``shard_docs`` documents. Words are apportioned in
blocks of ``block`` words, by the highest quotients size/(2k+1): first among the sources by their targets, then among the
shards of a source by their words, no shard over three times its words. A shard's documents, in seeded order, form a
ring of words, on which its quota of blocks begins at a seeded block boundary. How often a document's words are passed
follows in closed form from its place on the ring, so nothing is exploded, and no window holds more than a shard.

A source whose target is three times its words takes no part in that: its documents are passed three times, however few
blocks it has. The other sources have over a thousand blocks each. Where a source's shards are below ``SHARD_LEAST`` blocks
on average, its words are dealt to them in smaller blocks.

Ties (equal hashes, repeated rows) are ordered by doc_id and size; rows equal in both are interchangeable. Reruns agree,
whatever the partitioning. Empty texts and empty sources take 0 words; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import SPACE, materialise, whole_text

#: No document is taken more often.
REPEATS = 3
#: A source of average size is apportioned in at least so many blocks, and a shard of average size too.
BLOCKS_PER_SOURCE = 4096
BLOCKS_PER_SHARD = 256
SHARD_DOCS = 4096
#: Blocks that a source's shard of average size has at least.
SHARD_LEAST = 64
SEED = 42


def n_words(text: Column) -> Column:
    core = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(core == "", F.lit(0)).otherwise(F.regexp_count(core, F.lit(f"[{SPACE}]+")) + 1).cast("long")


def _hash(*parts: Column) -> Column:
    """Eleven hex digits of MD5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 1, 11), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """A row a source: source, docs, source_size, weight, target.

    Sources are filled in order of cap over weight: capped are those whose cap does not exceed the level that remains
    for them and all later ones, exactly where sharing the excess again and again ends.
    """
    sources = materialise(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources")
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", (F.row_number().over(ordered) - 1) % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = total - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    filled = sources.withColumn("level", level.cast("double"))
    filled = filled.withColumn("free", F.col("level") * F.col("weight") < REPEATS * F.col("source_size"))
    # the first free source in this order sets the level of all later ones
    shared = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0))
    capped = (REPEATS * F.col("source_size")).cast("double")
    return filled.withColumn("shared", shared).select("source", "docs", "source_size", "weight", F.coalesce(F.col("shared") * F.col("weight"), capped).alias("target"))


def apportion(df: DataFrame, group: list[str], size: str, seats: str, cap: str, into: str, tie: list[str]) -> DataFrame:
    """Sainte-Laguë within ``group``: ``seats`` (equal for all rows of a group) by the highest quotients ``size``/(2k+1).

    No row gets more than ``cap``. Let x be a row's exact share and r the rows of its group. The divisor that gives all
    seats lies within a factor 1 ± r/seats of size/x, so a row's seats lie within x(1 ± (r+1)/seats) ± 2; only quotients of that
    band are compared, about three a row, and the seats below the band are given outright. Where caps bind, fewer than
    ``seats`` may be given: at most one block a shard is lost. ``df`` has no columns named rows, total, share, slack,
    low, high, open, k or given.
    """
    g = Window.partitionBy(*group)
    rows, total = F.count(F.lit(1)).over(g), F.sum(size).over(g)
    share = F.when(F.col("total") > 0, F.col(seats) * F.col(size) / F.col("total")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, (F.col("rows") + 1) / F.col(seats)).otherwise(F.lit(0.0))
    banded = df.withColumns({"rows": rows, "total": total}).withColumns({"share": share, "slack": slack})
    low = F.least(F.greatest(F.floor(F.col("share") * (1 - F.col("slack"))) - 2, F.lit(0)), F.col(cap)).cast("long")
    high = F.least(F.floor(F.col("share") * (1 + F.col("slack"))) + 2, F.col(cap)).cast("long")
    banded = banded.withColumn("low", low).withColumn("high", F.greatest(high, F.col("low")))
    banded = banded.withColumn("open", F.col(seats) - F.sum("low").over(g))
    quotients = banded.withColumn("k", F.explode(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    best = Window.partitionBy(*group).orderBy((F.col(size) / (2 * F.col("k") + 1)).desc_nulls_last(), *tie, "k")
    given = quotients.withColumn("given", (F.col("k").isNotNull() & (F.row_number().over(best) <= F.col("open"))).cast("long"))
    keep = [c for c in df.columns]
    return given.groupBy(*keep, "low").agg(F.sum("given").alias("given")).withColumn(into, F.col("low") + F.col("given")).select(*keep, into)


def mix(docs: DataFrame, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target, taken."""
    sizes = materialise(docs.select("doc_id", "source", n_words(whole_text()).alias("size")), "sizes")
    return taken_words(sizes, sizes, seed, shard_docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as its words are taken, to the nearest whole pass.

    The columns of ``docs``, whatever their names, are unchanged; a row that is taken twice appears twice.
    """
    rows = docs.select("doc_id", "source", n_words(whole_text()).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    sizes = materialise(rows.drop("row"), "sizes")
    passes = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    taken = taken_words(sizes, rows, seed, shard_docs).select("row", passes.alias("passes")).where("passes > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("passes"))).alias("pass")).select("row.*")


def taken_words(sizes: DataFrame, rows: DataFrame, seed: int, shard_docs: int) -> DataFrame:
    """``rows`` with source_size, target and taken; ``sizes`` holds the doc_id, source and size of the same rows."""
    sources = materialise(source_targets(sizes), "targets")
    sources = sources.withColumn("shards", F.greatest(F.ceil(F.col("docs") / F.lit(shard_docs)), F.lit(1)).cast("long"))
    total = sources.agg(F.sum("source_size").alias("words"), F.count(F.lit(1)).alias("sources"), F.sum("shards").alias("shards")).first()
    block = max(1, (total["words"] or 0) // max(1, BLOCKS_PER_SOURCE * total["sources"], BLOCKS_PER_SHARD * (total["shards"] or 0)))
    sources = sources.withColumn("whole", F.col("target") >= REPEATS * F.col("source_size"))
    unit = F.least(F.lit(block), F.greatest(F.floor(F.col("source_size") / (SHARD_LEAST * F.col("shards"))), F.lit(1)))
    sources = sources.withColumn("unit", unit.cast("long"))
    everywhere = Window.partitionBy("all")
    whole = sources.where("whole").withColumn("blocks", F.lit(0).cast("long"))
    sources = sources.where("not whole").withColumn("all", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(everywhere) / F.lit(block)).cast("long"))
    sources = sources.withColumn("cap", F.floor(REPEATS * F.col("source_size") / F.lit(block)).cast("long"))
    sources = apportion(sources, ["all"], "target", "seats", "cap", "blocks", ["weight", F.col("source").asc_nulls_last()])
    sources = sources.withColumn("blocks", F.when(F.col("unit") < block, F.round(F.col("target") / F.col("unit")).cast("long")).otherwise(F.col("blocks")))
    sources = sources.select(*whole.columns).unionAll(whole)
    sources = materialise(sources.select(F.col("source").alias("of"), "source_size", "target", "blocks", "shards", "unit", "whole"), "source-blocks")

    def placed(df: DataFrame) -> DataFrame:
        joined = df.join(sources.select("of", "shards"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return joined.withColumn("drawn", _hash(F.lit(seed), F.col("doc_id"))).withColumn("shard", F.col("drawn") % F.col("shards"))

    shards = placed(sizes).groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    shards = shards.join(sources.drop("shards"), F.col("source").eqNullSafe(F.col("of")))
    shards = shards.withColumn("cap", F.floor(REPEATS * F.col("shard_size") / F.col("unit")).cast("long"))
    shards = apportion(shards, ["source"], "shard_size", "blocks", "cap", "quota", ["shard"])
    ring = F.greatest(F.ceil(F.col("shard_size") / F.col("unit")), F.lit(1)).cast("long")
    shards = shards.withColumn("words", F.when(F.col("whole"), REPEATS * F.col("shard_size")).otherwise(F.col("quota") * F.col("unit")))
    shards = shards.withColumn("start", F.col("unit") * (_hash(F.lit(seed), F.lit("start"), F.col("source"), F.col("shard")) % ring))
    shards = materialise(shards.select("of", F.col("shard").alias("of_shard"), "shard_size", "words", "start", "source_size", "target"), "quotas")

    seeded = Window.partitionBy("source", "shard").orderBy("drawn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rings = placed(rows).withColumn("to", F.sum("size").over(seeded)).withColumn("from", F.col("to") - F.col("size"))
    rings = rings.join(shards, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard")))

    def passed(x: Column) -> Column:
        """Words of this row among the first x words of the endless ring."""
        rest = F.least(F.greatest(x % F.col("shard_size") - F.col("from"), F.lit(0)), F.col("size"))
        return F.floor(x / F.col("shard_size")) * F.col("size") + rest

    taken = F.when(F.col("size") > 0, passed(F.col("start") + F.col("words")) - passed(F.col("start"))).otherwise(F.lit(0))
    return rings.withColumn("taken", taken.cast("long"))
