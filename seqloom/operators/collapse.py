"""Reads to distinct sequences: counts by sample, highest qualities, ordered names; low-complexity filter; dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from seqloom.functions.seq import MIN_LENGTH, SEED, resolved
from seqloom.operators.prefixes import trie
from seqloom.session import materialise


#: Longest read whose qualities are maximised in one aggregate of a number a position.
WIDE = 128


def arrival(reads: DataFrame) -> tuple[str, ...]:
    """The columns that order a sample's reads: the place in the file where that is known, then the name."""
    return ("at", "name") if "at" in reads.columns else ("name",)


def normalised(reads: DataFrame, seed: int = SEED) -> DataFrame:
    """sample, name, s, qual (and at): the sequence with U as T and ambiguous bases resolved."""
    more = [c for c in reads.columns if c == "at"]
    return reads.select("sample", "name", resolved(F.col("seq"), F.col("name"), seed).alias("s"), "qual", *more)


def long_enough(reads: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    return reads.where(F.length("s") >= least)


def observed(reads: DataFrame, name: str = "reads") -> tuple[DataFrame, Observation]:
    """``reads``, and what is counted of them while they pass: n_reads, max_length, n_ambiguous (raw sequences with one)."""
    seen = Observation(name)
    raw = "seq" if "seq" in reads.columns else "s"
    ambiguous = F.count(F.when(F.upper(raw).rlike("[^ACGTU]"), 1))
    return reads.observe(seen, F.count(F.lit(1)).alias("n_reads"), F.max(F.length(raw)).alias("max_length"), ambiguous.alias("n_ambiguous")), seen


def _counts(samples: int) -> list[Column]:
    return [F.count(F.when(F.col("sample") == k, 1)).alias(f"c{k}") for k in range(samples)]


def counts(reads: DataFrame, samples: int) -> DataFrame:
    """s, c0, c1, ...: one partial aggregate a sample, one shuffle on the sequence."""
    return reads.groupBy("s").agg(*_counts(samples))


def _with_qualities(reads: DataFrame, more: list[Column]) -> DataFrame:
    """s, ``more`` (aggregates) and qual, for reads of at most the longest length.

    The highest quality of each position is a number of its own, so a very common sequence is folded before the shuffle
    and there is only that one. Reads over ``WIDE`` bases are maximised by position and put together after a second.
    """
    longest = reads.agg(F.max(F.length("s"))).first()[0] or 0
    if longest <= WIDE:
        best = [F.max(F.ascii(F.substring("qual", p, 1))).alias(f"q{p}") for p in range(1, longest + 1)]
        folded = reads.groupBy("s").agg(*more, *best)
        # places beyond a sequence's end have code 0
        qual = F.concat(F.lit(""), *(F.when(F.col(f"q{p}") > 0, F.char(F.col(f"q{p}"))).otherwise("") for p in range(1, longest + 1)))
        return folded.select("s", *(c for c in folded.columns if c != "s" and c[0] != "q"), qual.alias("qual"))
    each = reads.select("s", F.posexplode(F.split("qual", "")).alias("p", "q")).groupBy("s", "p").agg(F.max("q").alias("q"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "q"))), lambda x: x["q"]), "")
    by_position = each.groupBy("s").agg(joined.alias("qual"))  # bounded by the read's length
    return by_position if not more else reads.groupBy("s").agg(*more).join(by_position, "s")


def qualities(reads: DataFrame) -> DataFrame:
    """s, qual: the highest quality at each position over all reads and samples."""
    return _with_qualities(reads, [])


def names(reads: DataFrame) -> DataFrame:
    """s, sample, names: in order of arrival, a row for each sequence and sample that has it."""
    listed = F.array_sort(F.collect_list(F.struct(*arrival(reads))))
    return reads.groupBy("s", "sample").agg(F.transform(listed, lambda x: x["name"]).alias("names"))


def collapsed(reads: DataFrame, samples: int) -> DataFrame:
    """s, counts by sample, qual: one shuffle on the sequence."""
    return _with_qualities(reads, _counts(samples))


def triplets(seq: Column) -> Column:
    """The 3-mers of the reversed sequence, in order."""
    return F.regexp_extract_all(F.reverse(seq), F.lit("(?=(...))"), F.lit(1))


def triplet_counts(sequences: DataFrame) -> DataFrame:
    """s, triplet, n.

    Rows are grouped by sequence alone; a triplet is counted by what the list of them loses without it.
    """
    each = sequences.groupBy("s").agg(F.count(F.lit(1)).alias("times")).select("s", "times", triplets(F.col("s")).alias("all"))
    each = each.select("s", "times", F.array_join("all", ",").alias("listed"), F.explode(F.array_distinct("all")).alias("triplet"))
    lost = F.length("listed") - F.length(F.replace("listed", F.col("triplet"), F.lit("")))
    return each.select("s", "triplet", (F.col("times") * (lost / 3).cast("long")).alias("n"))


def is_low_complexity(seq: Column, most: int = 6) -> Column:
    """Whether some triplet of the reversed sequence that ends after its eighth base is the (most+1)th of its kind so far.

    Read forwards that is a triplet with at least nine bases from it on and ``most`` more of its kind to its right. The
    expression steps from one to the next; its atomic groups never go back, so a sequence costs at most its length a start.
    """
    more = f"(?>[ACGT][ACGT]*?(?=\\1)){{{most}}}" if most else ""
    return seq.rlike(f"(?=([ACGT]{{3}})[ACGT]{{6}}){more}")


def dump(sequences: DataFrame, samples: int) -> DataFrame:
    """n, record: FASTQ records of collapsed reads, in the order of the reversed sequence.

    The ranks come from a range-partitioned sort and offsets of its partitions, not from a window over all rows.
    """
    ordered = sequences.withColumn("back", F.reverse("s")).repartitionByRange(F.col("back")).withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "ranges")  # so that both uses see the same partitions
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    ranked = ordered.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("back"))).join(F.broadcast(sizes), "part")
    n = (F.col("k") + F.col("earlier")).cast("long")
    suffix = F.concat_ws("_", *(F.col(f"c{k}").cast("string") for k in range(samples)))
    record = F.concat(F.lit("@read"), n.cast("string"), F.lit("__"), suffix, F.lit("\n"), F.col("s"), F.lit("\n+\n"), F.col("qual"))
    return ranked.select(n.alias("n"), record.alias("record"))


def stats(reads: DataFrame) -> DataFrame:
    """One row: reads, longest (before filters), distinct sequences long enough."""
    kept = F.when(F.length("s") >= MIN_LENGTH, F.col("s"))
    return reads.agg(F.count(F.lit(1)).alias("n_reads"), F.max(F.length("s")).cast("long").alias("max_length"), F.countDistinct(kept).alias("n_sequences"))


def prefix_stats(sequences: DataFrame) -> DataFrame:
    """depth, children, nodes: how many prefixes of reversed sequences have so many one-base extensions."""
    return trie(sequences).where("kind = 'children'").select(F.col("a").alias("depth"), F.col("b").alias("children"), F.col("n").alias("nodes"))


def branch_lengths(sequences: DataFrame) -> DataFrame:
    """length, branches: how many leaves and branching prefixes have a run of so many one-child prefixes right above."""
    return trie(sequences).where("kind = 'runs'").select(F.col("a").alias("length"), F.col("n").alias("branches"))


def read_nodes(sequences: DataFrame) -> DataFrame:
    """One row: nodes, read_nodes: prefixes below the root, and those that are a whole sequence."""
    nodes = F.sum(F.when((F.col("kind") == "nodes") & (F.col("a") > 0), F.col("n")))
    strings = F.sum(F.when(F.col("kind") == "strings", F.col("n")))
    return trie(sequences).agg(F.coalesce(nodes, F.lit(0)).alias("nodes"), F.coalesce(strings, F.lit(0)).alias("read_nodes"))
