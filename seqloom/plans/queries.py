"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import seq
from seqloom.operators import collapse, hits, mapping
from seqloom.plans import pipeline
from seqloom.session import fresh_path, materialise
from seqloom.sources import fastq, fixtures, sam

SAMPLES = 3


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.long_enough(collapse.normalised(fixtures.reads(spark, sf_dir)))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("s").distinct()


def normalize(spark, sf_dir):
    return collapse.normalised(fixtures.reads(spark, sf_dir))


def revcomp(spark, sf_dir):
    n = collapse.normalised(fixtures.reads(spark, sf_dir))
    return n.select("name", seq.reverse_complement(F.col("s")).alias("rc"), seq.complement(F.col("s")).alias("c"), F.reverse("qual").alias("back_qual"))


def kmer_code(spark, sf_dir):
    return _kept(spark, sf_dir).select("name", seq.tail_code(F.col("s")).alias("code"))


def filter_length(spark, sf_dir):
    return _kept(spark, sf_dir).select("sample", "name", "s")


def read_stats(spark, sf_dir):
    return collapse.stats(collapse.normalised(fixtures.reads(spark, sf_dir)))


def collapse_counts(spark, sf_dir):
    return collapse.counts(_kept(spark, sf_dir), SAMPLES)


def collapse_quality(spark, sf_dir):
    return collapse.qualities(_kept(spark, sf_dir))


def collapse_names(spark, sf_dir):
    return collapse.names(_kept(spark, sf_dir)).select("s", "sample", F.array_join("names", " ").alias("names"))


def triplet_counts(spark, sf_dir):
    return collapse.triplet_counts(_sequences(spark, sf_dir))


def low_complexity(spark, sf_dir):
    return _sequences(spark, sf_dir).where(collapse.is_low_complexity(F.col("s"), 6))


def low_complexity_f3(spark, sf_dir):
    return _sequences(spark, sf_dir).where(collapse.is_low_complexity(F.col("s"), 3))


def collapsed_dump(spark, sf_dir):
    kept = materialise(_kept(spark, sf_dir).where(~collapse.is_low_complexity(F.col("s"), 6)), "kept")
    return collapse.dump(collapse.collapsed(kept, SAMPLES), SAMPLES)


def prefix_stats(spark, sf_dir):
    return collapse.prefix_stats(_sequences(spark, sf_dir))


def branch_lengths(spark, sf_dir):
    return collapse.branch_lengths(_sequences(spark, sf_dir))


def read_nodes(spark, sf_dir):
    return collapse.read_nodes(_sequences(spark, sf_dir))


def genome_contigs(spark, sf_dir):
    return fixtures.contigs(spark, sf_dir)


def sam_header(spark, sf_dir):
    return sam.header(fixtures.contigs(spark, sf_dir))


def _places(spark, sf_dir, errors: int = 2) -> DataFrame:
    return mapping.best_places(fixtures.planted(spark, sf_dir).select(F.col("seq").alias("s")), fixtures.contigs(spark, sf_dir), errors)


def _at(errors: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        return _places(spark, sf_dir, errors).where(F.col("n_errors") == errors).select("s", "rid", "st", "start", F.col("glen").cast("long").alias("glen"))

    return query


def map_reads_e0(spark, sf_dir):
    found = mapping.best_places(_sequences(spark, sf_dir), fixtures.contigs(spark, sf_dir), 0)
    return found.select("s", "rid", "st", "start")


def _reads_at(errors: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        found = mapping.best_places(_sequences(spark, sf_dir), fixtures.contigs(spark, sf_dir), errors)
        return found.where(F.col("n_errors") == errors).select("s", "rid", "st", "start", F.col("glen").cast("long").alias("glen"))

    return query


def best_stratum(spark, sf_dir):
    return _places(spark, sf_dir).groupBy("s").agg(F.min("n_errors").cast("long").alias("n_errors"), F.count(F.lit(1)).alias("places"))


def _raw(spark, sf_dir) -> DataFrame:
    return materialise(hits.positioned(mapping.intervals(mapping.with_indels(_places(spark, sf_dir))), fixtures.contigs(spark, sf_dir)), "raw")


def nhits_raw(spark, sf_dir):
    return _raw(spark, sf_dir).select("s", "n_hits_raw").distinct()


def too_many_hits(spark, sf_dir):
    return hits.over_limit(_raw(spark, sf_dir), 1).select("s", "nh", F.col("nm").cast("long").alias("nm"))


def hit_positions(spark, sf_dir):
    return _raw(spark, sf_dir).select("s", "rid", "st", "pos", F.col("glen").cast("long").alias("glen"), "n_indels")


def _reported(spark, sf_dir) -> DataFrame:
    return hits.flagged(hits.deduplicated(hits.within_limit(_raw(spark, sf_dir), 5)))


def hits_dedup(spark, sf_dir):
    return _reported(spark, sf_dir).select("s", "rid", "st", "pos", F.col("glen").cast("long").alias("glen"), "n_indels", "nh")


def hit_index(spark, sf_dir):
    return _reported(spark, sf_dir).select("s", "rid", "pos", "st", "hi")


def mapq_flag(spark, sf_dir):
    return _reported(spark, sf_dir).select("s", "rid", "pos", "flag", "mapq")


def cigar(spark, sf_dir):
    return hits.with_cigar(_reported(spark, sf_dir)).select("s", "rid", "pos", "st", "cigar")


def cigar_single(spark, sf_dir):
    return hits.with_cigar(_reported(spark, sf_dir).where("n_errors <= 1")).select("s", "rid", "pos", "st", "cigar")


def _mapped(spark, sf_dir) -> pipeline.Mapped:
    return pipeline.mapped(fixtures.planted(spark, sf_dir), fixtures.contigs(spark, sf_dir), SAMPLES)


def sam_lines(spark, sf_dir):
    return _mapped(spark, sf_dir).lines()


def sam_unified(spark, sf_dir):
    return _mapped(spark, sf_dir).unified()


def sam_text(spark, sf_dir):
    found = _mapped(spark, sf_dir).lines()
    return found.select("sample", sam.text(found).alias("line"))


def fastq_scan(spark, sf_dir):
    """Reads written as FASTQ text by Spark, a folder a sample, then read back by byte ranges."""
    path = fresh_path(spark, "fastq")
    record = F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual"))
    fixtures.reads(spark, sf_dir).select("sample", record.alias("value")).write.partitionBy("sample").text(path)
    return fastq.scan(spark, [f"{path}/sample={k}" for k in range(SAMPLES)], chunk=1 << 20).select("name", "seq", "qual")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (
        normalize, revcomp, kmer_code, filter_length, read_stats, collapse_counts, collapse_quality, collapse_names, triplet_counts, low_complexity,
        low_complexity_f3, collapsed_dump, prefix_stats, branch_lengths, read_nodes, genome_contigs, sam_header, map_reads_e0, best_stratum, nhits_raw, too_many_hits, hit_positions,
        hits_dedup, hit_index, mapq_flag, cigar, cigar_single, sam_lines, sam_unified, sam_text, fastq_scan,
    )
    return {f.__name__: f for f in plain} | {f"map_e{e}": _at(e) for e in range(3)} | {f"map_reads_e{e}": _reads_at(e) for e in (1, 2)}
