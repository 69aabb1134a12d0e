"""The whole mapping run: reads and a genome to hits and SAM records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.config import MapperConfig, parse
from seqloom.operators import collapse, hits, mapping
from seqloom.session import materialise, scratch
from seqloom.sources import fastq, sam


@dataclass
class Mapped:
    reads: DataFrame
    counts: DataFrame
    qualities: DataFrame
    hits: DataFrame
    limited: DataFrame
    contigs: DataFrame

    def lines(self) -> DataFrame:
        return sam.lines(self.reads, self.hits, self.limited, self.qualities, self.contigs)

    def unified(self) -> DataFrame:
        return sam.unified(self.reads, self.counts, self.hits, self.limited, self.qualities, self.contigs)


def mapped(reads: DataFrame, contigs: DataFrame, samples: int, complexity: int = 6, errors: int = 2, most_hits: int = 5, seed: int = 42) -> Mapped:
    """Normalise, filter, collapse and map. Reads of low complexity, and unmappable ones, leave no record."""
    kept = collapse.long_enough(collapse.normalised(reads, seed)).where(~collapse.is_low_complexity(F.col("s"), complexity))
    kept = materialise(kept, "reads")
    whole = materialise(collapse.collapsed(kept, samples), "collapsed")
    places = mapping.best_places(whole.select("s"), contigs, errors)
    found, limited = hits.reported(places, contigs, most_hits, errors)
    return Mapped(kept, whole.drop("qual"), whole.select("s", "qual"), hits.with_cigar(materialise(found, "hits")), limited, contigs)


def run(spark: SparkSession, config: MapperConfig) -> None:
    """From FASTQ and FASTA files to SAM text, and the collapsed reads where they are asked for.

    What is written in between to the shared folder is deleted at the end.
    """
    with scratch(spark):
        reads = fastq.scan(spark, config.reads, places=True)
        contigs = materialise(fastq.genome(spark, config.genome), "contigs")
        result = mapped(reads, contigs, len(config.reads), config.complexity, config.errors, config.hits, config.seed)
        if config.collapsed:
            dumped = collapse.dump(result.counts.join(result.qualities, "s"), len(config.reads))
            dumped.orderBy("n").select(F.col("record").alias("value")).write.text(config.collapsed)
        if config.unified:
            sam.write(result.unified(), contigs, config.outputs[0])
            return
        lines = materialise(result.lines(), "lines")
        for k, path in enumerate(config.outputs):
            sam.write(lines.where(F.col("sample") == k).drop("sample"), contigs, path)


def main(argv: list[str] | None = None) -> None:
    run(SparkSession.builder.appName("seqloom").getOrCreate(), parse(argv))


if __name__ == "__main__":
    main()
