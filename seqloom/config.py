"""Settings of a mapping run and its command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from seqloom.functions.seq import MIN_LENGTH


@dataclass
class MapperConfig:
    reads: list[str] = field(default_factory=list)
    genome: str = ""
    outputs: list[str] = field(default_factory=list)
    collapsed: str = ""
    complexity: int = 6
    errors: int = 2
    hits: int = 5
    unified: bool = False
    seed: int = 42

    def validated(self) -> MapperConfig:
        """Self, or ValueError: reads, a genome and outputs are needed, one output for all or one for each input."""
        if not self.reads or not self.genome or not self.outputs:
            raise ValueError("at least one -r, one -g and one -o are needed")
        if self.unified and len(self.outputs) != 1:
            raise ValueError("-u needs exactly one -o")
        if not self.unified and len(self.outputs) != len(self.reads):
            raise ValueError("as many -o as -r are needed")
        if not 0 <= self.errors < MIN_LENGTH:
            raise ValueError(f"-e must lie between 0 and {MIN_LENGTH - 1}")
        return self


def parse(argv: list[str] | None = None) -> MapperConfig:
    p = argparse.ArgumentParser(prog="seqloom", description="Map small-RNA reads to a genome.")
    p.add_argument("-r", dest="reads", action="append", default=[], help="FASTQ file of a sample (repeat)")
    p.add_argument("-g", dest="genome", default="", help="FASTA file of the genome")
    p.add_argument("-o", dest="outputs", action="append", default=[], help="output folder of a sample (repeat)")
    p.add_argument("-c", dest="collapsed", default="", help="folder for collapsed reads")
    p.add_argument("-f", dest="complexity", type=int, default=6, help="most occurrences of a triplet")
    p.add_argument("-e", dest="errors", type=int, default=2, help="most errors")
    p.add_argument("-n", dest="hits", type=int, default=5, help="most hits")
    p.add_argument("-s", dest="seed", type=int, default=42, help="seed for ambiguous bases")
    p.add_argument("-t", dest="threads", type=int, default=1, help="accepted and ignored: Spark decides")
    p.add_argument("-u", dest="unified", action="store_true", help="one output for all samples")
    p.add_argument("-v", action="version", version="seqloom 0.1.0")
    found = vars(p.parse_args(argv))
    found.pop("threads")
    return MapperConfig(**found).validated()
