"""Nucleotide expressions: all of them Catalyst expressions, evaluated in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 9
SEED = 42


def letters(seq: Column) -> Column:
    """Upper case, with U read as T."""
    upper = F.upper(seq)
    return F.when(F.contains(upper, F.lit("U")), F.replace(upper, F.lit("U"), F.lit("T"))).otherwise(upper)


def resolved(seq: Column, name: Column, seed: int = SEED) -> Column:
    """Each ambiguous base becomes one of ACGT by a hash of seed, read name and 1-based position: always the same one."""
    base = letters(seq)

    def at(p: Column) -> Column:
        c = F.substring(base, p, F.lit(1))
        digit = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), p.cast("string"))), 1, 1)
        return F.when(c.isin("A", "C", "G", "T"), c).otherwise(F.substring(F.lit("ACGT"), (F.instr(F.lit("0123456789abcdef"), digit) - 1) % 4 + 1, F.lit(1)))

    whole = F.array_join(F.transform(F.sequence(F.lit(1), F.length(base)), at), "")
    return F.when(base.rlike("[^ACGT]"), whole).otherwise(base)


def complement(seq: Column) -> Column:
    return F.translate(letters(seq), "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def tail_code(seq: Column, k: int = 8) -> Column:
    """The last k bases, read backwards, as a base-4 number."""
    return F.conv(F.translate(F.reverse(F.right(seq, F.lit(k))), "ACGT", "0123"), 4, 10).cast("long")


def decoded(code: Column, k: int = 8) -> Column:
    """The k bases, in reading order, of a :func:`tail_code`: two bits a base, the last base in the highest."""
    bases = (F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k))
    return F.concat(*bases)


def mapq(n_hits: Column, n_errors: Column) -> Column:
    return F.when((n_hits > 1) | (n_errors >= 40), F.lit(0)).otherwise(40 - n_errors).cast("long")


def flag(strand: Column, hit: Column) -> Column:
    """0x10 on the reverse strand (strand 0), 0x100 for all but the first hit."""
    return (F.when(strand == 0, F.lit(16)).otherwise(F.lit(0)) + F.when(hit != 1, F.lit(256)).otherwise(F.lit(0))).cast("long")


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance of two sequences of equal length."""
    return F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda p: F.substring(a, p, F.lit(1)) != F.substring(b, p, F.lit(1))))
