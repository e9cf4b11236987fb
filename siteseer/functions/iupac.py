"""IUPAC nucleotide codes as column functions.

A code is a set of bases.  In a genome ``N`` is an unknown base and matches
nothing; in a PAM ``N`` is a wildcard.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bases of each IUPAC code.
CODES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG",
}
# One bit per base.
BITS = {"A": 1, "C": 2, "G": 4, "T": 8}
# Complements, base by base; U is read as T.
COMPLEMENT = ("ACGTRYMKHDBVSWUN", "TGCAYRKMDHVBSWAN")

MASK = {c: sum(BITS[b] for b in s) for c, s in CODES.items()}
CODE_OF_MASK = {m: c for c, m in MASK.items()} | {15: "N"}
PAM_MASK = MASK | {"N": 15}


def complement(c: Column) -> Column:
    return F.translate(c, *COMPLEMENT)


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def reverse_complement_text(s: str) -> str:
    return s.upper().translate(str.maketrans(*COMPLEMENT))[::-1]


def to_rna(c: Column) -> Column:
    return F.translate(c, "Tt", "Uu")


@lru_cache(None)
def matching(code: str) -> tuple[str, ...]:
    """Genome codes that share a base with a PAM or guide code, in code order."""
    return tuple(c for c in CODES if MASK[c] & PAM_MASK[code])


#: What a genome may hold, besides the codes.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ*-."


def code_bits(text: Column, mask: int, width: int) -> Column:
    """A bit per place, the first highest, set where the code there shares a base with ``mask``; places beyond the text are 0."""
    digits = "".join("1" if MASK.get(c, 0) & mask else "0" for c in LETTERS)
    return F.conv(F.rpad(F.translate(text, LETTERS, digits), width, "0"), 2, 10).cast("bigint")


def plane(body: Column, base: str) -> Column:
    """A bit per position, set where the code there holds ``base``; the first position is the highest bit."""
    codes = "".join(CODES) + "N"
    digits = "".join("1" if base in CODES.get(c, "") else "0" for c in codes)
    return F.conv(F.translate(body, codes, digits), 2, 10).cast("bigint")


def nibble(c: Column) -> Column:
    """The bit set of one code; 0 for ``N`` and anything unknown."""
    out = F.lit(0)
    for code, m in MASK.items():
        out = F.when(c == code, F.lit(m)).otherwise(out)
    return out


def code_of(mask: Column) -> Column:
    """The code of a bit set; all four bases give ``N``."""
    return F.translate(F.lower(F.hex(mask.cast("bigint"))), "123456789abcdef", "".join(CODE_OF_MASK[i] for i in range(1, 16)))


def contig_name(c: Column) -> Column:
    """Contig names begin with ``chr``."""
    return F.when(F.startswith(c, F.lit("chr")), c).otherwise(F.concat(F.lit("chr"), c))
