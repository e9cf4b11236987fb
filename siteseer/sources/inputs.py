"""PAMs, guides and edit budgets: small inputs that are checked on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iupac import CODES, reverse_complement_text

# Cas systems by PAM motif, for PAMs before and after the guide.
UPSTREAM_SYSTEMS = {
    "Cas12a": ["TTN", "TTTN", "TYCV", "TATV", "TTTV", "TTTR", "ATTN", "TTTA", "TCTA", "TCCA", "CCCA", "YTTV", "TTYN"],
    "CasX": ["TTCN"],
    "SaCas9": ["NNGRRT", "NNNRRT"],
}
DOWNSTREAM_SYSTEMS = {
    "SpCas9": ["NGG", "NGA", "NRG", "NGC"],
    "xCas9": ["NGK", "NGN", "NNG"],
}
SCORED_SYSTEMS = {"SpCas9", "xCas9"}


@dataclass(frozen=True)
class Pam:
    """A PAM motif; ``upstream`` PAMs stand before the guide."""

    motif: str
    guide_size: int
    upstream: bool = False

    def __post_init__(self):
        if not self.motif or set(self.motif) - set(CODES) - {"N"}:
            raise ValueError(f"not a PAM motif: {self.motif!r}")
        if self.guide_size < 1:
            raise ValueError("a guide needs at least one base")

    @property
    def size(self) -> int:
        return len(self.motif)

    @property
    def total(self) -> int:
        return self.size + self.guide_size

    @property
    def cas_system(self) -> str:
        """The nuclease that a motif is known for, on its side of the guide, else ``unknown``."""
        known = UPSTREAM_SYSTEMS if self.upstream else DOWNSTREAM_SYSTEMS
        return next((name for name, motifs in known.items() if self.motif in motifs), "unknown")

    @property
    def scored(self) -> bool:
        """Whether the cutting-frequency score is defined for it."""
        return self.cas_system in SCORED_SYSTEMS

    @classmethod
    def parse(cls, line: str) -> Pam:
        """``PATTERN SIZE``; a negative size marks an upstream PAM."""
        parts = line.split()
        if len(parts) != 2:
            raise ValueError("a PAM line has a pattern and a size")
        pattern, size = parts[0].upper(), int(parts[1])
        if size == 0 or abs(size) >= len(pattern):
            raise ValueError(f"PAM size {size} does not fit {pattern!r}")
        motif = pattern[:-size] if size < 0 else pattern[-size:]
        return cls(pattern[:-size] if size < 0 else motif, len(pattern) - abs(size), size < 0)


def read_pam(spark: SparkSession, path: str) -> Pam:
    lines = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    if len(lines) != 1:
        raise ValueError("a PAM file has one line")
    return Pam.parse(lines[0]["value"])


@dataclass(frozen=True)
class Guide:
    guide_id: int
    sequence: str

    @property
    def reverse_complement(self) -> str:
        return reverse_complement_text(self.sequence)


def check_guides(sequences: Iterable[str], pam: Pam, with_slot: bool = True) -> list[Guide]:
    """Guides in input order; duplicates stay.  With ``with_slot`` the PAM slot, all ``N``, is cut off."""
    out = []
    for i, s in enumerate(sequences):
        s = s.strip().upper()
        if with_slot:
            slot, s = (s[: pam.size], s[pam.size :]) if pam.upstream else (s[-pam.size :], s[: -pam.size])
            if slot != "N" * pam.size:
                raise ValueError(f"guide {i}: the PAM slot must be all N")
        if len(s) != pam.guide_size:
            raise ValueError(f"guide {i}: {len(s)} bases, the PAM asks for {pam.guide_size}")
        if set(s) - set(CODES):
            raise ValueError(f"guide {i}: not a nucleotide sequence")
        out.append(Guide(i, s))
    if not out:
        raise ValueError("no guides")
    return out


def read_guides(spark: SparkSession, path: str, pam: Pam, limit: int = 100_000) -> list[Guide]:
    """One guide per line, files by name and lines in order; more than ``limit`` raise an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} guides")
    return check_guides([r["value"] for r in sorted(rows, key=lambda r: (r["file"], r["line"]))], pam)


@dataclass(frozen=True)
class Budget:
    """How many edits a hit may have; ``single``: one kind of bulge per hit."""

    mismatches: int = 0
    dna: int = 0
    rna: int = 0
    single: bool = False

    def __post_init__(self):
        if min(self.mismatches, self.dna, self.rna) < 0:
            raise ValueError("budgets cannot be negative")

    def check(self, pam: Pam, bmax: int) -> None:
        if self.mismatches + self.dna + self.rna > pam.guide_size:
            raise ValueError("the budget exceeds the guide")
        if self.dna > bmax:
            raise ValueError(f"the index holds {bmax} extra bases, the budget asks for {self.dna} DNA bulges")


def guides_frame(spark: SparkSession, guides: list[Guide]) -> DataFrame:
    return spark.createDataFrame([(g.guide_id, g.sequence) for g in guides], "guide_id int, guide string").withColumn("reverse_complement", F.reverse(F.translate("guide", "ACGT", "TGCA")))
