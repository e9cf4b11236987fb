"""Off-target search: near-match join, hit columns, duplicates and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.inputs import Budget, Guide, Pam
from .scripts import aligned_strings, near_match

KEY = ["chrom", "pos", "strand", "grna", "spacer"]


def bulge_type(dna: Column, rna: Column) -> Column:
    return F.when((dna > 0) & (rna > 0), F.lit("DNA,RNA")).when(dna > 0, F.lit("DNA")).when(rna > 0, F.lit("RNA")).otherwise(F.lit("X"))


def leftmost(pam: Pam, bmax: int) -> Column:
    """1-based leftmost base of the aligned target, PAM included, on either strand."""
    fwd_pam_last = F.col("window0") + (pam.guide_size + bmax) - F.col("used") + 1
    fwd = F.col("strand") == "+"
    at_left = F.col("window0") + 1
    return F.when(fwd, at_left if pam.upstream else fwd_pam_last).otherwise(fwd_pam_last if pam.upstream else at_left).cast("int")


def search(sites: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, bmax: int = 0) -> DataFrame:
    """Hits in the fixed column order, then ``guide_id`` and ``guide``; the score is null."""
    found = aligned_strings(near_match(sites, guides, pam, budget, bmax), pam)
    return found.select(
        F.col("contig").alias("chrom"), leftmost(pam, bmax).alias("pos"), "strand", "grna", "spacer", "mismatches",
        bulge_type(F.col("bulge_dna"), F.col("bulge_rna")).alias("bulge_type"), "bulge_dna", "bulge_rna",
        F.lit(None).cast("double").alias("cfd_score"), "guide_id", "guide",
    )


def deduplicate(hits: DataFrame) -> DataFrame:
    """One hit per place and alignment; a guard for merged inputs."""
    return hits.dropDuplicates(KEY)


def with_derived(hits: DataFrame) -> DataFrame:
    """Total edits, whether any bulge, and the locus text."""
    total = F.col("mismatches") + F.col("bulge_dna") + F.col("bulge_rna")
    return hits.withColumns({"total": total, "has_bulge": (F.col("bulge_dna") + F.col("bulge_rna")) > 0, "locus": F.format_string("%s:%d(%s)", "chrom", "pos", "strand")})


def same_site(hits: DataFrame) -> DataFrame:
    """Hits that are equal as values: place, strand and target; the one with the fewest edits stays."""
    total = F.col("mismatches") + F.col("bulge_dna") + F.col("bulge_rna")
    row = F.struct(total.alias("total"), *[F.col(c) for c in hits.columns])
    return hits.groupBy("chrom", "pos", "strand", "spacer").agg(F.min(row).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in hits.columns])
