"""Sort orders of hits.  Ties of the first keys are broken by place and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIES = ["chrom", "pos", "strand", "grna", "spacer"]


def edit_distance_keys():
    total = F.col("mismatches") + F.col("bulge_dna") + F.col("bulge_rna")
    score = F.round("cfd_score", 2).desc_nulls_last()
    return [total, F.col("mismatches"), F.col("bulge_dna") + F.col("bulge_rna"), score, *[F.col(c) for c in TIES]]


def coordinate_keys():
    return [F.col(c) for c in TIES]


def by_edit_distance(hits: DataFrame) -> DataFrame:
    return hits.orderBy(*edit_distance_keys())


def by_coordinates(hits: DataFrame) -> DataFrame:
    """Contigs as text: chr10 before chr2."""
    return hits.orderBy(*coordinate_keys())


def top(hits: DataFrame, k: int) -> DataFrame:
    return by_edit_distance(hits).limit(k)
