"""Cutting-frequency score: a product of penalties over alignment columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iupac import complement
from ..sources.inputs import Pam


@dataclass(frozen=True)
class CfdModel:
    """Penalties by ``rX:dY,column`` and factors by the last two PAM bases; both are small tables."""

    mismatch: dict[str, float]
    pam: dict[str, float]


def read_model(spark: SparkSession, mismatch_csv: str, pam_csv: str, limit: int = 10_000) -> CfdModel:
    """Two CSV tables of key and value; one of more than ``limit`` rows is no penalty table and raises an error."""

    def load(path: str) -> dict[str, float]:
        rows = spark.read.csv(path, schema="k string, v double", quote='"').where("v IS NOT NULL").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"more than {limit} penalties in {path}")
        return {r["k"]: r["v"] for r in rows}

    return CfdModel(load(mismatch_csv), load(pam_csv))


def _map(d: dict[str, float]) -> Column:
    if not d:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for k, v in sorted(d.items()) for x in (F.lit(k), F.lit(float(v)))])


def cfd(guide_body: Column, target_body: Column, pam_pair: Column, model: CfdModel) -> Column:
    """Score of aligned bodies.  A gap in the first column gives 0; other gaps and unknown keys cost nothing."""
    g, t = F.translate(F.upper(guide_body), "T", "U"), F.translate(F.upper(target_body), "T", "U")
    table = _map(model.mismatch)

    def step(acc, i):
        x, y = F.substring(g, i, F.lit(1)), F.substring(t, i, F.lit(1))
        key = F.concat(F.lit("r"), x, F.lit(":d"), complement(y), F.lit(","), i.cast("string"))
        gap = F.when(i == 1, F.lit(0.0)).otherwise(F.lit(1.0))
        return acc * F.when(x == y, F.lit(1.0)).when((x == "-") | (y == "-"), gap).otherwise(F.coalesce(F.element_at(table, key), F.lit(1.0)))

    body = F.aggregate(F.sequence(F.lit(1), F.char_length(g)), F.lit(1.0), step)
    unequal = F.char_length(g) != F.char_length(t)
    return F.when(unequal, F.raise_error(F.lit("aligned bodies differ in length")).cast("double")).otherwise(body * F.coalesce(F.element_at(_map(model.pam), F.upper(pam_pair)), F.lit(1.0)))


def score_hits(hits: DataFrame, model: CfdModel, pam: Pam | None = None) -> DataFrame:
    """Fills ``cfd_score`` (two decimals) where the PAM's system has such a score, else leaves it null."""
    if pam is not None and not pam.scored:
        return hits.withColumn("cfd_score", F.lit(None).cast("double"))
    cut = lambda c: F.substring(c, F.lit(1), F.char_length(c) - 3)
    return hits.withColumn("cfd_score", F.round(cfd(cut(F.col("grna")), cut(F.col("spacer")), F.right("spacer", F.lit(2)), model), 2))
