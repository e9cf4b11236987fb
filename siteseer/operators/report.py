"""Report tables over annotated hits: deviation logo and feature counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYMBOLS = ["A", "C", "G", "T", "D", "R"]
#: Features below this share of the largest count at a ceiling are left out.
SHARE = 0.1


def guide_key(grna: Column) -> Column:
    return F.replace(grna, F.lit("-"), F.lit(""))


def guide_keys(rows: DataFrame) -> DataFrame:
    return rows.select(guide_key(F.col("grna")).alias("guide")).distinct()


def logo_counts(rows: DataFrame) -> DataFrame:
    """``(guide, position, symbol, n)``: deviations by guide position (from 1), PAM columns included; the rows of a guide at position 0."""
    r = rows.select(guide_key(F.col("grna")).alias("guide"), F.col("grna").alias("g"), F.col("spacer").alias("t"))

    def column(i):
        g, t = F.upper(F.substring("g", i, F.lit(1))), F.upper(F.substring("t", i, F.lit(1)))
        pos = F.char_length(F.replace(F.substring("g", F.lit(1), i - 1), F.lit("-"), F.lit(""))) + 1
        sym = F.when(g == "-", F.lit("D")).when(t == "-", F.lit("R")).when((g != t) & (g != "N") & t.isin(*"ACGT"), t)
        return F.struct(pos.alias("position"), sym.alias("symbol"))

    steps = F.transform(F.sequence(F.lit(1), F.least(F.char_length("g"), F.char_length("t"))), column)
    steps = F.filter(steps, lambda x: x["symbol"].isNotNull() & (x["position"] <= F.char_length("guide")))
    row = F.array(F.struct(F.lit(0).alias("position"), F.lit("").alias("symbol")))
    ev = r.select("guide", F.explode(F.concat(row, F.coalesce(steps, F.array().cast("array<struct<position:int,symbol:string>>")))).alias("x"))
    return ev.groupBy("guide", "x.position", "x.symbol").agg(F.count(F.lit(1)).alias("n"))


def logo_matrix(rows: DataFrame, per_guide: bool = False) -> DataFrame:
    """``([guide,] position, A, C, G, T, D, R)``: shares of the rows, or of a guide's rows, that deviate so; zeros included.

    Positions go up to the longest guide.  The rows are read once: what they
    count for is as small as the matrix.
    """
    by = ["guide"] if per_guide else []
    counts = logo_counts(rows).groupBy(*by, "position", "symbol").agg(F.sum("n").alias("n"), F.max(F.char_length("guide")).alias("len"))
    m = counts.groupBy(*by).agg(F.sum(F.when(F.col("position") == 0, F.col("n"))).alias("rows"), F.max("len").alias("len"), F.collect_list(F.struct("position", "symbol", "n")).alias("cells"))
    m = m.where("len > 0").select(*by, "rows", "cells", F.explode(F.sequence(F.lit(1), "len")).alias("position"))
    cell = lambda s: F.get(F.filter("cells", lambda x: (x["position"] == F.col("position")) & (x["symbol"] == s)), F.lit(0))["n"]
    return m.select(*by, "position", *[(F.coalesce(cell(s), F.lit(0)) / F.col("rows")).alias(s) for s in SYMBOLS])


def template(rows: DataFrame) -> str:
    """The most frequent guide text, the least of them on a tie."""
    r = rows.groupBy(guide_key(F.col("grna")).alias("g")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "g").first()
    return r["g"] if r else ""


def strip_pam(matrix: DataFrame, pattern: str) -> DataFrame:
    """Drops positions where the template has ``N`` and renumbers; all stay if none would."""
    keep = [i + 1 for i, c in enumerate(pattern) if c.upper() != "N"] or list(range(1, len(pattern) + 1))
    renumber = F.array_position(F.array(*[F.lit(i) for i in keep]), F.col("position")).cast("int")
    return matrix.where(F.col("position").isin(*keep)).withColumn("position", renumber)


def strip_pam_by_guide(matrix: DataFrame) -> DataFrame:
    """As ``strip_pam`` for a matrix per guide, each by its own guide as template."""
    base = lambda p: F.upper(F.substring("guide", p, F.lit(1)))
    kept = F.filter(F.sequence(F.lit(1), F.char_length("guide")), lambda p: base(p) != "N")
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.sequence(F.lit(1), F.char_length("guide")))
    place = F.array_position(kept, F.col("position")).cast("int")
    return matrix.withColumn("position", place).where("position > 0")


def radar_counts(rows: DataFrame, column: str, max_mm: int, per_guide: bool = False, share: float = SHARE) -> DataFrame:
    """``([guide,] ceiling, label, n, part)``: rows per label with at most so many mismatches.

    A cell counts whole, lists included; ``NA`` does not.  Labels with a tenth
    or less of the ceiling's largest count are left out; ``part`` is the share
    of the labels that stay.  Without any annotated row the result is empty.
    """
    by = [F.lit("all").alias("guide")] if not per_guide else [guide_key(F.col("grna")).alias("guide")]
    c = rows.where((F.col(column) != "NA") & (F.col("mismatches") <= max_mm)).groupBy(*by, F.col(column).alias("label"), "mismatches").agg(F.count(F.lit(1)).alias("n"))
    # each count reaches all ceilings from its own on: a small table from here
    c = c.select("guide", "label", "n", F.explode(F.sequence(F.greatest("mismatches", F.lit(0)), F.lit(max_mm))).alias("ceiling")).groupBy("guide", "ceiling", "label").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("guide", "ceiling")
    c = c.withColumn("most", F.max("n").over(w)).where(F.col("n") > share * F.col("most"))
    c = c.withColumn("part", F.col("n") / F.sum("n").over(w))
    return c.select(*(["guide"] if per_guide else []), "ceiling", "label", "n", "part")


def safe_name(s: str) -> str:
    """A file name for a guide."""
    return re.sub(r"[^0-9A-Za-z]", "_", s) or "guide"
