"""Guide profiles: counts over the columns of the alignments of each guide.

All counters come from two aggregates: ``events`` (per guide, kind of column,
mismatch level, bulge channel, position and base) and ``totals`` (per guide,
mismatch level and bulge sizes).  Both combine before the shuffle, and their
results are as small as the counters themselves; the rest is arithmetic on
them.  Positions count guide bases, from 0; mismatch levels are capped at the
budget.  An ambiguous target base that matched in the search still counts as a
mismatched column here, as its text differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.inputs import Budget, Pam


def _body(c: str, pam: Pam):
    col = F.col(c)
    return F.substring(col, F.lit(pam.size + 1), F.char_length(col) - pam.size) if pam.upstream else F.substring(col, F.lit(1), F.char_length(col) - pam.size)


def walk(hits: DataFrame, pam: Pam, budget: Budget) -> DataFrame:
    """One row per deviating column: ``(guide_id, kind M/D/R, mm, dna, rna, pos, base)``."""
    h = hits.select("guide_id", F.least("mismatches", F.lit(budget.mismatches)).alias("mm"), "bulge_dna", "bulge_rna", _body("grna", pam).alias("g"), _body("spacer", pam).alias("t"))

    def column(i):
        g, t = F.upper(F.substring("g", i, F.lit(1))), F.upper(F.substring("t", i, F.lit(1)))
        pos = F.char_length(F.replace(F.substring("g", F.lit(1), i - 1), F.lit("-"), F.lit("")))
        kind = F.when(g == "-", F.lit("D")).when(t == "-", F.lit("R")).when((g != t) & (g != "N") & (t != "N"), F.lit("M"))
        return F.struct(kind.alias("kind"), pos.alias("pos"), t.alias("base"))

    # a gap after the last guide base has no position
    cols = F.filter(F.transform(F.sequence(F.lit(1), F.char_length("g")), column), lambda x: x["kind"].isNotNull() & (x["pos"] < pam.guide_size))
    return h.select("guide_id", "mm", "bulge_dna", "bulge_rna", F.explode(cols).alias("c")).select("guide_id", "c.kind", "mm", "bulge_dna", "bulge_rna", "c.pos", "c.base")


def events(hits: DataFrame, pam: Pam, budget: Budget) -> DataFrame:
    w = walk(hits, pam, budget)
    return w.groupBy("guide_id", "kind", "mm", (F.col("bulge_dna") > 0).alias("in_dna"), (F.col("bulge_rna") > 0).alias("in_rna"), "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def totals(hits: DataFrame, budget: Budget) -> DataFrame:
    return hits.groupBy("guide_id", F.least("mismatches", F.lit(budget.mismatches)).alias("mm"), "bulge_dna", "bulge_rna").agg(F.count(F.lit(1)).alias("n"))


def guide_grid(guides: DataFrame, pam: Pam) -> DataFrame:
    """Every position of every guide, so that counters have their zeros."""
    return guides.select("guide_id").distinct().select("guide_id", F.explode(F.sequence(F.lit(0), F.lit(pam.guide_size - 1))).alias("pos"))


def position_counters(ev: DataFrame, guides: DataFrame, pam: Pam) -> DataFrame:
    """Per guide and position: mismatches without bulges, in all hits, in DNA and RNA hits, and bulges."""
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    m, d, r = F.col("kind") == "M", F.col("in_dna"), F.col("in_rna")
    agg = ev.groupBy("guide_id", "pos").agg(
        n(m & ~d & ~r).alias("pos_mm_count"), n(m).alias("pos_mm_complete"), n(m & d).alias("pos_mm_in_dna"), n(m & r).alias("pos_mm_in_rna"),
        n(F.col("kind") == "D").alias("pos_bulge_dna"), n(F.col("kind") == "R").alias("pos_bulge_rna"),
    )
    return guide_grid(guides, pam).join(agg, ["guide_id", "pos"], "left").na.fill(0)


def extended_counters(ev: DataFrame) -> DataFrame:
    """``(guide_id, mm, symbol, pos, n)``: mismatches by target base, and bulges, in long form."""
    m = (F.col("kind") == "M") & F.col("base").isin("A", "C", "G", "T")
    symbol = F.when(m, F.col("base")).when(F.col("kind") == "D", F.lit("DNA")).when(F.col("kind") == "R", F.lit("RNA"))
    return ev.withColumn("symbol", symbol).where("symbol IS NOT NULL").groupBy("guide_id", "mm", "symbol", "pos").agg(F.sum("n").alias("n"))


def extended_totals(ev: DataFrame) -> DataFrame:
    """``(guide_id, mm, pos, n)``: mismatches of any base by position and level."""
    return extended_counters(ev).where("symbol NOT IN ('DNA', 'RNA')").groupBy("guide_id", "mm", "pos").agg(F.sum("n").alias("n"))


def off_targets(tot: DataFrame, channel: str) -> DataFrame:
    """``(guide_id, mm, size, n)`` of a channel: ``plain``, ``dna``, ``rna`` or ``complete``.

    A hit with both kinds of bulge counts in both bulge channels.
    """
    if channel == "plain":
        rows, size = tot.where("bulge_dna = 0 AND bulge_rna = 0"), F.lit(0)
    elif channel == "complete":
        rows, size = tot, F.lit(0)
    else:
        rows, size = tot.where(f"bulge_{channel} > 0"), F.col(f"bulge_{channel}")
    return rows.groupBy("guide_id", "mm", size.alias("size")).agg(F.sum("n").alias("n"))


def summary(tot: DataFrame, guides: DataFrame, channel: str) -> DataFrame:
    """``(guide_id, ont, offt, mm_per_offt)`` of a channel.

    On-targets have no mismatch; off-targets of the bulge channels are all
    other hits; the mean is over off-targets and 0 without any.
    """
    agg = off_targets(tot, channel).groupBy("guide_id").agg(F.sum(F.when(F.col("mm") == 0, F.col("n")).otherwise(0)).alias("ont"), F.sum(F.when(F.col("mm") > 0, F.col("n")).otherwise(0)).alias("offt"), F.sum(F.col("mm") * F.col("n")).alias("edits"))
    agg = guides.select("guide_id").distinct().join(agg, "guide_id", "left").na.fill(0)
    return agg.select("guide_id", "ont", "offt", F.when(F.col("offt") > 0, F.round(F.col("edits") / F.col("offt"), 6)).otherwise(F.lit(0.0)).alias("mm_per_offt"))


def merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Element-wise sum of counters from several runs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))
