"""Interval-overlap annotation: an equi-join on nested bins with an exact overlap test.

Bins come in levels, each eight times as wide as the one below.  A feature
lies in one bin, the narrowest that holds it whole, so a track is never
multiplied, however long its features are; a hit looks into the bins that it
touches on each level that a track uses.  A pair meets once, so nothing has to
be made distinct.  Labels are put in track order after the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a bin of the lowest level, and the number of levels; the highest holds any contig.
BIN, LEVELS = 4096, 9
#: Tracks up to so many measured bytes travel to every task; larger ones are shuffled by bin.
BROADCAST_BYTES = 64 << 20


def footprint(spacer: Column) -> Column:
    """Bases of the genome under a target."""
    return F.char_length(F.replace(spacer, F.lit("-"), F.lit("")))


def hit_interval(hits: DataFrame, minus_pos: str = "rightmost") -> DataFrame:
    """Adds ``start0`` and ``end0``, 0-based half-open.

    ``minus_pos`` says which end of the target a position on the minus strand
    names: ``rightmost`` by convention of the annotation tables, ``leftmost``
    for hits as the search reports them.
    """
    fp = footprint(F.col("spacer"))
    left = F.col("pos") - 1
    if minus_pos == "rightmost":
        left = F.when(F.col("strand") == "-", F.col("pos") - 1 - fp).otherwise(F.col("pos") - 1)
    elif minus_pos != "leftmost":
        raise ValueError("minus_pos is rightmost or leftmost")
    return hits.withColumns({"start0": left.cast("long"), "end0": (left + fp).cast("long")})


def _width(level: int) -> int:
    return BIN * 8**level


def _home(start: Column, end: Column) -> Column:
    """The lowest level on which an interval lies in one bin."""
    out = F.lit(LEVELS - 1)
    for i in reversed(range(LEVELS - 1)):
        out = F.when(F.floor(start / _width(i)) == F.floor((end - 1) / _width(i)), F.lit(i)).otherwise(out)
    return out


def overlaps(spans: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(row_id, track, label, start, ord)`` of every overlapping pair; ``spans`` has ``row_id, chrom, start0, end0``."""
    t = tracks.where("start < end").withColumn("level", _home(F.col("start"), F.col("end")))
    width = F.element_at(F.array(*[F.lit(_width(i)) for i in range(LEVELS)]), F.col("level") + 1)
    t = t.select("chrom", "track", "label", "start", "end", "ord", "level", F.floor(F.col("start") / width).alias("bin"))
    # a row per level that the tracks use, and what the tracks weigh as rows
    row = F.lit(100) + F.octet_length("chrom") + F.octet_length("track") + F.coalesce(F.octet_length("label"), F.lit(0))
    stat = t.groupBy("level").agg(F.sum(row).alias("bytes")).collect()
    if sum(r["bytes"] for r in stat) <= BROADCAST_BYTES:
        t = F.broadcast(t)
    used = sorted(r["level"] for r in stat) or [0]
    bins = lambda i: F.transform(F.sequence(F.floor(F.col("start0") / _width(i)), F.floor((F.col("end0") - 1) / _width(i))), lambda b: F.struct(F.lit(i).alias("level"), b.alias("bin")))
    s = spans.where("start0 < end0").select("row_id", "chrom", "start0", "end0", F.explode(F.concat(*[bins(i) for i in used])).alias("b"))
    s = s.select("row_id", "chrom", "start0", "end0", "b.level", "b.bin")
    meet = (F.col("start0") < F.col("end")) & (F.col("start") < F.col("end0"))
    return s.join(t, ["chrom", "level", "bin"]).where(meet).select("row_id", "track", "label", "start", "ord")


def annotate(hits: DataFrame, tracks: DataFrame, names: list[str], minus_pos: str = "rightmost") -> DataFrame:
    """Hits with one column per track: distinct labels in track order, joined by commas, else ``NA``.

    ``hits`` needs a unique ``row_id``.  Hits are shuffled once, to the labels
    that were found; pairs travel as row numbers and labels.
    """
    if len(set(names)) != len(names):
        raise ValueError("track names must differ")
    spans = hit_interval(hits, minus_pos).select("row_id", "chrom", "start0", "end0")
    found = overlaps(spans, tracks)
    own = lambda n: F.collect_list(F.when(F.col("track") == n, F.struct("start", "ord", "label")))
    text = lambda xs: F.when(F.size(xs) > 0, F.array_join(F.array_distinct(F.transform(F.array_sort(xs), lambda x: x["label"])), ","))
    labels = found.groupBy("row_id").agg(*[text(own(n)).alias(f"label_{i}") for i, n in enumerate(names)])
    out = hits.join(labels, "row_id", "left")
    return out.select(*hits.columns, *[F.coalesce(f"label_{i}", F.lit("NA")).alias(n) for i, n in enumerate(names)])


def track_names(n: int, names: list[str] | None = None) -> list[str]:
    if names is None:
        return [f"annotation{i + 1}" for i in range(n)]
    if len(names) != n:
        raise ValueError(f"{n} tracks, {len(names)} names")
    return list(names)
