"""PAM scan and candidate-site extraction on both strands.

Tiles are cut into slices of a few dozen window starts.  For every slice the
places where the motif fits, on either strand, are one integer each: a bit
plane per motif code, shifted and ANDed.  Only the set bits become rows, so
the work per base is a few string steps of its slice and a bit test; window
texts are taken for true sites alone.  There is no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iupac import PAM_MASK, code_bits, plane, reverse_complement, reverse_complement_text
from ..sources.genome import TILE, pieces, tiles
from ..sources.inputs import Pam

#: Window starts of one slice; with a motif it fits one 63-bit integer.
SLICE = 32


def motif_mask(s: Column, motif: str, at: int) -> Column:
    """The window starts of a slice where the bases from ``at`` fit a motif: bit ``SLICE - 1 - i`` for start ``i``."""
    m = len(motif)
    if m > 63 - SLICE:
        raise ValueError(f"a PAM of more than {63 - SLICE} bases")
    part = F.substring(s, at + 1, SLICE + m - 1)
    planes = {c: code_bits(part, PAM_MASK[c], SLICE + m - 1) for c in set(motif) if c != "N"}
    every = F.lit((1 << SLICE) - 1).cast("bigint")
    return reduce(lambda a, b: a.bitwiseAND(b), [F.shiftright(planes[c], m - 1 - j) for j, c in enumerate(motif) if c != "N"], every)


def _starts(t: DataFrame, pam: Pam, size: int, at_fwd: int, at_rev: int, tile: int) -> DataFrame:
    """``(contig, strand, window0, win)``: windows of ``size`` bases, whole inside the contig, that hold the motif at the given place of a strand."""
    p = t.select("contig", "tile_start", F.posexplode(pieces(F.col("seq"), SLICE, size - 1)).alias("k", "s"))
    off = F.col("k") * SLICE
    p = p.select(
        "contig", (F.col("tile_start") + off).cast("bigint").alias("at"), "s",
        F.least(F.lit(tile) - off, F.char_length("s") - (size - 1)).alias("n"),  # starts that are the tile's own and whole
        motif_mask(F.col("s"), pam.motif, at_fwd).alias("fwd"),
        motif_mask(F.col("s"), reverse_complement_text(pam.motif), at_rev).alias("rev"),
    )
    # two places per start, one for each strand
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * SLICE - 1))).alias("e"))
    i, back = F.shiftright("e", 1), F.col("e").bitwiseAND(F.lit(1)) == 1
    bit = F.call_function("shiftright", F.when(back, F.col("rev")).otherwise(F.col("fwd")), F.lit(SLICE - 1) - i)
    p = p.where((bit.bitwiseAND(F.lit(1)) == 1) & (i < F.col("n")))
    return p.select("contig", F.when(back, F.lit("-")).otherwise(F.lit("+")).alias("strand"), (F.col("at") + i).alias("window0"), F.substring("s", i + 1, F.lit(size)).alias("win"))


def pam_starts(contigs: DataFrame, pam: Pam, tile: int = TILE, compat_edges: bool = False) -> DataFrame:
    """``(contig, strand, pam_start0)``: every place where the motif matches, 0-based, leftmost base.

    With ``compat_edges`` the last possible start of a contig is left out, as
    some older tools do.
    """
    found = _starts(tiles(contigs, pam.size - 1, tile), pam, pam.size, 0, 0, tile).select("contig", "strand", F.col("window0").alias("pam_start0"))
    if compat_edges:
        last = contigs.select("contig", (F.char_length("sequence") - pam.size).alias("last"))
        found = found.join(last, "contig").where(F.col("pam_start0") < F.col("last")).drop("last")
    return found


def extract_sites(contigs: DataFrame, pam: Pam, bmax: int = 0, tile: int = TILE, planes: bool = True, partitions: int | None = None) -> DataFrame:
    """Candidate sites of whole sequences, one row per strand; see ``sites_of_tiles``.

    ``partitions`` deals the tiles out, for inputs with fewer splits than cores.
    """
    t = tiles(contigs, pam.total + bmax - 1, tile)
    if partitions:
        t = t.repartition(partitions, "contig", "tile_start")
    return sites_of_tiles(t, pam, bmax, tile, planes)


def sites_of_tiles(t: DataFrame, pam: Pam, bmax: int = 0, tile: int = TILE, planes: bool = True) -> DataFrame:
    """Candidate sites, one row per strand, of tiles that overlap by a window less one.

    ``(contig, strand, window0, body, pam[, pa, pc, pg, pt])``: ``window0`` is
    the 0-based start of the window on the forward strand, ``body`` the guide
    bases and ``bmax`` more, nearest to the PAM first, ``pam`` the actual PAM
    as read on the site's strand.  Windows that hold an ``N`` or overrun the
    contig are no sites.
    """
    size = pam.total + bmax
    end = size - pam.size
    at_fwd, at_rev = (0, end) if pam.upstream else (end, 0)
    p = _starts(t, pam, size, at_fwd, at_rev, tile).where(~F.contains("win", F.lit("N")))
    p = p.select("contig", "strand", "window0", F.when(F.col("strand") == "-", reverse_complement(F.col("win"))).otherwise(F.col("win")).alias("w"))
    if pam.upstream:
        body, motif = F.substring("w", pam.size + 1, end), F.substring("w", 1, pam.size)
    else:
        body, motif = F.reverse(F.substring("w", 1, end)), F.substring("w", end + 1, pam.size)
    p = p.select("contig", "strand", "window0", body.alias("body"), motif.alias("pam"))
    return with_planes(p) if planes else p


def with_planes(sites: DataFrame) -> DataFrame:
    return sites.withColumns({f"p{b.lower()}": plane(F.col("body"), b) for b in "ACGT"})


def require_sites(sites: DataFrame, t: DataFrame, pam: Pam, tile: int = TILE) -> None:
    """Raises if a genome has no site although its PAM occurs, or has no PAM; looks for one row of each."""
    if sites.limit(1).count():
        return
    if _starts(t, pam, pam.size, 0, 0, tile).limit(1).count():
        raise ValueError("every PAM site was dropped: all overrun their contig or hold an N")
    raise ValueError(f"no PAM site of {pam.motif} in the genome")


def write_index(sites: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Sites as Parquet, sorted by contig and body inside a file.

    Files follow the partitions, not the contigs, of which a draft assembly has
    very many; a large contig is dealt over eight of them.
    """
    sites.repartition("contig", F.pmod(F.xxhash64("window0"), F.lit(8))).sortWithinPartitions("contig", "body").write.option("maxRecordsPerFile", rows_per_file).parquet(path)
