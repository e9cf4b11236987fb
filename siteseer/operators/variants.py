"""Variant enrichment: SNPs merged into a genome as IUPAC codes, indels as windows.

Positions of variants are 1-based.  Allele numbers count from 1, as genotypes
do; carriers are samples whose genotype lists the number.  Symbolic alleles
and ``*`` are dropped.  Several SNPs at one place unite their alleles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iupac import code_of, nibble
from ..sources.genome import TILE

#: Bases on each side of an indel.
FLANK = 50
FIRST_INDEX = 2


def pair_contigs(contigs: DataFrame, variant_contigs: DataFrame) -> DataFrame:
    """``(contig, has_variants)``; a contig named twice on a side, or variants without a contig, raise an error."""
    a = contigs.groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    b = variant_contigs.groupBy("contig").agg(F.count(F.lit(1)).alias("m"))
    j = a.join(b, "contig", "full")
    bad = F.when(F.col("n").isNull(), F.lit("variants without a contig: ")).when((F.col("n") > 1) | (F.col("m") > 1), F.lit("a contig given twice: "))
    return j.select(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("contig")))).otherwise(F.col("contig")).alias("contig"), F.col("m").isNotNull().alias("has_variants"))


def with_variants(contigs: DataFrame, variants: DataFrame) -> DataFrame:
    return contigs.join(variants.select("contig").distinct(), "contig", "left_semi")


def without_variants(contigs: DataFrame, variants: DataFrame) -> DataFrame:
    return contigs.join(variants.select("contig").distinct(), "contig", "left_anti")


def passing(variants: DataFrame, keep: bool = False) -> DataFrame:
    """Only records that passed their filters, or all with ``keep``."""
    return variants if keep else variants.where("filter = 'PASS'")


def split_alleles(variants: DataFrame) -> DataFrame:
    """One row per allele with ``alt``, ``allele`` (from 1) and ``kind`` (snp or indel)."""
    rows = variants.select(*[c for c in variants.columns if c != "alt"], F.posexplode(F.split("alt", ",")).alias("p", "alt"))
    rows = rows.withColumn("allele", F.col("p") + 1).drop("p")
    rows = rows.where(~F.contains("alt", F.lit("<")) & ~F.contains("alt", F.lit("[")) & ~F.contains("alt", F.lit("]")) & ~F.col("alt").isin("*", ".", ""))
    snp = (F.char_length("alt") == 1) & (F.char_length("ref") == 1)
    return rows.withColumn("kind", F.when(snp, F.lit("snp")).otherwise(F.lit("indel")))


def allele_frequency(alleles: DataFrame) -> DataFrame:
    """Adds ``af``: the allele's entry of the record's own AF list, as text."""
    values = F.split(F.regexp_extract("info", "(?:^|;)AF=([^;]*)", 1), ",")
    return alleles.withColumn("af", F.nullif(F.get(values, F.col("allele") - 1), F.lit("")))


def carriers(alleles: DataFrame, samples: list[str], with_genotype: bool = False) -> DataFrame:
    """Adds ``carriers``: sorted samples that carry the allele, joined by commas."""
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    gt = lambda g: F.element_at(F.split(g, ":"), 1)
    pairs = F.zip_with(names, "genotypes", lambda s, g: F.struct(s.alias("s"), gt(F.coalesce(g, F.lit(""))).alias("g")))
    own = F.filter(pairs, lambda x: F.array_contains(F.split(x["g"], "[/|]"), F.col("allele").cast("string")))
    text = F.transform(own, lambda x: F.concat(x["s"], F.lit(":"), x["g"]) if with_genotype else x["s"])
    return alleles.withColumn("carriers", F.array_join(F.array_sort(text), ","))


def variant_id(alleles: DataFrame) -> DataFrame:
    return alleles.withColumn("vid", F.concat(F.col("contig"), F.lit("-"), F.col("pos").cast("string"), F.lit("-"), F.col("ref"), F.lit("/"), F.col("alt")))


def snp_codes(alleles: DataFrame) -> DataFrame:
    """``(contig, pos, ref, code)``: the IUPAC code of the reference and all SNP alleles at a place."""
    s = alleles.where("kind = 'snp'")
    mask = F.bit_or(nibble(F.upper("ref")).bitwiseOR(nibble(F.upper("alt"))))
    return s.groupBy("contig", "pos").agg(F.min(F.upper("ref")).alias("ref"), mask.alias("mask")).select("contig", "pos", "ref", code_of(F.col("mask")).alias("code"))


def apply_snps(tiles_: DataFrame, codes: DataFrame, tile: int = TILE, check: bool = True, overlap: int = 0) -> DataFrame:
    """Tiles with SNP codes written in, the ``overlap`` bases beyond each tile included.

    Only tiles that hold a SNP are touched: a tile collects its SNPs as an
    array and is rebuilt between them.  With ``check`` a reference base that
    the genome does not hold raises an error.
    """
    extra = -(-overlap // tile)
    at = F.col("pos") - 1
    home = F.floor(at / tile).cast("long")
    spread = codes.select("contig", at.alias("p"), "ref", "code", F.explode(F.sequence(F.greatest(home - extra, F.lit(0)), home)).alias("k"))
    per = spread.select("contig", (F.col("k") * tile).alias("tile_start"), F.struct((F.col("p") - F.col("k") * tile).cast("int").alias("i"), "ref", "code").alias("v")).groupBy("contig", "tile_start").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    j = tiles_.join(per, ["contig", "tile_start"], "left")
    inside = F.filter("vs", lambda v: v["i"] < F.char_length("seq"))
    before = lambda v, i: F.when(i == 0, F.lit(0)).otherwise(F.get("vs", i - 1)["i"] + 1)
    held = lambda v: F.substring("seq", v["i"] + 1, F.lit(1))
    ok = lambda v: nibble(held(v)).bitwiseAND(nibble(v["ref"])) != 0
    code = (lambda v: F.when(ok(v), v["code"]).otherwise(F.raise_error(F.lit("a reference base differs from the genome")))) if check else (lambda v: v["code"])
    parts = F.transform("vs", lambda v, i: F.concat(F.substring("seq", before(v, i) + 1, v["i"] - before(v, i)), code(v)))
    tail = F.element_at("vs", -1)["i"] + 1
    whole = F.concat(F.array_join(parts, ""), F.substring("seq", tail + 1, F.char_length("seq")))
    j = j.withColumn("vs", inside)
    return j.select("contig", "tile_start", F.when(F.size("vs") > 0, whole).otherwise(F.col("seq")).alias("seq"))


def snp_dictionary(alleles: DataFrame) -> DataFrame:
    """``(key, value)``: place, and its alleles as ``carriers;ref,alt;id;af`` joined by ``$``."""
    s = alleles.where("kind = 'snp'")
    entry = F.concat_ws(";", F.col("carriers"), F.concat_ws(",", "ref", "alt"), F.col("vid"), F.coalesce("af", F.lit("")))
    key = F.concat_ws(",", F.col("contig"), F.col("pos").cast("string"))
    return s.groupBy(key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("allele", "alt", entry.alias("e")))), lambda x: x["e"]), "$").alias("value"))


def indel_windows(alleles: DataFrame, tiles_: DataFrame, flank: int = FLANK, need_carriers: bool = True, tile: int = TILE) -> DataFrame:
    """Reference and altered windows around indels that have carriers, from the tiles they lie in.

    Adds ``refseq`` and ``indelseq``; the reference bases are checked.  An
    indel asks for the tiles under its window, and their pieces are put
    together again; a contig is never brought to an indel.
    """
    i = alleles.where("kind = 'indel'")
    if need_carriers:
        i = i.where("carriers <> ''")
    cols = i.columns
    # equal rows are one request, counted
    i = i.groupBy(*cols).agg(F.count(F.lit(1)).alias("times"))
    at = F.col("pos") - 1
    left, right = F.greatest(at - flank, F.lit(0)), at + F.char_length("ref") + flank
    ask = i.select("*", left.alias("lo"), right.alias("hi")).withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor((F.col("hi") - 1) / tile))))
    ask = ask.withColumn("tile_start", F.col("k") * tile)
    core = tiles_.select("contig", F.col("tile_start").cast("bigint").alias("tile_start"), F.substring("seq", 1, tile).alias("core"))
    a, z = F.greatest("lo", "tile_start"), F.least("hi", F.col("tile_start") + tile)
    part = F.substring("core", (a - F.col("tile_start") + 1).cast("int"), (z - a).cast("int"))
    got = ask.join(core, ["contig", "tile_start"], "left").select(*cols, "times", "lo", F.struct("tile_start", part.alias("s")).alias("piece"))
    around = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: F.coalesce(x["s"], F.lit(""))), "")
    j = got.groupBy(*cols, "times", "lo").agg(around.alias("around"))
    before, n = (at - F.col("lo")).cast("int"), F.char_length("ref")
    lead, there, rest = F.substring("around", F.lit(1), before), F.substring("around", before + 1, n), F.substring("around", before + n + 1, F.lit(flank))
    ref = F.when(there == F.upper("ref"), there).otherwise(F.raise_error(F.lit("a reference allele differs from the genome")))
    j = j.select(*cols, F.concat(lead, ref, rest).alias("refseq"), F.concat(lead, F.upper("alt"), rest).alias("indelseq"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("copy"))
    return j.drop("copy")


def indel_layout(windows: DataFrame) -> DataFrame:
    """Adds ``idx`` (from 2), ``start`` and ``stop``: windows laid end to end in a synthetic contig.

    One window function per contig; indels of a contig are few against its bases.
    """
    w = Window.partitionBy("contig").orderBy("pos", "ref", "allele", "alt")
    n = F.char_length("indelseq")
    run = F.sum(n + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - (n + 1)
    rows = windows.withColumns({"idx": F.row_number().over(w) + (FIRST_INDEX - 1), "start": run.cast("long")})
    return rows.withColumn("stop", F.col("start") + n)


def indel_log(layout: DataFrame) -> DataFrame:
    """The log columns of laid-out indels."""
    ext = F.concat(F.col("contig"), F.lit("_"), F.col("start").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit("_"), F.col("idx").cast("string"))
    desc = F.concat_ws("_", F.col("contig"), F.col("pos").cast("string"), "ref", "alt")
    return layout.select(ext.alias("CHR"), F.col("carriers").alias("SAMPLES"), F.col("id").alias("rsID"), F.col("af").alias("AF"), desc.alias("indel"), F.concat_ws(",", F.col("start").cast("string"), F.col("stop").cast("string")).alias("FAKEPOS"), "refseq")


def fake_contig(layout: DataFrame) -> DataFrame:
    """``(contig, sequence)``: altered windows joined by ``N``, in layout order."""
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "indelseq"))), lambda x: x["indelseq"]), "N")
    return layout.groupBy("contig").agg(seq.alias("sequence"))


def fake_lines(layout: DataFrame) -> DataFrame:
    """``(contig, place, line)``: the same contig as rows of lines, each window followed by ``N`` but the last."""
    last = F.max("idx").over(Window.partitionBy("contig"))
    return layout.select("contig", F.col("idx").cast("bigint").alias("place"), F.concat("indelseq", F.when(F.col("idx") == last, F.lit("")).otherwise(F.lit("N"))).alias("line"))
