"""Genomes as overlapping tiles, from FASTA files or from tables of sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.iupac import contig_name

#: Bases that start in one tile.
TILE = 512


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(file, contig, header, sequence)``, one record per file, upper case.

    Blank lines are dropped, the first line is the header, later header lines
    are ignored.  A file without header, name or sequence raises an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("ls"))
    head = F.coalesce(F.get("ls", F.lit(0)), F.lit(""))
    seq = F.upper(F.array_join(F.filter(F.slice("ls", 2, 1 << 30), lambda x: ~F.startswith(x, F.lit(">"))), ""))
    raw = raw.select("file", head.alias("head"), F.when(F.size("ls") > 1, seq).otherwise(F.lit("")).alias("sequence"))
    name = F.trim(F.substring("head", 2, 1 << 30))
    bad = F.when(~F.startswith("head", F.lit(">")), F.lit("no header in ")).when(name == "", F.lit("an empty header in ")).when(F.col("sequence") == "", F.lit("no sequence in "))
    ok = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("file")))).otherwise(name)
    return raw.select("file", ok.alias("header"), "sequence").select("file", contig_name(F.element_at(F.split("header", "\\s+"), 1)).alias("contig"), "header", "sequence")


def _fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    v = F.upper(F.trim("value"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("raw"), v.alias("v")).where("v <> ''")


def fasta_names(spark: SparkSession, path: str) -> DataFrame:
    """``(file, contig, header)`` of FASTA files, read in splits; a file without header, name or sequence raises an error."""
    lines = _fasta_lines(spark, path)
    first = lines.groupBy("file").agg(F.min_by("raw", F.struct("block", "id")).alias("head"), F.count_if(~F.startswith("v", F.lit(">"))).alias("held"))
    name = F.element_at(F.split(F.trim(F.substring("head", 2, 1 << 30)), "\\s+"), 1)
    bad = F.when(~F.startswith("head", F.lit(">")), F.lit("no header in ")).when(name == "", F.lit("an empty header in ")).when(F.col("held") == 0, F.lit("no sequence in "))
    return first.select("file", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("file")))).otherwise(contig_name(name)).alias("contig"), F.trim(F.substring("head", 2, 1 << 30)).alias("header"))


def _line_tiles(seq: DataFrame, key: list[str], overlap: int, tile: int) -> DataFrame:
    """``(*key, tile_start, seq)`` from lines of sequences: ``n`` bases ``v`` at ``pos``."""
    k = F.sequence(F.greatest(F.floor((F.col("pos") - overlap) / tile), F.lit(0)), F.floor((F.col("pos") + F.col("n") - 1) / tile))
    p = seq.select(*key, "pos", "n", "v", F.explode(k).alias("k")).withColumn("tile_start", F.col("k") * tile)
    lo, hi = F.greatest("pos", "tile_start"), F.least(F.col("pos") + F.col("n"), F.col("tile_start") + (tile + overlap))
    piece = F.struct(lo.alias("at"), F.substring("v", (lo - F.col("pos") + 1).cast("int"), (hi - lo).cast("int")).alias("s"))
    return p.groupBy(*key, "tile_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["s"]), "").alias("seq"))


def read_fasta_tiles(spark: SparkSession, path: str, overlap: int, tile: int = TILE) -> DataFrame:
    """``(contig, tile_start, seq)`` straight from the lines of FASTA files.

    Files are read in splits, so a chromosome is never one row: each line
    learns its offset from the lengths of the lines before it in its split and
    of the splits before, and gives its pieces to the tiles they lie in.
    """
    seq = _fasta_lines(spark, path).where(~F.startswith("v", F.lit(">"))).withColumn("n", F.char_length("v").cast("bigint"))
    within = Window.partitionBy("file", "block").orderBy("id")
    sums = seq.groupBy("file", "block").agg(F.sum("n").alias("m"))
    base = sums.withColumn("base", F.sum("m").over(Window.partitionBy("file").orderBy("block")) - F.col("m")).drop("m")
    seq = seq.withColumn("off", F.sum("n").over(within) - F.col("n")).join(base, ["file", "block"]).withColumn("pos", F.col("base") + F.col("off"))
    t = _line_tiles(seq, ["file"], overlap, tile)
    # by way of the names, so that a file without a sequence shows
    return fasta_names(spark, path).join(t, "file", "left").select("contig", "tile_start", "seq")


def _fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """The sequence lines of FASTA files of many records: ``(rec, header, contig, pos, n, v)``, ``pos`` being the line's place in its record.

    A record is known by its header line.  What a split lacks, the header
    before it and the bases since, comes from one row a split.  Lines without
    a header, and a header without a name, raise an error.
    """
    lines = _fasta_lines(spark, path).withColumn("top", F.startswith("v", F.lit(">"))).withColumn("n", F.when(F.col("top"), 0).otherwise(F.char_length("v")).cast("bigint"))
    rec = F.when(F.col("top"), F.struct("block", "id", F.col("raw").alias("head")))
    lines = lines.withColumn("own", F.last(rec, True).over(Window.partitionBy("file", "block").orderBy("id")))
    within = Window.partitionBy("file", "block", "own").orderBy("id")
    lines = lines.withColumn("off", F.sum("n").over(within) - F.col("n"))
    # of each split its last record, and the bases it holds of it
    ends = lines.groupBy("file", "block").agg(F.max_by(F.struct("own", (F.col("off") + F.col("n")).alias("bases")), "id").alias("end"))
    before = Window.partitionBy("file").orderBy("block")
    ends = ends.select("file", "block", "end.own", "end.bases").withColumn("rec", F.last("own", True).over(before))
    ends = ends.withColumn("sum", F.sum("bases").over(Window.partitionBy("file", "rec").orderBy("block")))
    ends = ends.select("file", "block", F.lag("rec").over(before).alias("carried"), F.coalesce(F.lag("sum").over(before), F.lit(0)).alias("base"))
    lines = lines.where(~F.col("top")).join(ends, ["file", "block"])
    lines = lines.withColumn("rec", F.coalesce("own", "carried")).withColumn("pos", F.when(F.col("own").isNull(), F.col("base")).otherwise(0) + F.col("off"))
    header = F.trim(F.substring("rec.head", 2, 1 << 30))
    bad = F.when(F.col("rec").isNull(), F.lit("no header in ")).when(header == "", F.lit("an empty header in "))
    header = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.col("file")))).otherwise(header)
    lines = lines.select(F.struct("file", "rec.block", "rec.id").alias("rec"), header.alias("header"), "pos", "n", "v")
    return lines.withColumn("contig", contig_name(F.element_at(F.split("header", "\\s+"), 1)))


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """``(contig, header, sequence)`` of FASTA files of any number of records, upper case; for sequences that fit a row."""
    r = _fasta_records(spark, path).groupBy("rec").agg(F.first("contig").alias("contig"), F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("ls"))
    return r.select("contig", "header", F.array_join(F.transform("ls", lambda x: x["v"]), "").alias("sequence"))


def read_fasta_record_tiles(spark: SparkSession, path: str, overlap: int, tile: int = TILE) -> DataFrame:
    """``(contig, tile_start, seq)`` of FASTA files of any number of records; see ``read_fasta_tiles``."""
    return _line_tiles(_fasta_records(spark, path), ["rec", "contig"], overlap, tile).select("contig", "tile_start", "seq")


def pieces(text: Column, size: int, overlap: int) -> Column:
    """A text as an array of pieces of ``size`` characters and ``overlap`` more, in one pass over it."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"), 1)


def tiles(contigs: DataFrame, overlap: int, tile: int = TILE, contig: str = "contig", sequence: str = "sequence") -> DataFrame:
    """``(contig, tile_start, seq)``: ``tile`` bases and ``overlap`` more, so that each window of up to ``overlap + 1`` bases lies whole in the tile where it starts.

    For sequences that fit a row; chromosomes come as tiles from ``read_fasta_tiles``.
    """
    cut = contigs.select(F.col(contig).alias("contig"), F.posexplode(pieces(F.col(sequence), tile, overlap)).alias("k", "seq"))
    return cut.select("contig", (F.col("k").cast("bigint") * tile).alias("tile_start"), "seq")


def contig_check(contigs: DataFrame) -> DataFrame:
    """Contigs that occur more than once."""
    return contigs.groupBy("contig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def letters_to_bases(text: Column) -> Column:
    """A deterministic stand-in genome: the letters a-z of a text, folded onto the four bases."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def text_genome(documents: DataFrame) -> DataFrame:
    """``(contig, sequence)`` of a table of documents."""
    return documents.select(F.concat(F.lit("chr"), F.col("doc_id").cast("string")).alias("contig"), letters_to_bases(F.col("text")).alias("sequence"))


def assemble(tiles_: DataFrame, tile: int = TILE) -> DataFrame:
    """Whole sequences from tiles; for the FASTA sink, where a contig is one record."""
    core = tiles_.withColumn("seq", F.substring("seq", 1, tile))
    return core.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile_start", "seq"))), lambda x: x["seq"]), "").alias("sequence"))
