"""Writers: hit tables, profiles, genomes.

Hit tables are written by Spark in parallel, as sorted parts.  Genomes are
written a file per contig, or a file per partition where contigs are many, line
by line, so no contig is held whole.  Profile
tables hold one row per guide, so they are collected (guides are bounded) and
written as single text files with the fixed layouts.  All paths are Spark's:
a file system that the cluster knows, not the driver's disk.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles
from .inputs import Budget, Guide, Pam
from .tracks import HIT_COLUMNS

# Column order of the older targets layout.
LEGACY_COLUMNS = ["bulge_type", "grna", "target", "chrom", "pos", "strand", "mismatches", "bulge_size", "total"]
OUTPUT_MODES = ("targets", "profile", "both")


def score_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c)).otherwise(F.lit("NA"))


def scored_layout(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS[:-1], score_text(F.col("cfd_score")).alias("cfd_score"))


def plain_layout(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS[:-1])


def legacy_layout(hits: DataFrame) -> DataFrame:
    size = F.col("bulge_dna") + F.col("bulge_rna")
    return hits.select("bulge_type", "grna", F.col("spacer").alias("target"), "chrom", "pos", "strand", "mismatches", size.alias("bulge_size"), (F.col("mismatches") + size).alias("total"))


#: Row formatters by name; any function from hits to the columns to write will do.
LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {"scored": scored_layout, "plain": plain_layout, "legacy": legacy_layout}


def layout_of(layout: str | Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    if callable(layout):
        return layout
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {sorted(LAYOUTS)}, or a function")
    return LAYOUTS[layout]


def write_tsv(df: DataFrame, path: str, single_file: bool = False, header: bool = True) -> int:
    """Tab-separated text in sorted parts, each with the header; ``single_file`` brings all rows into one.  Returns the rows written."""
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out = out.coalesce(1) if single_file else out
    out.write.mode("error").csv(path, sep="\t", header=header, quote="\x00", emptyValue="", nullValue="NA")
    return int(seen.get["rows"])


def annotated_name(path: str) -> str:
    """``hits.tsv`` becomes ``hits.annotated.tsv``."""
    p = Path(path)
    return str(p.with_name(p.stem + ".annotated.tsv"))


def write_fasta(contigs: DataFrame, path: str) -> None:
    """One ``>header`` and one sequence line per contig, a part file per task; for sequences that fit a row."""
    contigs.select(F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("error").text(path)


def write_fasta_lines(lines: DataFrame, path: str) -> None:
    """FASTA files of many records, from ``(contig, place, line)`` with a line at place 0 for each: as many files as partitions.

    A contig is sorted and streamed by one task, and its lines follow its header.
    """
    value = F.when(F.col("place") == 0, F.concat(F.lit(">"), "contig", F.lit("\n"), "line")).otherwise(F.col("line"))
    lines.repartition("contig").sortWithinPartitions("contig", "place").select(value.alias("value")).write.mode("error").text(path)


def write_contig_files(lines: DataFrame, headers: DataFrame, path: str, names: dict[str, str]) -> dict[str, str]:
    """A FASTA file per contig, from ``(contig, place, line)`` and ``(contig, header)``; returns the files by contig.

    A contig is sorted and streamed by one task.  ``names`` gives file names;
    one entry per contig, as does the renaming on the driver.
    """
    spark = lines.sparkSession
    top = headers.join(lines.select("contig").distinct(), "contig", "left_semi").select("contig", F.lit(-1).cast("bigint").alias("place"), F.concat(F.lit(">"), "header").alias("value"))
    rows = top.unionByName(lines.select("contig", F.col("place").cast("bigint").alias("place"), F.col("line").alias("value")))
    rows.repartition("contig").sortWithinPartitions("contig", "place").select("contig", "value").write.mode("error").partitionBy("contig").text(path)
    fs, Path_ = _file_system(spark, path)
    out = {}
    for d in fs.listStatus(Path_(path)):
        key = d.getPath().getName()
        if not key.startswith("contig="):
            continue
        contig = unquote(key.split("=", 1)[1])
        parts = [f.getPath() for f in fs.listStatus(d.getPath()) if f.getPath().getName().startswith("part-")]
        out[contig] = f"{path.rstrip('/')}/{names.get(contig, contig + '.fa')}"
        fs.rename(parts[0], Path_(out[contig]))
        fs.delete(d.getPath(), True)
    return out


def tile_lines(tiles_: DataFrame, tile: int) -> DataFrame:
    """``(contig, place, line)``: each tile's own bases are a line."""
    return tiles_.select("contig", F.col("tile_start").alias("place"), F.substring("seq", 1, tile).alias("line"))


def _file_system(spark: SparkSession, path: str):
    cls = spark._jvm.org.apache.hadoop.fs.Path
    return cls(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), cls


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> str:
    """A small text file on the file system of the path."""
    fs, cls = _file_system(spark, path)
    out = fs.create(cls(path), True)
    out.write(bytearray("".join(x + "\n" for x in lines).encode()))
    out.close()
    return path


def guide_label(guide: Guide, pam: Pam) -> str:
    slot = "N" * pam.size
    return slot + guide.sequence if pam.upstream else guide.sequence + slot


def _grid(df: DataFrame, keys: list[str], value: str = "n") -> dict:
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def profile_lines(tot: DataFrame, pos: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, complete: bool = False) -> list[str]:
    """The mismatch profile: a column per position, then on-targets, off-targets, their mean, and hits per level."""
    channel = "complete" if complete else "plain"
    col = "pos_mm_complete" if complete else "pos_mm_count"
    by_pos = {(r["guide_id"], r["pos"]): r[col] for r in pos.collect()}
    by_mm = _grid(profiles.off_targets(tot, channel), ["guide_id", "mm"])
    head = ["GUIDE", *["BP"] * pam.guide_size, "", "ONT", "OFFT", "MM/OFFT", "", *[f"{m}MM" for m in range(budget.mismatches + 1)]]
    lines = ["\t".join(head)]
    for g in guides:
        n = [by_mm.get((g.guide_id, m), 0) for m in range(budget.mismatches + 1)]
        off = sum(n[1:])
        mean = sum(m * x for m, x in enumerate(n)) / off if off else 0
        row = [guide_label(g, pam), *[by_pos.get((g.guide_id, i), 0) for i in range(pam.guide_size)], "", n[0], off, f"{mean:.6f}", "", *n]
        lines.append("\t".join(map(str, row)))
    return lines


def bulge_profile_lines(tot: DataFrame, pos: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, kind: str) -> list[str]:
    """The profile of one bulge channel: ``mismatches(bulges)`` per position; no lines without a budget."""
    most = budget.dna if kind == "dna" else budget.rna
    if not most:
        return []
    cells = {(r["guide_id"], r["pos"]): f"{r[f'pos_mm_in_{kind}']}({r[f'pos_bulge_{kind}']})" for r in pos.collect()}
    by = _grid(profiles.off_targets(tot, kind), ["guide_id", "mm", "size"])
    pairs = [(m, b) for b in range(1, most + 1) for m in range(budget.mismatches + 1)]
    lines = ["\t".join(["GUIDE", *["BP"] * pam.guide_size, "", "ONT", "OFFT", "MM/OFFT", "", *[f"{m}MM({b})" for m, b in pairs]])]
    for g in guides:
        n = {(m, b): by.get((g.guide_id, m, b), 0) for m, b in pairs}
        ont = sum(x for (m, _), x in n.items() if m == 0)
        off = sum(n.values()) - ont
        mean = sum(m * x for (m, _), x in n.items()) / off if off else 0
        lines.append("\t".join(map(str, [guide_label(g, pam), *[cells.get((g.guide_id, i), "0(0)") for i in range(pam.guide_size)], "", ont, off, f"{mean:.6f}", "", *n.values()])))
    return lines


def extended_lines(ev: DataFrame, tot: DataFrame, guides: list[Guide], pam: Pam, budget: Budget) -> list[str]:
    """Per guide and level: all mismatches with the number of targets, one row per base, bulge rows, a blank line."""
    cells = _grid(profiles.extended_counters(ev), ["guide_id", "mm", "symbol", "pos"])
    plain = _grid(profiles.off_targets(tot, "complete"), ["guide_id", "mm"])
    lines = []
    for g in guides:
        lines.append(">" + guide_label(g, pam))
        for m in range(budget.mismatches + 1):
            row = lambda s: [cells.get((g.guide_id, m, s, i), 0) for i in range(pam.guide_size)]  # noqa: B023, E731
            bases = {s: row(s) for s in "ACGT"}
            whole = [sum(x) for x in zip(*bases.values())]
            lines.append("\t".join(map(str, [f"{m} MISMATCHES", *whole, "TARGETS", plain.get((g.guide_id, m), 0)])))
            lines += ["\t".join(map(str, [f"NUCLEOTIDE {s}", *v])) for s, v in bases.items()]
            lines += ["\t".join(map(str, [f"BULGE {s}", *row(s)])) for s, b in (("DNA", budget.dna), ("RNA", budget.rna)) if b]
            lines.append("")
    return lines


def write_profiles(hits: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, stem: str) -> list[str]:
    """The five profile files of a search, from two aggregates over the hits."""
    spark = hits.sparkSession
    frame = spark.createDataFrame([(g.guide_id,) for g in guides], "guide_id int")
    ev, tot = profiles.events(hits, pam, budget).cache(), profiles.totals(hits, budget).cache()
    pos = profiles.position_counters(ev, frame, pam)
    files = {
        "profile": profile_lines(tot, pos, guides, pam, budget),
        "extended_profile": extended_lines(ev, tot, guides, pam, budget),
        "profile_dna": bulge_profile_lines(tot, pos, guides, pam, budget, "dna"),
        "profile_rna": bulge_profile_lines(tot, pos, guides, pam, budget, "rna"),
        "profile_complete": profile_lines(tot, pos, guides, pam, budget, complete=True),
    }
    out = []
    for name, lines in files.items():
        out.append(write_lines(spark, f"{stem}.{name}.xls", lines))
    ev.unpersist()
    tot.unpersist()
    return out
