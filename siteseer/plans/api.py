"""The five commands as functions over a session and paths."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import ordering, report, scoring, variants
from ..operators.search import search
from ..operators.sites import require_sites, sites_of_tiles, with_planes, write_index
from ..sources import sinks, tracks
from ..sources.genome import TILE, contig_check, fasta_names, read_fasta_tiles
from ..sources.inputs import Budget, Pam, read_guides, read_pam

META = "siteseer-index.json"


def genome_names(spark: SparkSession, genome: str) -> DataFrame:
    """``(contig, header, stem)`` of a genome's files; a contig that occurs twice raises an error."""
    names = fasta_names(spark, genome).cache()
    if twice := contig_check(names).limit(1).collect():
        raise ValueError(f"contig {twice[0]['contig']} occurs more than once")
    stem = F.regexp_extract("file", "([^/]*?)([.][^./]*)?$", 1)
    return names.select("contig", "header", stem.alias("stem"))


def add_variants(spark: SparkSession, genome: str, vcfs: list[str], outdir: str, indels: bool = False, keep: bool = False, store_dictionary: bool = False) -> dict[str, str]:
    """Merge variants into a genome, tile by tile; contigs without a VCF are copied."""
    names = genome_names(spark, genome)
    alleles, listed = None, []
    for path in vcfs:
        rows, samples = tracks.read_vcf(spark, path)
        listed.append(tracks.single_contig(rows))
        a = variants.split_alleles(variants.passing(rows, keep))
        a = variants.variant_id(variants.carriers(variants.allele_frequency(a), samples))
        alleles = a if alleles is None else alleles.unionByName(a)
    # one row per contig: the pairs are judged before anything is written
    variants.pair_contigs(names, spark.createDataFrame([(n,) for n in listed], "contig string")).write.format("noop").mode("overwrite").save()
    cut = read_fasta_tiles(spark, genome, 0)
    enriched = variants.apply_snps(cut, variants.snp_codes(alleles)) if alleles is not None else cut
    out = {"genome": f"{outdir}/variants_genome/SNPs_genome"}
    stems = {r["contig"]: r["stem"] for r in names.collect()}  # one per file
    sinks.write_contig_files(sinks.tile_lines(enriched, TILE), names, out["genome"], {c: f"{s}.enriched.fa" for c, s in stems.items()})
    if indels and alleles is not None:
        layout = variants.indel_layout(variants.indel_windows(alleles, cut)).cache()
        out["indels"] = f"{outdir}/variants_genome/INDELs_genome"
        fake = names.select("contig", F.concat(F.lit("fake"), "contig").alias("header"))
        sinks.write_contig_files(variants.fake_lines(layout), fake, out["indels"], {c: f"fake{c}.fa" for c in stems})
        out["log"] = f"{outdir}/indels_log"
        sinks.write_tsv(variants.indel_log(layout), out["log"])
        layout.unpersist()
    if store_dictionary and alleles is not None:
        out["dictionary"] = f"{outdir}/snp_dictionary"
        variants.snp_dictionary(alleles).select(F.to_json(F.struct("key", "value")).alias("value")).write.text(out["dictionary"])
    return out


def index_genome(spark: SparkSession, genome: str, pam: Pam, outdir: str, bmax: int = 0) -> str:
    """Write the site table; the PAM and ``bmax`` are kept beside it.  A genome without any site raises an error."""
    if bmax < 0:
        raise ValueError("bmax cannot be negative")
    genome_names(spark, genome)
    cut = read_fasta_tiles(spark, genome, pam.total + bmax - 1)
    sites = sites_of_tiles(cut, pam, bmax, planes=False)
    require_sites(sites, cut, pam)
    write_index(sites, f"{outdir}/sites")
    meta = {"motif": pam.motif, "guide_size": pam.guide_size, "upstream": pam.upstream, "bmax": bmax}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{outdir}/{META}")
    return outdir


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, Pam, int]:
    meta = json.loads(spark.read.text(f"{path}/{META}").first()["value"])
    pam = Pam(meta["motif"], meta["guide_size"], meta["upstream"])
    schema = "strand string, window0 bigint, body string, pam string, contig string"
    return with_planes(spark.read.schema(schema).parquet(f"{path}/sites")), pam, meta["bmax"]


def search_offtargets(spark: SparkSession, index: str, guides_path: str, budget: Budget, outdir: str, mode: str = "both", model: scoring.CfdModel | None = None, sort: str = "edits", layout="scored", single_file: bool = False) -> dict:
    """Search an index; writes targets, profiles or both.

    ``layout`` is the name of a row formatter or a function from hits to the
    columns to write; targets are sorted parts unless ``single_file``.
    """
    if mode not in sinks.OUTPUT_MODES:
        raise ValueError(f"output mode is one of {sinks.OUTPUT_MODES}")
    shape = sinks.layout_of(layout)
    sites, pam, bmax = load_index(spark, index)
    guides = read_guides(spark, guides_path, pam)
    hits = search(sites, guides, pam, budget, bmax)
    if model is not None:
        hits = scoring.score_hits(hits, model, pam)
    hits = hits.persist()
    out: dict = {}
    try:
        if mode != "profile":
            out["targets"] = f"{outdir}/targets"
            out["rows"] = sinks.write_tsv(shape(_sorted(hits, sort)), out["targets"], single_file)
        if mode != "targets":
            out["profiles"] = sinks.write_profiles(hits, guides, pam, budget, f"{outdir}/guides")
    finally:
        hits.unpersist()
    return out


def _sorted(hits: DataFrame, sort: str) -> DataFrame:
    return ordering.by_edit_distance(hits) if sort == "edits" else ordering.by_coordinates(hits)


def merge_results(spark: SparkSession, shards: list[str], out: str, sort: str = "edits", layout="scored", single_file: bool = False) -> int:
    """Merge hit tables into one sorted table; returns its rows.  A malformed row raises an error, an unreadable score is ``NA``."""
    rows = None
    for path in shards:
        h = tracks.strict_hits(tracks.read_hits(spark, path))
        if "cfd_score" not in h.columns:
            h = h.withColumn("cfd_score", F.lit(None).cast("double"))
        h = h.select(*tracks.HIT_COLUMNS)
        rows = h if rows is None else rows.unionByName(h)
    return sinks.write_tsv(sinks.layout_of(layout)(_sorted(rows, sort)), out, single_file)


def annotate_results(spark: SparkSession, targets: str, beds: list[str], outdir: str, names: list[str] | None = None, minus_pos: str = "rightmost", single_file: bool = False) -> str:
    """Hits with a column of labels per BED file, in the order of the hits."""
    hits = tracks.read_hits(spark, targets).withColumn("row_id", F.monotonically_increasing_id())
    names = A.track_names(len(beds), names)
    rows = None
    for path, name in zip(beds, names):
        if not path.endswith((".bed", ".bed.gz")):
            raise ValueError(f"not a BED file: {path}")
        t = tracks.read_bed(spark, path, name)
        rows = t if rows is None else rows.unionByName(t)
    out = A.annotate(hits, rows, names, minus_pos).orderBy("row_id").drop("row_id")
    path = f"{outdir}/{Path(sinks.annotated_name(targets)).name}"
    if "cfd_score" in out.columns:
        out = out.withColumn("cfd_score", sinks.score_text(F.col("cfd_score")))
    sinks.write_tsv(out, path, single_file)
    return path


def generate_report(spark: SparkSession, annotated: str, max_mm: int | None, outdir: str, guides: list[str] | None = None, prefix: str = "report") -> dict[str, str]:
    """The report's tables as TSV: a logo matrix per guide and one of all rows, counts per feature over all rows and per guide.

    ``guides`` picks the guides of the tables per guide, as given; the tables
    of all rows keep all rows.  Without ``max_mm`` the largest number of
    mismatches is the ceiling.
    """
    if max_mm is not None and max_mm < 0:
        raise ValueError("the mismatch ceiling cannot be negative")
    rows, extra = tracks.read_annotated(spark, annotated)
    if max_mm is None:
        max_mm = rows.agg(F.max("mismatches").alias("m")).first()["m"] or 0
    own = rows.where(report.guide_key(F.col("grna")).isin(*guides)) if guides else rows
    if guides and not own.limit(1).count():
        raise ValueError("no row has one of the guides")
    stem, out = f"{outdir}/{report.safe_name(prefix)}", {}

    def put(key: str, df: DataFrame, *order: str) -> None:
        out[key] = f"{stem}_{key}"
        sinks.write_tsv(df.orderBy(*order), out[key], single_file=True)  # a few rows per guide and feature

    put("logo", report.strip_pam(report.logo_matrix(rows), report.template(rows)), "position")
    put("logo_by_guide", report.strip_pam_by_guide(report.logo_matrix(own, per_guide=True)), "guide", "position")
    for c in extra:
        put(f"radar_{report.safe_name(c)}", report.radar_counts(rows, c, max_mm), "ceiling", "label")
        put(f"radar_{report.safe_name(c)}_by_guide", report.radar_counts(own, c, max_mm, per_guide=True), "guide", "ceiling", "label")
    return out


# Colours of the deviation symbols.
COLOURS = {"A": "#109648", "C": "#255c99", "G": "#f7b32b", "T": "#d62839", "D": "#7d7d7d", "R": "#222222"}


def draw(spark: SparkSession, tables: dict[str, str], outdir: str, dpi: int = 150) -> list[str]:
    """Figures of the report's tables, where matplotlib is installed: a stacked logo per guide, a polar chart per feature column and ceiling."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("figures need matplotlib") from e
    made = []

    def save(fig, name: str) -> None:
        made.append(f"{outdir}/{name}.png")
        fig.savefig(made[-1], dpi=dpi)
        plt.close(fig)

    for key, path in tables.items():
        t = spark.read.csv(path, sep="\t", header=True, inferSchema=True).toPandas()  # a few rows per guide
        groups = t.groupby("guide") if "guide" in t else [("all", t)]
        for guide, g in groups:
            name = f"{Path(path).name}_{report.safe_name(str(guide))}"
            if key.startswith("logo"):
                fig, ax = plt.subplots(figsize=(max(6.0, 0.45 * len(g)), 3.0))
                g.set_index("position")[report.SYMBOLS].plot.bar(stacked=True, ax=ax, color=COLOURS, title=f"Off-target profile - {guide}")
                ax.set_xlabel("guide position")
                ax.set_ylabel("deviation frequency")
                save(fig, name)
                continue
            for ceiling, c in g.groupby("ceiling"):
                fig, ax = plt.subplots(subplot_kw={"projection": "polar"})
                at = [2 * math.pi * i / len(c) for i in range(len(c))]
                part = c["part"].tolist()
                ax.plot([*at, at[0]], [*part, part[0]])
                ax.fill(at, part, alpha=0.25)
                ax.set_xticks(at, c["label"].tolist())
                ax.set_title(f"{guide}, up to {ceiling} mismatches")
                save(fig, f"{name}_{ceiling}")
    return made


__all__ = ["add_variants", "annotate_results", "draw", "generate_report", "index_genome", "load_index", "merge_results", "read_pam", "search_offtargets"]
