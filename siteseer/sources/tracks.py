"""Text tables: VCF, BED, hits and annotated hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iupac import contig_name

# Column order of a hits table.
HIT_COLUMNS = ["chrom", "pos", "strand", "grna", "spacer", "mismatches", "bulge_type", "bulge_dna", "bulge_rna", "cfd_score"]


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``(contig, pos, id, ref, alt, filter, info, genotypes)`` and the sample names; plain or gzip text."""
    lines = spark.read.text(path)
    head = lines.where(F.startswith("value", F.lit("#CHROM"))).limit(1).collect()
    if not head:
        raise ValueError("a VCF needs a #CHROM line")
    samples = head[0]["value"].split("\t")[9:]
    f = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(f.alias("f"))
    rows = rows.select(
        contig_name(F.col("f")[0]).alias("contig"), F.col("f")[1].cast("bigint").alias("pos"), F.col("f")[2].alias("id"), F.col("f")[3].alias("ref"),
        F.col("f")[4].alias("alt"), F.col("f")[6].alias("filter"), F.col("f")[7].alias("info"), F.slice("f", 10, 1 << 20).alias("genotypes"),
    )
    return rows, samples


def single_contig(vcf: DataFrame) -> str:
    """The one contig of a VCF."""
    names = [r["contig"] for r in vcf.select("contig").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError("a VCF covers exactly one contig")
    return names[0]


def read_bed(spark: SparkSession, path: str, track: str = "annotation1") -> DataFrame:
    """``(track, chrom, start, end, label, ord)``; comments and track lines are skipped."""
    t = F.trim("value")
    skip = (t == "") | F.startswith("value", F.lit("#")) | F.startswith("value", F.lit("track")) | F.startswith("value", F.lit("browser"))
    rows = spark.read.text(path).where(~skip).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("ord"))
    few = F.when(F.size("f") < 4, F.raise_error(F.lit("a BED row needs four fields"))).otherwise(F.col("f")[3])
    return rows.select(F.lit(track).alias("track"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("start"), F.col("f")[2].cast("bigint").alias("end"), few.alias("label"), "ord")


def _header(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).limit(1).collect()
    if not rows:
        raise ValueError(f"empty table: {path}")
    return rows[0]["value"].split("\t")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hits table; its first nine columns must be the fixed ones, in order.

    A first line whose position is a number is no header: such a shard has the
    fixed columns.  Short rows are filled up, so a missing score is ``NA``.
    """
    head = _header(spark, path)
    bare = len(head) > 1 and head[1].lstrip("-").isdigit()
    if bare:
        head = HIT_COLUMNS
    elif head[:9] != HIT_COLUMNS[:9]:
        raise ValueError(f"not a hits table: {head[:9]}")
    raw = spark.read.csv(path, sep="\t", header=not bare, schema=", ".join(f"`{c}` string" for c in head), quote="", enforceSchema=True)
    typed = {c: F.expr(f"try_cast({c} AS int)") for c in ("pos", "mismatches", "bulge_dna", "bulge_rna")}
    if "cfd_score" in head:
        typed["cfd_score"] = F.expr("try_cast(cfd_score AS double)")
    return raw.withColumns(typed)


def strict_hits(hits: DataFrame) -> DataFrame:
    """Raises on rows whose sort keys are not numbers."""
    keys = [c for c in ("pos", "mismatches", "bulge_dna", "bulge_rna")]
    bad = F.lit(False)
    for c in keys:
        bad = bad | F.col(c).isNull()
    return hits.withColumn("chrom", F.when(bad, F.raise_error(F.lit("a malformed hit row"))).otherwise(F.col("chrom")))


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Annotated hits as text columns, and the names of the annotation columns."""
    head = _header(spark, path)
    missing = [c for c in HIT_COLUMNS if c not in head]
    extra = [c for c in head if c not in HIT_COLUMNS]
    if missing or not extra:
        raise ValueError(f"not an annotated hits table: missing {missing}, annotations {extra}")
    raw = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"`{c}` string" for c in head), quote="", nullValue="\x00", emptyValue="")
    if not raw.limit(1).count():
        raise ValueError("an annotated table needs a row")
    return raw.withColumn("mismatches", F.col("mismatches").cast("int")), extra
