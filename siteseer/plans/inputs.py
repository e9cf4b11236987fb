"""Deterministic genome inputs derived from the plain tables, for the registered queries."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import search
from ..operators.sites import extract_sites
from ..operators.variants import allele_frequency, carriers, passing, split_alleles, variant_id
from ..sources.genome import letters_to_bases, text_genome
from ..sources.inputs import Budget, Guide, Pam

NGG = Pam("NGG", 20)
TTTV = Pam("TTTV", 20, upstream=True)
SAMPLES = ["s1", "s2", "s3"]
TRACKS = ["annotation1", "annotation2"]
#: A guide set is a small input of a search: so many guides of either kind.
ITEMS, CONTIGS = 2, 3


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def genome(spark: SparkSession, d: str) -> DataFrame:
    """A contig per document; dealt out by document where the table has fewer splits than there are cores."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a plain scan: its splits are known without running it
        docs = docs.repartition(cores, "doc_id")
    return text_genome(docs)


def guide_rows(spark: SparkSession, d: str) -> DataFrame:
    """Guides from the first letters of the benchmark's first items, and from the first forward NGG site of the first contigs."""
    a = table(spark, d, "benchmark").where(f"item_id < {ITEMS}").select(F.col("item_id").cast("int").alias("guide_id"), F.substring(letters_to_bases(F.col("text")), 1, 20).alias("guide"))
    site = F.regexp_extract("sequence", "([ACGT]{20})[ACGT]GG", 1)
    b = text_genome(table(spark, d, "documents").where(f"doc_id < {CONTIGS}")).select((F.lit(100) + F.substring("contig", 4, 9).cast("int")).alias("guide_id"), site.alias("guide"))
    return a.unionByName(b.where("guide <> ''"))


def guides(spark: SparkSession, d: str) -> list[Guide]:
    """The guides as driver-side objects: ``ITEMS + CONTIGS`` rows at most."""
    return [Guide(r["guide_id"], r["guide"]) for r in guide_rows(spark, d).orderBy("guide_id").collect()]


def hits(spark: SparkSession, d: str, budget: Budget, bmax: int = 0, pam: Pam = NGG) -> DataFrame:
    return search(extract_sites(genome(spark, d), pam, bmax), guides(spark, d), pam, budget, bmax)


def variants(spark: SparkSession, d: str) -> DataFrame:
    """VCF-like rows: one per labelled document that has a base."""
    v = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", letters_to_bases(F.col("text")).alias("s")), "doc_id").where("length(s) > 0")
    v = v.withColumn("pos", F.expr("1 + (doc_id * 37) % length(s)")).withColumn("ref", F.expr("substring(s, CAST(pos AS INT), 1)"))
    return v.selectExpr(
        "concat('chr', doc_id) AS contig", "CAST(pos AS BIGINT) AS pos", "concat('rs', doc_id) AS id", "ref",
        "CASE WHEN doc_id % 3 = 0 THEN concat(ref, 'TT') WHEN doc_id % 5 = 0 THEN concat(translate(ref, 'ACGT', 'CGTA'), ',', translate(ref, 'ACGT', 'GTAC')) WHEN doc_id % 11 = 0 THEN concat(translate(ref, 'ACGT', 'CGTA'), ',*') ELSE translate(ref, 'ACGT', 'CGTA') END AS alt",
        "CASE WHEN quality = 1 THEN 'PASS' ELSE 'LowQual' END AS filter",
        "concat('DP=30;AF=0.', 10 + doc_id % 90, ',0.0', 1 + doc_id % 9, ';MQ=60') AS info",
        "array(CASE doc_id % 4 WHEN 0 THEN '0|1:9' WHEN 1 THEN '1|1:9' WHEN 2 THEN '0|0:9' ELSE '1/2:9' END, CASE WHEN doc_id % 2 = 0 THEN '0|0' ELSE '0|1' END, CASE WHEN doc_id % 3 = 0 THEN '2|1' ELSE '0|0' END) AS genotypes",
    )


def alleles(spark: SparkSession, d: str) -> DataFrame:
    a = split_alleles(passing(variants(spark, d)))
    return variant_id(carriers(allele_frequency(a), SAMPLES))


def bed(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    e = table(spark, d, "events").join(F.broadcast(n))  # one row of a count
    return e.selectExpr(
        "CASE WHEN event_id % 2 = 0 THEN 'annotation1' ELSE 'annotation2' END AS track", "concat('chr', event_id % n) AS chrom",
        "CAST((user_id * 13) % 500 AS BIGINT) AS start", "CAST((user_id * 13) % 500 + 20 + event_id % 50 AS BIGINT) AS end", "event_type AS label", "CAST(event_id AS BIGINT) AS ord",
    )


@lru_cache(None)
def cfd_model():
    """A small explicit penalty table: the published values are an input, not part of the engine."""
    from ..operators.scoring import CfdModel

    # four decimals keep products away from ties of the two-decimal rounding
    pairs = {f"r{g}:d{t},{i}": round(0.3017 + 0.0511 * i - 0.0973 * (g == "G"), 4) for g in "ACGU" for t in "ACGT" for i in range(1, 13)}
    return CfdModel(pairs, {"GG": 0.9, "AG": 0.2})
