import random

import pytest
from pyspark.sql import functions as F

from siteseer.operators import annotate, ordering, profiles, report, scoring, variants
from siteseer.operators.search import with_derived
from siteseer.sources import sinks
from siteseer.sources.genome import tiles
from siteseer.sources.inputs import Budget, Guide, Pam

NGG5 = Pam("NGG", 5)
HIT = "chrom string, pos int, strand string, grna string, spacer string, mismatches int, bulge_type string, bulge_dna int, bulge_rna int, cfd_score double, guide_id int, row_id long"


def hits(spark, *rows):
    """(chrom, pos, strand, grna, spacer, mm, dna, rna, score)"""
    full = [(c, p, s, g, t, m, "X", d, r, x, 0, i) for i, (c, p, s, g, t, m, d, r, x) in enumerate(rows)]
    return spark.createDataFrame(full, HIT)


def test_orders(spark):
    rows = [("chr2", 100, "+", 2, 0, 0, 0.10), ("chr1", 500, "-", 0, 0, 0, 0.95), ("chr10", 50, "+", 1, 0, 0, None), ("chr1", 200, "+", 1, 1, 0, 0.40), ("chr1", 200, "+", 1, 0, 0, 0.80), ("chr3", 9, "-", 3, 0, 0, 0.0), ("chr1", 10, "+", 0, 0, 0, None), ("chr1", 10, "+", 0, 0, 0, 0.50), ("chr2", 100, "+", 1, 0, 0, 0.99)]
    h = hits(spark, *[(c, p, s, "A", "A", m, d, r, x) for c, p, s, m, d, r, x in rows])
    assert [r["cfd_score"] for r in ordering.by_edit_distance(h).limit(3).collect()] == [0.95, 0.50, None]
    names = [r["chrom"] for r in ordering.by_coordinates(h).collect()]
    assert names.index("chr10") < names.index("chr2")
    assert ordering.top(h, 2).count() == 2
    assert with_derived(h).where("chrom = 'chr3'").first()["locus"] == "chr3:9(-)"


@pytest.mark.parametrize(
    "target,pam,table,want",
    [("ACGT" * 5, "GG", {}, 0.9), ("acgt" * 5, "GG", {}, 0.9), ("ACAT" + "ACGT" * 4, "GG", {"rG:dT,3": 0.4}, 0.36), ("AC-T" + "ACGT" * 4, "GG", {}, 0.9), ("ACGT" * 5, "NN", {}, 1.0), ("-CGT" + "ACGT" * 4, "GG", {}, 0.0)],
)
def test_cfd(spark, target, pam, table, want):
    m = scoring.CfdModel(table, {"GG": 0.9, "AG": 0.2})
    h = hits(spark, ("chr1", 1, "+", "ACGT" * 5 + "NGG", target + "A" + pam, 0, 0, 0, None))
    assert scoring.score_hits(h, m, Pam("NGG", 20)).first()["cfd_score"] == pytest.approx(want)
    assert scoring.score_hits(h, m, Pam("TTTV", 20, True)).first()["cfd_score"] is None


def test_cfd_lengths(spark):
    h = hits(spark, ("chr1", 1, "+", "ACGTNGG", "ACGAGG", 0, 0, 0, None))
    with pytest.raises(Exception):
        scoring.score_hits(h, scoring.CfdModel({}, {})).collect()


def test_profiles(spark):
    g = "ACGTANGG"
    h = hits(
        spark,
        ("c", 1, "+", g, "aGaTANGG", 2, 0, 0, None),
        ("c", 2, "+", "A-CGTANGG", "ATCGTATGG", 0, 1, 0, None),
        ("c", 3, "+", "A-CGTANGG", "ATCGaATGG", 1, 1, 0, None),
        ("c", 4, "+", g, "AC-TATGG", 0, 0, 1, None),
    )
    b = Budget(1, 1, 1)
    ev, tot = profiles.events(h, NGG5, b), profiles.totals(h, b)
    guides = spark.createDataFrame([(0,), (1,)], "guide_id int")
    pos = {(r["guide_id"], r["pos"]): r for r in profiles.position_counters(ev, guides, NGG5).collect()}
    assert len(pos) == 10 and pos[1, 0]["pos_mm_complete"] == 0
    assert pos[0, 1]["pos_bulge_dna"] == 2 and pos[0, 2]["pos_bulge_rna"] == 1
    assert pos[0, 3]["pos_mm_in_dna"] == 1 and pos[0, 3]["pos_mm_count"] == 0 and pos[0, 3]["pos_mm_complete"] == 1
    dna = {(r["mm"], r["size"]): r["n"] for r in profiles.off_targets(tot, "dna").collect()}
    assert dna == {(0, 1): 1, (1, 1): 1}
    assert {r["mm"]: r["n"] for r in profiles.off_targets(tot, "plain").collect()} == {1: 1}
    s = {r["guide_id"]: r for r in profiles.summary(tot, guides, "complete").collect()}
    assert (s[0]["ont"], s[0]["offt"], s[1]["offt"]) == (2, 2, 0)
    lines = sinks.profile_lines(tot, profiles.position_counters(ev, guides, NGG5), [Guide(0, "ACGTA"), Guide(1, "CCCCC")], NGG5, b)
    assert lines[0].split("\t")[:6] == ["GUIDE"] + ["BP"] * 5 and lines[1].startswith("ACGTANNN\t") and len(lines) == 3
    ext = sinks.extended_lines(ev, tot, [Guide(0, "ACGTA")], NGG5, b)
    assert ext[0] == ">ACGTANNN" and "BULGE RNA\t0\t0\t1\t0\t0" in ext
    assert sinks.bulge_profile_lines(tot, profiles.position_counters(ev, guides, NGG5), [Guide(0, "ACGTA")], NGG5, Budget(1), "dna") == []


def test_annotation(spark):
    h = hits(spark, ("chr1", 101, "+", "A", "ACGT", 0, 0, 0, None), ("chr1", 105, "-", "A", "A-CGT", 0, 0, 0, None), ("chr9", 1, "+", "A", "ACGT", 0, 0, 0, None), ("chr1", 8191, "+", "A", "ACGTACGT", 0, 0, 0, None))
    at = [(r["start0"], r["end0"]) for r in annotate.hit_interval(h).orderBy("row_id").collect()]
    assert at[:2] == [(100, 104), (100, 104)]
    assert annotate.hit_interval(h, "leftmost").orderBy("row_id").collect()[1]["start0"] == 104
    t = spark.createDataFrame(
        [("a", "chr1", 103, 200, "late", 0), ("a", "chr1", 0, 101, "early", 1), ("a", "chr1", 50, 120, "late", 2), ("b", "chr1", 104, 105, "off", 3), ("b", "chr1", 0, 50000, "wide", 4)],
        "track string, chrom string, start long, end long, label string, ord long",
    )
    got = {r["row_id"]: (r["a"], r["b"]) for r in annotate.annotate(h, t, ["a", "b"]).collect()}
    assert got == {0: ("early,late", "wide"), 1: ("early,late", "wide"), 2: ("NA", "NA"), 3: ("NA", "wide")}
    with pytest.raises(ValueError):
        annotate.track_names(2, ["x"])


def test_variants(spark):
    v = spark.createDataFrame(
        [("chr1", 100, "r1", "A", "G,C", "PASS", "DP=3;AF=0.5,0.1", ["0|1:5", "2|2", "10|0"]), ("chr1", 100, "r2", "A", "T,<DEL>,*", "PASS", "AF=0.2", ["1|0", "0", "0"]), ("chr1", 120, "r3", "AC", "TTT", "LowQual", "DP=1", ["0|0", "1/1", "0"]), ("chr1", 1, "r4", "A", "AT", ".", "AF=1", ["1", "0", "0"])],
        "contig string, pos long, id string, ref string, alt string, filter string, info string, genotypes array<string>",
    )
    assert variants.passing(v).count() == 2 and variants.passing(v, True).count() == 4
    al = variants.variant_id(variants.carriers(variants.allele_frequency(variants.split_alleles(v)), ["x", "y", "z"]))
    rows = {(r["id"], r["alt"]): r for r in al.collect()}
    assert rows["r1", "G"]["carriers"] == "x" and rows["r1", "C"]["carriers"] == "y" and rows["r1", "C"]["af"] == "0.1"
    assert rows["r3", "TTT"]["kind"] == "indel" and rows["r3", "TTT"]["af"] is None and len(rows) == 5
    assert variants.snp_codes(al).collect()[0]["code"] == "N"
    seq = "ACGT" * 24 + "CCCA" + "GGGGGGGGGGGGGGGGGGG" + "AC" + "ACGT" * 25
    c = spark.createDataFrame([("chr1", seq)], "contig string, sequence string")
    w = {r["id"]: r for r in variants.indel_windows(al, tiles(c, 0, 7), tile=7).collect()}
    assert len(w["r3"]["refseq"]) == 102 and w["r3"]["indelseq"][50:53] == "TTT" and w["r4"]["indelseq"].startswith("AT")
    lay = variants.indel_layout(variants.indel_windows(al, tiles(c, 0, 7), tile=7)).orderBy("idx").collect()
    assert [(r["idx"], r["start"]) for r in lay] == [(2, 0), (3, lay[0]["stop"] + 1)]
    assert variants.fake_contig(variants.indel_layout(variants.indel_windows(al, tiles(c, 0, 7), tile=7))).first()["sequence"].count("N") == 1
    key = variants.snp_dictionary(al).first()
    assert key["key"] == "chr1,100" and key["value"].startswith("x;A,G;chr1-100-A/G;0.5$")
    pairs = variants.pair_contigs(c, spark.createDataFrame([("chr2",)], "contig string"))
    with pytest.raises(Exception):
        pairs.collect()


def test_snps_across_tiles(spark):
    from siteseer.sources.genome import assemble, tiles

    c = spark.createDataFrame([("a", "ACGT" * 10), ("b", "A" * 7)], "contig string, sequence string")
    codes = spark.createDataFrame([("a", 1, "A", "R"), ("a", 8, "T", "Y"), ("a", 9, "A", "M"), ("a", 40, "T", "K")], "contig string, pos long, ref string, code string")
    t = variants.apply_snps(tiles(c, 5, 8), codes, 8, overlap=5)
    got = {r["contig"]: r["sequence"] for r in assemble(t, 8).collect()}
    want = list("ACGT" * 10)
    for i, x in ((0, "R"), (7, "Y"), (8, "M"), (39, "K")):
        want[i] = x
    assert got == {"a": "".join(want), "b": "A" * 7}
    first = t.where("contig = 'a' AND tile_start = 0").first()["seq"]
    assert first == "".join(want)[:13]
    with pytest.raises(Exception):
        variants.apply_snps(tiles(c, 5, 8), codes.withColumn("ref", F.lit("G")), 8, overlap=5).collect()


def test_report(spark):
    rows = spark.createDataFrame([("ACGTACGT", "ACGTACGT", 0, "promoter"), ("ACGTACGT", "ATGTACGT", 1, "intron")], "grna string, spacer string, mismatches int, gene string")
    m = {r["position"]: r for r in report.logo_matrix(rows).collect()}
    assert len(m) == 8 and m[2]["T"] == 0.5 and m[1]["A"] == 0.0
    c = {(r["ceiling"], r["label"]): r["n"] for r in report.radar_counts(rows, "gene", 1).collect()}
    assert c == {(0, "promoter"): 1, (1, "promoter"): 1, (1, "intron"): 1}
    many = spark.createDataFrame([("A", "A", 0, "big")] * 10 + [("A", "A", 0, "small")], "grna string, spacer string, mismatches int, gene string")
    assert {r["label"] for r in report.radar_counts(many, "gene", 0).collect()} == {"big"}
    assert report.radar_counts(many.withColumn("gene", F.lit("NA")), "gene", 0).count() == 0
    assert [r["position"] for r in report.strip_pam(report.logo_matrix(rows), "ACGTANGT").orderBy("position").collect()] == list(range(1, 8))
    assert report.safe_name("A-C/1") == "A_C_1" and report.safe_name("") == "guide"


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_overlaps_of_all_sizes(spark, monkeypatch, most):
    """Features from one base to a whole contig, with and without a broadcast: each overlapping pair once."""
    monkeypatch.setattr(annotate, "BROADCAST_BYTES", most)
    rnd = random.Random(3)
    features = [("t", rnd.choice("ab"), s, s + rnd.choice([1, 30, 5000, 40_000, 3_000_000]), f"l{i}", i) for i, s in enumerate(rnd.randrange(0, 2_000_000) for _ in range(150))]
    features += [("t", "a", 0, 200_000_000, "all", 900), ("t", "a", 4095, 4097, "border", 901), ("t", "a", 7, 7, "none", 902), ("t", "b", 32768, 32769, "edge", 903)]
    spans = [(i, rnd.choice("ab"), s, s + rnd.randint(1, 25)) for i, s in enumerate([*(rnd.randrange(0, 2_100_000) for _ in range(200)), 4094, 4096, 32767, 32768, 0])]
    got = [(r["row_id"], r["label"]) for r in annotate.overlaps(spark.createDataFrame(spans, "row_id long, chrom string, start0 long, end0 long"), spark.createDataFrame(features, "track string, chrom string, start long, end long, label string, ord long")).collect()]
    want = {(i, x[4]) for i, c, a, z in spans for x in features if x[1] == c and x[2] < x[3] and a < x[3] and x[2] < z}
    assert len(got) == len(set(got)) and set(got) == want


def test_indels_at_edges(spark):
    """Windows over many tiles, at both ends of a contig, twice the same row, and a place beyond the contig."""
    seq = "".join(random.Random(2).choices("ACGT", k=90))
    c = spark.createDataFrame([("c", seq)], "contig string, sequence string")
    at = [(1, 1), (90, 1), (40, 30), (45, 1), (45, 1)]
    al = spark.createDataFrame([("c", p, f"r{p}", seq[p - 1 : p - 1 + n], "GG", 1, "indel", "s1") for p, n in at], "contig string, pos long, id string, ref string, alt string, allele int, kind string, carriers string")
    rows = variants.indel_windows(al, tiles(c, 3, 8), flank=10, tile=8).collect()
    assert sorted((r["pos"], r["refseq"], r["indelseq"]) for r in rows) == sorted((p, seq[max(0, p - 11) : p - 1 + n + 10], seq[max(0, p - 11) : p - 1] + "GG" + seq[p - 1 + n : p - 1 + n + 10]) for p, n in at)
    with pytest.raises(Exception):
        variants.indel_windows(al.withColumn("pos", F.lit(200).cast("long")), tiles(c, 3, 8), flank=10, tile=8).collect()


@pytest.mark.parametrize("per_guide", [True, False])
def test_logo_reads_rows_once(spark, tmp_path, per_guide):
    spark.createDataFrame([("ACGTANGG", "AaGTATGG", 1), ("TTG", "TTG", 0)], "grna string, spacer string, mismatches int").write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    m = report.logo_matrix(rows, per_guide)
    assert m._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1
    assert m.count() == (11 if per_guide else 8) and report.logo_matrix(rows.where("false"), per_guide).count() == 0


def test_logo_per_guide(spark):
    g, h = "ACGTANGG", "TTGTANGG"
    rows = spark.createDataFrame([(g, "AaGTATGG", 1), (g, g, 0), (h, "TTGgATGG", 1)], "grna string, spacer string, mismatches int")
    m = {(r["guide"], r["position"]): r for r in report.strip_pam_by_guide(report.logo_matrix(rows, per_guide=True)).collect()}
    assert len(m) == 14 and m[g, 2]["A"] == 0.5 and m[h, 4]["G"] == 1.0 and m[h, 2]["A"] == 0
    assert report.logo_matrix(rows).where("position = 2").first()["A"] == pytest.approx(1 / 3)
