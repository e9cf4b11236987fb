import gzip
import os
import random
from pathlib import Path

import pytest

from siteseer.plans import api, cli

SITE = "GTCAACCTGATTCGATACCA"
LEFT, MID, RIGHT = ("".join(random.Random(i).choices("AT", k=n)) for i, n in enumerate((14, 12, 25)))
#: An exact site and one with a mismatch in its second base, in a genome without other PAMs.
GENOME = LEFT + SITE + "AGG" + MID + "GA" + SITE[2:] + "CGG" + RIGHT
FIRST, SECOND = len(LEFT) + 1, len(LEFT) + 23 + len(MID) + 1


def text_of(path):
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def test_five_commands(spark, tmp_path):
    d = tmp_path
    (d / "genome.fa").write_text(">chr1 test\n" + "\n".join(GENOME[i : i + 30] for i in range(0, len(GENOME), 30)) + "\n")
    (d / "pam.txt").write_text("N" * 20 + "NGG 3\n")
    (d / "guides.txt").write_text(SITE + "NNN\n")
    (d / "genes.bed").write_text(f"chr1\t0\t{SECOND - 2}\texon\n")
    snp, gap = FIRST + 4, SECOND - 3
    with gzip.open(d / "v.vcf.gz", "wt") as f:
        f.write("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tn1\n")
        f.write(f"chr1\t{snp}\trs1\t{GENOME[snp - 1]}\tG\t.\tPASS\tAF=0.5\tGT\t0|1\nchr1\t{gap}\trs2\t{GENOME[gap - 1]}\t{GENOME[gap - 1]}GA\t.\tPASS\tAF=0.5\tGT\t1|1\n")

    def ok(*a):
        cli.run(cli.parser().parse_args([str(x) for x in a]), spark)

    ok("add-variants", "--vcf", d / "v.vcf.gz", "--genome", d / "genome.fa", "--indels", "--outdir", d / "var")
    lines = (d / "var/variants_genome/SNPs_genome/genome.enriched.fa").read_text().splitlines()
    assert lines[0] == ">chr1 test" and "".join(lines[1:]) == GENOME[: snp - 1] + "R" + GENOME[snp:]
    lines = (d / "var/variants_genome/INDELs_genome/fakechr1.fa").read_text().splitlines()
    assert lines == [">fakechr1", GENOME[max(0, gap - 51) : gap] + "GA" + GENOME[gap : gap + 50]]
    ok("index-genome", "--genome", d / "genome.fa", "--pam", d / "pam.txt", "--bmax", 1, "--outdir", d / "index")
    ok("search", "--index-genome", d / "index", "--guides", d / "guides.txt", "--mm", 3, "--outdir", d / "out", "--single-file")
    lines = text_of(d / "out/targets").splitlines()
    assert lines[0].split("\t")[:3] == ["chrom", "pos", "strand"] and len(lines) == 3
    assert lines[1].split("\t")[1:6] == [str(FIRST), "+", SITE + "NGG", SITE + "AGG", "0"]
    assert lines[2].split("\t")[1] == str(SECOND) and lines[2].split("\t")[4] == "Ga" + SITE[2:] + "CGG" and lines[2].endswith("NA")
    assert (d / "out/guides.profile.xls").read_text().count("\n") == 2
    (d / "hits.tsv").write_text("\n".join(lines) + "\n")
    (d / "more.tsv").write_text(lines[0].rsplit("\t", 1)[0] + "\nchr1\t5\t+\tA\tA\t0\tX\t0\t0\n")
    assert api.merge_results(spark, [str(d / "hits.tsv"), str(d / "more.tsv")], str(d / "merged"), single_file=True) == 3
    assert [x.split("\t")[1] for x in text_of(d / "merged").splitlines()] == ["pos", "5", str(FIRST), str(SECOND)]
    (d / "bad.tsv").write_text(lines[0] + "\nchr1\tx\t+\tA\tA\t0\tX\t0\t0\tNA\n")
    with pytest.raises(Exception):
        api.merge_results(spark, [str(d / "bad.tsv")], str(d / "merged2"))
    ok("annotate-results", "--targets", d / "hits.tsv", "--annotations", d / "genes.bed", "--annotation-names", "gene", "--outdir", d / "ann", "--single-file")
    rows = text_of(d / "ann/hits.annotated.tsv").splitlines()
    assert [r.split("\t")[-1] for r in rows] == ["gene", "exon", "NA"]
    other = rows[1].replace(SITE, "C" + SITE[1:])
    (d / "ann.tsv").write_text("\n".join([*rows, other, other]) + "\n")
    ok("generate-report", "--input", d / "ann.tsv", "--mm", 1, "--guide", SITE + "NGG", "--outdir", d / "rep")
    # the table of all rows keeps the other guide, the table per guide has the one asked for
    assert text_of(d / "rep/report_radar_gene").splitlines()[1].split("\t")[:3] == ["0", "exon", "3"]
    assert [x.split("\t")[:4] for x in text_of(d / "rep/report_radar_gene_by_guide").splitlines()[1:]] == [[SITE + "NGG", "0", "exon", "1"], [SITE + "NGG", "1", "exon", "1"]]
    assert {x.split("\t")[0] for x in text_of(d / "rep/report_logo_by_guide").splitlines()[1:]} == {SITE + "NGG"}


def test_sorted_parts_and_formatters(spark, tmp_path):
    from siteseer.sources import sinks

    df = spark.range(0, 1000, 1, 5).selectExpr("id", "concat('x', id) AS v")
    assert sinks.write_tsv(df.orderBy("id"), str(tmp_path / "parts")) == 1000
    with pytest.raises(ValueError):
        sinks.layout_of("other")
    assert sinks.layout_of(lambda h: h.select("v"))(df).columns == ["v"]


def test_genomes_without_sites(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAAGGAAAA\n")
    (tmp_path / "b.fa").write_text(">b\nAAAA\n")
    for name, said in (("a", "dropped"), ("b", "no PAM")):
        with pytest.raises(ValueError, match=said):
            api.index_genome(spark, str(tmp_path / f"{name}.fa"), api.Pam("NGG", 20), str(tmp_path / f"i{name}"))
    (tmp_path / "a2.fa").write_text(">a\nAAGG\n")
    with pytest.raises(ValueError, match="more than once"):
        api.index_genome(spark, str(tmp_path / "a*.fa"), api.Pam("NGG", 20), str(tmp_path / "twice"))


def test_bad_arguments(tmp_path, capsys):
    def code(*a):
        return cli.main([str(x) for x in a])

    (tmp_path / "x.bed").write_text("")
    assert code("annotate-results", "--targets", tmp_path / "no.tsv", "--annotations", tmp_path / "x.bed", "--outdir", tmp_path) == os.EX_NOINPUT
    assert "siteseer annotate-results" in capsys.readouterr().err
    (tmp_path / "bad.tsv").write_text("a\tb\n")
    assert code("annotate-results", "--targets", tmp_path / "bad.tsv", "--annotations", tmp_path / "x.bed", "--outdir", tmp_path) == os.EX_DATAERR
    assert code("index-genome", "--genome", "x", "--pam", "x", "--outdir", "x", "--threads", "9999") == os.EX_USAGE


def test_stream(spark, tmp_path):
    from siteseer.sources.inputs import Budget, Guide, Pam
    from siteseer.streaming import live

    spark.createDataFrame([("chr1", GENOME)], "contig string, sequence string").write.parquet(str(tmp_path / "in"))
    hits = live.search_stream(live.arriving_contigs(spark, str(tmp_path / "in")), [Guide(0, SITE)], Pam("NGG", 20), Budget(3))
    q = live.write_hits(hits, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
