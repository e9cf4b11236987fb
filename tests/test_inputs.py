import gzip

import pytest

from siteseer.functions.iupac import code_of, nibble, reverse_complement_text
from siteseer.operators.sites import extract_sites, write_index
from siteseer.sources import sinks, tracks
from siteseer.sources.genome import assemble, read_fasta, read_fasta_record_tiles, read_fasta_records, read_fasta_tiles, tiles
from siteseer.sources.inputs import Pam, check_guides, read_guides, read_pam


def test_pam_lines():
    p = Pam.parse("NNNNNNNNNNNNNNNNNNNNNGG 3")
    assert (p.motif, p.guide_size, p.upstream, p.cas_system, p.scored) == ("NGG", 20, False, "SpCas9", True)
    p = Pam.parse("TTTN" + "N" * 20 + " -4")
    assert (p.motif, p.guide_size, p.upstream, p.scored) == ("TTTN", 20, True, False)
    for bad in ("NGG 0", "NGG 3", "NGG", "NNNXGG 3"):
        with pytest.raises(ValueError):
            Pam.parse(bad)


# Systems of motifs.
KNOWN = {
    False: {"NGG": "SpCas9", "NGA": "SpCas9", "NRG": "SpCas9", "NGC": "SpCas9", "NGK": "xCas9", "NGN": "xCas9", "NNG": "xCas9", "NNGRRT": "unknown", "TTTV": "unknown"},
    True: {"TTN": "Cas12a", "TTTN": "Cas12a", "TYCV": "Cas12a", "TATV": "Cas12a", "TTTV": "Cas12a", "TTTR": "Cas12a", "ATTN": "Cas12a", "TTTA": "Cas12a", "TCTA": "Cas12a", "TCCA": "Cas12a", "CCCA": "Cas12a", "YTTV": "Cas12a", "TTYN": "Cas12a", "TTCN": "CasX", "NNGRRT": "SaCas9", "NNNRRT": "SaCas9", "NGG": "unknown"},
}


@pytest.mark.parametrize("upstream,motif", [(u, m) for u, ms in KNOWN.items() for m in ms])
def test_systems(upstream, motif):
    p = Pam(motif, 20, upstream)
    assert p.cas_system == KNOWN[upstream][motif] and p.scored == (p.cas_system in ("SpCas9", "xCas9"))


def test_small_files_are_read_whole(spark, tmp_path):
    """Second lines after blanks, third files and long tables show, or raise."""
    from siteseer.operators.scoring import read_model

    (tmp_path / "pam.txt").write_text("\n" + "N" * 5 + "NGG 3\n\n")
    assert read_pam(spark, str(tmp_path / "pam.txt")).motif == "NGG"
    (tmp_path / "two.txt").write_text("NNNNNNGG 3\n\n\nNNNNNNGA 3\n")
    with pytest.raises(ValueError):
        read_pam(spark, str(tmp_path / "two.txt"))
    for i in range(4):
        (tmp_path / f"g{i}.txt").write_text("".join(f"ACGT{b}NNN\n" for b in "ACGT"[: i + 1]))
    got = read_guides(spark, str(tmp_path / "g*.txt"), Pam("NGG", 5))
    assert [g.sequence[-1] for g in got] == list("AACACGACGT") and [g.guide_id for g in got] == list(range(10))
    with pytest.raises(ValueError):
        read_guides(spark, str(tmp_path / "g*.txt"), Pam("NGG", 5), limit=9)
    (tmp_path / "m.csv").write_text("key,value\n" + "".join(f'"rA:dC,{i}",0.5\n' for i in range(20)))
    assert len(read_model(spark, str(tmp_path / "m.csv"), str(tmp_path / "m.csv")).mismatch) == 20
    with pytest.raises(ValueError):
        read_model(spark, str(tmp_path / "m.csv"), str(tmp_path / "m.csv"), limit=19)


def test_shards_without_header_and_score(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("chr1\t5\t+\tA\tA\t0\tX\t0\t0\nchr1\t7\t-\tA\tA\t0\tX\t0\t0\t0.25\n")
    assert [(r["pos"], r["cfd_score"]) for r in tracks.read_hits(spark, str(tmp_path / "a.tsv")).orderBy("pos").collect()] == [(5, None), (7, 0.25)]


def test_long_contig_in_linear_time(spark):
    """One contig of two million bases as a row: tiles and sites in one pass."""
    import random

    from siteseer.operators.sites import extract_sites

    seq = "".join(random.Random(1).choices("ACGT", k=20_000)) * 100
    df = spark.createDataFrame([("c", seq)], "contig string, sequence string")
    t = tiles(df, 22)
    assert t.count() == -(-len(seq) // 512) and assemble(t.where("tile_start < 5120")).first()["sequence"] == seq[:5120]
    n = extract_sites(df, Pam("NGG", 20), planes=False, partitions=8).count()
    assert n == sum(seq[p + 21 : p + 23] == "GG" for p in range(len(seq) - 22)) + sum(seq[p : p + 2] == "CC" for p in range(len(seq) - 22))


def test_guides():
    p = Pam("NGG", 5)
    assert [g.sequence for g in check_guides(["ACGTANNN", "acgtaNNN"], p)] == ["ACGTA", "ACGTA"]
    for bad in (["ACGTAAGG"], ["ACGTNNN"], [], ["ACGT!NNN"]):
        with pytest.raises(ValueError):
            check_guides(bad, p)
    assert check_guides(["NNNNACGTA"], Pam("TTTV", 5, True))[0].reverse_complement == "TACGT"


def test_codes(spark):
    assert reverse_complement_text(reverse_complement_text("ACGTRYMKHDBVSWN")) == "ACGTRYMKHDBVSWN"
    rows = [(c,) for c in "ACGTRYMKHDBVSW"]
    df = spark.createDataFrame(rows, "c string")
    assert all(r["c"] == r["d"] for r in df.select("c", code_of(nibble(df.c)).alias("d")).collect())


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">1 x y\nacgt\n\nACGN\n>later\nTT\n")
    r = read_fasta(spark, str(tmp_path / "a.fa")).collect()
    assert [(x["contig"], x["header"], x["sequence"]) for x in r] == [("chr1", "1 x y", "ACGTACGNTT")]
    for i, text in enumerate(["ACGT\n", ">\nACGT\n", ">x\n", "\n"]):
        (tmp_path / f"bad{i}.fa").write_text(text)
        with pytest.raises(Exception):
            read_fasta(spark, str(tmp_path / f"bad{i}.fa")).collect()


@pytest.mark.parametrize("tile,overlap,width", [(10, 7, 4), (7, 20, 13), (64, 0, 60)])
def test_tiles_from_lines(spark, tmp_path, tile, overlap, width):
    import random

    rnd = random.Random(tile)
    for c in "ab":
        s = "".join(rnd.choices("acgtN", k=500))
        (tmp_path / f"{c}.fa").write_text(f">{c} x\n\n" + "\n".join(s[i : i + width] for i in range(0, 500, width)) + "\n>later\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = sorted(map(tuple, read_fasta_tiles(spark, str(tmp_path / "*.fa"), overlap, tile).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(map(tuple, tiles(read_fasta(spark, str(tmp_path / "*.fa")), overlap, tile).collect()))


@pytest.mark.parametrize("width,split", [(4, 100), (60, 33), (700, 50), (13, 10**6)])
def test_many_records_of_a_file(spark, tmp_path, width, split):
    """Records that begin and end anywhere in a split, and some over many splits."""
    import random

    rnd = random.Random(width)
    records = {f"c{i}": "".join(rnd.choices("ACGTN", k=rnd.choice([1, 9, 60, 600]))) for i in range(25)}
    (tmp_path / "in").mkdir()
    for f in range(3):
        mine = [(c, s) for i, (c, s) in enumerate(records.items()) if i % 3 == f]
        (tmp_path / "in" / f"{f}.fa").write_text("".join(f">{c} of {f}\n\n" + "\n".join(s[i : i + width].lower() for i in range(0, len(s), width)) + "\n" for c, s in mine))
    want = spark.createDataFrame([(f"chr{c}", s) for c, s in records.items()], "contig string, sequence string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = read_fasta_records(spark, str(tmp_path / "in")).collect()
        cut = sorted(map(tuple, read_fasta_record_tiles(spark, str(tmp_path / "in"), 7, 10).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["contig"]: r["sequence"] for r in got} == {f"chr{c}": s for c, s in records.items()} and len(got) == 25
    assert {r["header"] for r in got} == {f"c{i} of {i % 3}" for i in range(25)}
    assert cut == sorted(map(tuple, tiles(want, 7, 10).collect()))
    for i, text in enumerate(["ACGT\n>x\nA\n", ">\nACGT\n"]):
        (tmp_path / f"bad{i}.fa").write_text(text)
        with pytest.raises(Exception):
            read_fasta_records(spark, str(tmp_path / f"bad{i}.fa")).collect()
        with pytest.raises(Exception):
            read_fasta_record_tiles(spark, str(tmp_path / f"bad{i}.fa"), 7, 10).collect()


def test_many_contigs_are_few_files(spark, tmp_path):
    """Files follow the partitions, for genomes and for indexes."""
    df = spark.createDataFrame([(f"c{i}", "ACGGTTGACA" * 4) for i in range(300)], "contig string, sequence string")
    sinks.write_fasta_lines(sinks.tile_lines(tiles(df, 0, 16), 16), str(tmp_path / "g"))
    files = [p for p in (tmp_path / "g").rglob("part-*")]
    assert len(files) <= 8 and {r["contig"]: r["sequence"] for r in read_fasta_records(spark, str(tmp_path / "g")).collect()} == {f"chrc{i}": "ACGGTTGACA" * 4 for i in range(300)}
    sites = extract_sites(df, Pam("NGG", 5))
    write_index(sites, str(tmp_path / "i"))
    assert len([p for p in (tmp_path / "i").rglob("part-*.parquet")]) <= 8
    back = spark.read.parquet(str(tmp_path / "i")).select(*sites.columns)
    assert sites.count() and sorted(map(tuple, back.collect())) == sorted(map(tuple, sites.collect()))


def test_tiles_round_trip(spark):
    df = spark.createDataFrame([("a", "ACGT" * 33), ("b", "A"), ("c", "")], "contig string, sequence string")
    t = tiles(df, 7, 10)
    assert max(len(r["seq"]) for r in t.collect()) == 17
    assert {r["contig"]: r["sequence"] for r in assemble(t, 10).collect()} == {"a": "ACGT" * 33, "b": "A"}


def test_text_tables(spark, tmp_path):
    with gzip.open(tmp_path / "x.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tn1\tn2\n1\t5\trs\tA\tC,G\t.\tPASS\tDP=3;AF=0.5,0.1\tGT\t0|1:3\t2|2\n")
    rows, samples = tracks.read_vcf(spark, str(tmp_path / "x.vcf.gz"))
    assert samples == ["n1", "n2"] and tracks.single_contig(rows) == "chr1"
    assert rows.collect()[0]["genotypes"] == ["0|1:3", "2|2"]
    (tmp_path / "t.bed").write_text("#c\ntrack x\nbrowser y\n\nchr1\t0\t40\texon\nchr1\t5\t9\tintron\tx\n")
    assert [(r["start"], r["label"]) for r in tracks.read_bed(spark, str(tmp_path / "t.bed")).orderBy("ord").collect()] == [(0, "exon"), (5, "intron")]
    (tmp_path / "bad.bed").write_text("chr1\t0\t40\n")
    with pytest.raises(Exception):
        tracks.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "bad.tsv").write_text("chrom\tpos\n")
    with pytest.raises(ValueError):
        tracks.read_hits(spark, str(tmp_path / "bad.tsv"))
    with pytest.raises(ValueError):
        tracks.read_annotated(spark, str(tmp_path / "bad.tsv"))
