import random

import naive
import pytest

from siteseer.operators import scripts
from siteseer.operators.scripts import edit_scripts, near_match
from siteseer.operators.search import search
from siteseer.operators.sites import extract_sites, pam_starts
from siteseer.sources.inputs import Budget, Guide, Pam

NGG5 = Pam("NGG", 5)


def contigs(spark, *seqs):
    return spark.createDataFrame([(f"chr{i + 1}", s) for i, s in enumerate(seqs)], "contig string, sequence string")


def run(spark, seq, guide, pam=NGG5, mm=0, dna=0, rna=0, single=False, bmax=0, tile=512):
    sites = extract_sites(contigs(spark, seq), pam, bmax, tile)
    rows = search(sites, [Guide(0, guide)], pam, Budget(mm, dna, rna, single), bmax).collect()
    return [(r["pos"], r["strand"], r["grna"], r["spacer"], r["mismatches"], r["bulge_dna"], r["bulge_rna"]) for r in rows]


def test_known_hits(spark):
    g = "ATATATACGCATGGATATAT"
    assert run(spark, g, "ACGCA") == [(7, "+", "ACGCANGG", "ACGCATGG", 0, 0, 0)]
    assert run(spark, g, "ACTCA") == []
    assert run(spark, g, "ACTCA", mm=1) == [(7, "+", "ACTCANGG", "ACgCATGG", 1, 0, 0)]
    assert run(spark, g, "TTTTT") == []
    assert run(spark, "TTTTACGTATGGTTTT", "ACGTA") == [(5, "+", "ACGTANGG", "ACGTATGG", 0, 0, 0)]


def test_no_sites(spark):
    assert run(spark, "A" * 30, "ACGTA", mm=2) == []
    assert run(spark, "N" * 30, "ACGTA", mm=2) == []
    assert run(spark, "", "ACGTA", mm=2) == []
    assert run(spark, "ACG", "ACGTA", mm=2) == []


def test_pam_scan(spark):
    got = {(r["strand"], r["pam_start0"]) for r in pam_starts(contigs(spark, "AAAAATAGTGGAAAAAAAAAA"), Pam("NRG", 5)).collect()}
    assert {("+", 5), ("+", 8)} <= got
    assert {(r["strand"]) for r in pam_starts(contigs(spark, "AAAAACCGAAAAAAAAAAAA"), NGG5).collect()} == {"-"}
    assert pam_starts(contigs(spark, "AAATTTAAAAAAAAAAAAAAA"), Pam("TTT", 5, True)).where("strand = '+'").count() == 1
    # the last start is scanned too, unless asked otherwise
    assert pam_starts(contigs(spark, "AAAGG"), NGG5, compat_edges=True).count() == 0
    assert pam_starts(contigs(spark, "AAAGG"), NGG5).count() == 1


@pytest.mark.parametrize("seed", range(6))
def test_matches_naive_search(spark, seed):
    rnd = random.Random(seed)
    upstream = seed % 2 == 1
    pam = Pam("TTV", 6, True) if upstream else Pam("NGG", 6)
    letters = "ACGT" * 6 + "RYN" * (seed > 2)
    seqs = ["".join(rnd.choices(letters, k=n)) for n in (150, 64, 65, 63, 9, 10)]
    guide = "".join(rnd.choices("ACGT", k=6))
    mm, dna, rna, single = rnd.choice([(1, 1, 1, False), (2, 0, 0, False), (1, 2, 1, True), (0, 1, 2, False)])
    bmax = max(dna, rnd.choice([0, 1]))
    sites = extract_sites(contigs(spark, *seqs), pam, bmax, tile=64)
    rows = search(sites, [Guide(0, guide)], pam, Budget(mm, dna, rna, single), bmax).collect()
    got = [(r["chrom"], r["pos"], r["strand"], r["grna"], r["spacer"], r["mismatches"], r["bulge_dna"], r["bulge_rna"]) for r in rows]
    want = {(f"chr{i + 1}", *h) for i, s in enumerate(seqs) for h in naive.search(s, guide, pam, mm, dna, rna, single, bmax)}
    assert len(got) == len(set(got))
    assert set(got) == want
    for _, pos, strand, g, s, m, d, r in got:
        assert len(g) == len(s) and m <= mm and d <= dna and r <= rna


def test_spacer_is_the_genome(spark):
    seq = "ACGTTGCAAGTCACGATGCATGGTTTTCCATGCATCGTGACTTGCAACGTAAA"
    for pos, strand, _, spacer, *_ in run(spark, seq, "ACGTTGCAAGTCACGATGCA", Pam("NGG", 20), mm=4, dna=1, rna=1, bmax=1):
        text = spacer.replace("-", "").upper()
        piece = seq[pos - 1 : pos - 1 + len(text)]
        assert text == (piece if strand == "+" else naive.reverse_complement_text(piece))


def test_script_counts():
    assert len(edit_scripts(20, 20, 0, 0, False)) == 1
    assert len(edit_scripts(20, 21, 1, 0, False)) == 21
    assert len(edit_scripts(20, 21, 1, 1, False)) == 441
    assert len(edit_scripts(20, 21, 1, 1, True)) == 41
    assert len(edit_scripts(20, 22, 2, 2, True)) == 441
    assert len(edit_scripts(20, 22, 2, 1, False)) > 2_000


@pytest.mark.parametrize("budget,upstream", [(Budget(1, 1, 1), False), (Budget(3, 1, 0), True), (Budget(2, 2, 1, True), False), (Budget(6, 1, 1), False)])
def test_blocks_lose_nothing(spark, monkeypatch, budget, upstream):
    """The block filter and tables in turns give what all scripts against all sites give; ambiguous bases on both sides."""
    rnd = random.Random(5)
    pam = Pam("TTV", 8, True) if upstream else Pam("NGG", 8)
    seqs = ["".join(rnd.choices("ACGT" * 9 + "R", k=400)) for _ in range(3)]
    guides = [Guide(0, "ACGTACGT"), Guide(1, "TTGACCGA"), Guide(2, "TTGACCGA"), Guide(3, "TTGRCCGN".replace("N", "Y"))]
    sites = extract_sites(contigs(spark, *seqs), pam, 2)
    key = ["contig", "strand", "window0", "guide_id", "script", "mismatches"]
    a = sorted(tuple(r) for r in near_match(sites, guides, pam, budget, 2, prefilter=False).select(*key).collect())
    assert a and len(a) == len(set(a))
    monkeypatch.setattr(scripts, "SCRIPT_ROWS", 50)
    monkeypatch.setattr(scripts, "GUIDE_ROWS", 3)
    assert sorted(tuple(r) for r in near_match(sites, guides, pam, budget, 2).select(*key).collect()) == a


def test_budget_checks():
    with pytest.raises(ValueError):
        Budget(-1)
    with pytest.raises(ValueError):
        Budget(4, 1, 1).check(NGG5, 1)
    with pytest.raises(ValueError):
        Budget(0, 2).check(NGG5, 1)
