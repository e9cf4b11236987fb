"""Alignments as edit scripts, and the near-match join over bit planes.

A script is a string over M (a base of each side), D (a target base alone) and
R (a guide base alone), from the PAM outwards.  Every alignment within a budget
has exactly one, so the join yields no duplicates.

The join has two steps, both inside the stage that scans the sites:

1. Sites meet guides.  Of ``e + 1`` blocks of a guide at least one is free of
   edits if there are ``e`` in all, and lies in the body as it is, shifted by
   the bulges before it.  So a pair stays only if some block matches whole
   under some shift: a few bit operations, which nearly all pairs fail.
2. Pairs that stay meet scripts.  Under each shift the matching places of a
   pair are one integer; a script picks the places it compares from each, and
   the pair passes if few enough of them differ.  Scripts know no guide, so
   their table does not grow with the guides.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.iupac import BITS, MASK, matching
from ..sources.inputs import Budget, Guide, Pam

#: Scripts that travel to every task at once, at some 100 bytes each; more are joined in turns.
SCRIPT_ROWS = 200_000
#: Guides that travel at once, at some 200 bytes and more each.
GUIDE_ROWS = 50_000


@lru_cache(None)
def edit_scripts(size: int, stored: int, dna: int, rna: int, single: bool) -> tuple[str, ...]:
    """All scripts of a guide of ``size`` bases against ``stored`` target bases.

    A D is not taken from the last stored base nor after the guide's end; an R
    needs a stored base ahead.
    """
    out: list[str] = []
    todo = [("", 0, 0, 0, 0)]
    while todo:
        s, i, j, d, r = todo.pop()
        if i == size:
            out.append(s)
            continue
        if j >= stored:
            continue
        todo.append((s + "M", i + 1, j + 1, d, r))
        if d < dna and j + 1 < stored and not (single and r):
            todo.append((s + "D", i, j + 1, d + 1, r))
        if r < rna and not (single and d):
            todo.append((s + "R", i + 1, j, d, r + 1))
    return tuple(sorted(out))


def shifts(budget: Budget) -> range:
    """How far a guide base may lie from its own place in the body."""
    return range(-budget.rna, budget.dna + 1)


def _name(shift: int) -> str:
    return f"m{-shift}" if shift < 0 else f"p{shift}"


def script_row(script: str, stored: int, budget: Budget) -> tuple:
    """``(script, used, nm, bulge_dna, bulge_rna)`` and, per shift, the body places that are compared."""
    j, at, masks = 0, 0, dict.fromkeys(shifts(budget), 0)
    for op in script:
        if op == "M":
            masks[at] |= 1 << (stored - 1 - j)
        j, at = j + (op != "R"), at + (op == "D") - (op == "R")
    return (script, j, script.count("M"), script.count("D"), script.count("R"), *masks.values())


def script_tables(spark: SparkSession, pam: Pam, budget: Budget, bmax: int) -> list[DataFrame]:
    """The scripts of a budget, in tables of at most ``SCRIPT_ROWS`` rows."""
    stored = pam.guide_size + bmax
    budget.check(pam, bmax)
    scripts = edit_scripts(pam.guide_size, stored, budget.dna, budget.rna, budget.single)
    fields = "script string, used int, nm int, bulge_dna int, bulge_rna int, " + ", ".join(f"k_{_name(s)} bigint" for s in shifts(budget))
    cut = [scripts[i : i + SCRIPT_ROWS] for i in range(0, len(scripts), SCRIPT_ROWS)]
    return [spark.createDataFrame([script_row(s, stored, budget) for s in c], fields) for c in cut]


def guide_tables(spark: SparkSession, guides: list[Guide], pam: Pam, budget: Budget, bmax: int) -> list[DataFrame]:
    """Guides with the bits of each base under each shift, in tables of at most ``GUIDE_ROWS`` rows."""
    stored = pam.guide_size + bmax
    if stored > 63:
        raise ValueError("guide and extra bases exceed 63 positions")
    whole = (1 << stored) - 1
    rows = []
    for g in guides:
        q = g.sequence if pam.upstream else g.sequence[::-1]
        own = {b: sum(1 << (stored - 1 - i) for i, c in enumerate(q) if MASK[c] & bit) for b, bit in BITS.items()}
        rows.append((g.guide_id, g.sequence, q, *[(x >> s if s > 0 else x << -s) & whole for s in shifts(budget) for x in own.values()]))
    fields = "guide_id int, guide string, query string, " + ", ".join(f"q{b.lower()}_{_name(s)} bigint" for s in shifts(budget) for b in BITS)
    return [spark.createDataFrame(rows[i : i + GUIDE_ROWS], fields) for i in range(0, len(rows), GUIDE_ROWS)]


def _same(shift: int) -> Column:
    """The body places where site and shifted guide share a base."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"p{b}").bitwiseAND(F.col(f"q{b}_{_name(shift)}")) for b in "acgt"])


def blocks(pam: Pam, budget: Budget, bmax: int) -> list[tuple[int, int]]:
    """``(shift, places)`` of every block of the guide under every shift that keeps it in the body."""
    stored, e = pam.guide_size + bmax, budget.mismatches + budget.dna + budget.rna
    cuts = [pam.guide_size * i // (e + 1) for i in range(e + 2)]
    return [(s, sum(1 << (stored - 1 - j) for j in range(a + s, z + s))) for a, z in zip(cuts, cuts[1:]) for s in shifts(budget) if a + s >= 0 and z + s <= stored]


def seeded(pam: Pam, budget: Budget, bmax: int) -> Column:
    """Whether some block of the guide lies in the body without an edit, from the places that match under each shift."""
    tests = [F.col(f"s_{_name(s)}").bitwiseAND(F.lit(k)) == k if k else F.lit(True) for s, k in blocks(pam, budget, bmax)]
    return reduce(lambda a, b: a | b, tests)


def near_match(sites: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, bmax: int, prefilter: bool = True) -> DataFrame:
    """Sites, guides and scripts within the budget, with ``mismatches``.

    Both small sides are broadcast in tables of bounded size; the rest of
    either is joined in turns.  ``prefilter`` off meets all scripts at once.
    """
    spark, out = sites.sparkSession, None
    scripts = script_tables(spark, pam, budget, bmax)
    for g in guide_tables(spark, guides, pam, budget, bmax):
        # the fence keeps the filter above the matching places: pushed down, it would hold a copy of them for every
        # block, and the stage would grow beyond what the JVM compiles
        fence = F.spark_partition_id() >= 0
        pairs = sites.join(F.broadcast(g), F.lit(True)).select(*sites.columns, "guide_id", "guide", "query", *[F.when(fence, _same(s)).alias(f"s_{_name(s)}") for s in shifts(budget)])
        if prefilter:
            pairs = pairs.where(seeded(pam, budget, bmax))
        equal = F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"s_{_name(s)}").bitwiseAND(F.col(f"k_{_name(s)}")) for s in shifts(budget)]))
        for t in scripts:
            found = pairs.join(F.broadcast(t), F.col("nm") - equal <= budget.mismatches).withColumn("mismatches", (F.col("nm") - equal).cast("int"))
            found = found.select(*sites.columns, "guide_id", "guide", "query", "script", "used", "bulge_dna", "bulge_rna", "mismatches")
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no guides")
    return out


def aligned_strings(matched: DataFrame, pam: Pam) -> DataFrame:
    """Adds ``grna`` and ``spacer`` as read on the site's strand, mismatches in lower case."""
    places = F.sequence(F.lit(1), F.char_length("script"))
    op = lambda p: F.substring("script", p, F.lit(1))
    # the base of a side at a column: columns so far without those where the side has a gap
    base = lambda side, gap, p: F.substring(side, p - F.char_length(F.regexp_replace(F.substring("script", F.lit(1), p), f"[^{gap}]", "")), F.lit(1))

    def target(p):
        g, t = base("query", "D", p), base("body", "R", p)
        fits = F.lit(False)
        for code in MASK:
            fits = fits | ((g == code) & t.isin(*matching(code)))
        return F.when(op(p) == "R", F.lit("-")).when((op(p) == "D") | fits, t).otherwise(F.lower(t))

    aligned = F.array_join(F.transform(places, lambda p: F.when(op(p) == "D", F.lit("-")).otherwise(base("query", "D", p))), "")
    spacer = F.array_join(F.transform(places, target), "")
    matched = matched.withColumns({"aligned": aligned, "target": spacer})
    motif = F.lit(pam.motif)
    if pam.upstream:
        return matched.withColumn("grna", F.concat(motif, F.col("aligned"))).withColumn("spacer", F.concat(F.col("pam"), F.col("target")))
    return matched.withColumn("grna", F.concat(F.reverse("aligned"), motif)).withColumn("spacer", F.concat(F.reverse("target"), F.col("pam")))
