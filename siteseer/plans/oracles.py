"""DuckDB SQL of the registered queries, written by position and sharing nothing with the Spark plans."""

from __future__ import annotations

BASES = "translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
GENOME = f"genome AS (SELECT 'chr' || doc_id AS contig, doc_id, {BASES} AS sequence FROM documents)"
GUIDES = f"""guides AS (
  SELECT CAST(item_id AS INT) AS guide_id, substr({BASES}, 1, 20) AS guide FROM benchmark WHERE item_id < 2
  UNION ALL SELECT CAST(100 + doc_id AS INT), regexp_extract(sequence, '([ACGT]{{20}})[ACGT]GG', 1) FROM genome
  WHERE doc_id < 3 AND regexp_extract(sequence, '([ACGT]{{20}})[ACGT]GG', 1) <> '')"""
G = 20


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def windows(size: int) -> str:
    return f"win AS (SELECT contig, window0, w, {rc('w')} AS r FROM (SELECT contig, i AS window0, substr(sequence, i + 1, {size}) AS w FROM (SELECT contig, sequence, unnest(range(0, greatest(length(sequence) - {size} + 1, 0))) AS i FROM genome)))"


def sites(bmax: int = 0, motif: str = "[ACGT]GG", m: int = 3, upstream: bool = False) -> str:
    size, e = G + bmax + m, G + bmax
    parts = []
    for strand, w in (("+", "w"), ("-", "r")):
        pam = f"substr({w}, 1, {m})" if upstream else f"substr({w}, {e + 1}, {m})"
        body = f"substr({w}, {m + 1}, {e})" if upstream else f"reverse(substr({w}, 1, {e}))"
        parts.append(f"SELECT contig, '{strand}' AS strand, window0, {body} AS body, {pam} AS pam FROM win WHERE regexp_full_match({pam}, '{motif}')")
    return f"{windows(size)}, sites AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def hits(mm: int, dna: int = 0, rna: int = 0, single: bool = False, bmax: int = 0, upstream: bool = False) -> str:
    """CTEs up to ``hits``: all alignments by recursion over alignment states."""
    motif, m = ("TTT[ACG]", 4) if upstream else ("[ACGT]GG", 3)
    text_motif = "TTTV" if upstream else "NGG"
    q = "guide" if upstream else "reverse(guide)"
    end = f"window0 + {G + bmax} - j + 1"
    left = "window0 + 1"
    fwd, back = (left, end) if upstream else (end, left)
    grna, spacer = (f"'{text_motif}' || a", "pam || t") if upstream else (f"reverse(a) || '{text_motif}'", "reverse(t) || pam")
    ops = "('M', 1, 1)" + (", ('D', 0, 1)" if dna else "") + (", ('R', 1, 0)" if rna else "")
    lone = "true" if single else "false"
    return f"""RECURSIVE {GENOME}, {GUIDES}, {sites(bmax, motif, m, upstream)},
s AS MATERIALIZED (SELECT sites.*, guide_id, guide, {q} AS q FROM sites, guides),
st(contig, strand, window0, body, pam, guide_id, guide, q, i, j, mm, bd, br, a, t) AS (
  SELECT *, 0, 0, 0, 0, 0, '', '' FROM s
  UNION ALL
  SELECT contig, strand, window0, body, pam, guide_id, guide, q, i + di, j + dj,
    mm + CASE WHEN k = 'M' AND substr(q, i + 1, 1) <> substr(body, j + 1, 1) THEN 1 ELSE 0 END, bd + (k = 'D')::INT, br + (k = 'R')::INT,
    a || CASE WHEN k = 'D' THEN '-' ELSE substr(q, i + 1, 1) END,
    t || CASE WHEN k = 'R' THEN '-' WHEN k = 'M' AND substr(q, i + 1, 1) <> substr(body, j + 1, 1) THEN lower(substr(body, j + 1, 1)) ELSE substr(body, j + 1, 1) END
  FROM st, (VALUES {ops}) op(k, di, dj)
  WHERE i < length(q) AND j < length(body)
    AND (k <> 'D' OR (bd < {dna} AND j + 1 < length(body) AND NOT ({lone} AND br > 0)))
    AND (k <> 'R' OR (br < {rna} AND NOT ({lone} AND bd > 0)))
    AND (k <> 'M' OR mm + CASE WHEN substr(q, i + 1, 1) <> substr(body, j + 1, 1) THEN 1 ELSE 0 END <= {mm})),
hits AS MATERIALIZED (
  SELECT contig AS chrom, CAST(CASE WHEN strand = '+' THEN {fwd} ELSE {back} END AS INT) AS pos, strand, {grna} AS grna, {spacer} AS spacer, mm AS mismatches,
    CASE WHEN bd > 0 AND br > 0 THEN 'DNA,RNA' WHEN bd > 0 THEN 'DNA' WHEN br > 0 THEN 'RNA' ELSE 'X' END AS bulge_type, bd AS bulge_dna, br AS bulge_rna, guide_id, guide
  FROM st WHERE i = length(q))"""


HIT = "chrom, pos, strand, grna, spacer, mismatches, bulge_type, bulge_dna, bulge_rna"


def search(**kw) -> str:
    return f"WITH {hits(**kw)} SELECT {HIT}, guide_id FROM hits"


def columns(kw: dict) -> str:
    """CTEs up to ``ev``: one row per deviating column."""
    return f"""{hits(**kw)},
b AS (SELECT guide_id, least(mismatches, {kw['mm']}) AS mm, bulge_dna, bulge_rna, substr(grna, 1, length(grna) - 3) AS g, substr(spacer, 1, length(spacer) - 3) AS t FROM hits),
c AS (SELECT *, upper(substr(g, i, 1)) AS gc, upper(substr(t, i, 1)) AS tc, length(replace(substr(g, 1, i - 1), '-', '')) AS pos FROM (SELECT *, unnest(range(1, length(g) + 1)) AS i FROM b)),
ev AS (SELECT *, CASE WHEN gc = '-' THEN 'D' WHEN tc = '-' THEN 'R' WHEN gc <> tc AND gc <> 'N' AND tc <> 'N' THEN 'M' END AS kind FROM c)"""


def position_counters(kw: dict) -> str:
    f = lambda c: f"count(*) FILTER ({c})"
    return f"""WITH {columns(kw)}, grid AS (SELECT guide_id, unnest(range(0, {G})) AS pos FROM guides),
n AS (SELECT guide_id, pos, {f("kind = 'M' AND bulge_dna = 0 AND bulge_rna = 0")} AS pos_mm_count, {f("kind = 'M'")} AS pos_mm_complete, {f("kind = 'M' AND bulge_dna > 0")} AS pos_mm_in_dna,
  {f("kind = 'M' AND bulge_rna > 0")} AS pos_mm_in_rna, {f("kind = 'D'")} AS pos_bulge_dna, {f("kind = 'R'")} AS pos_bulge_rna FROM ev GROUP BY ALL)
SELECT guide_id, CAST(pos AS INT) AS pos, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('pos_mm_count', 'pos_mm_complete', 'pos_mm_in_dna', 'pos_mm_in_rna', 'pos_bulge_dna', 'pos_bulge_rna'))}
FROM grid LEFT JOIN n USING (guide_id, pos)"""


def extended(kw: dict) -> str:
    return f"""WITH {columns(kw)} SELECT guide_id, mm, CASE kind WHEN 'D' THEN 'DNA' WHEN 'R' THEN 'RNA' ELSE tc END AS symbol, CAST(pos AS INT) AS pos, count(*) AS n
FROM ev WHERE pos < {G} AND (kind IN ('D', 'R') OR (kind = 'M' AND tc IN ('A', 'C', 'G', 'T'))) GROUP BY ALL"""


def extended_totals(kw: dict) -> str:
    return f"WITH {columns(kw)} SELECT guide_id, mm, CAST(pos AS INT) AS pos, count(*) AS n FROM ev WHERE kind = 'M' AND tc IN ('A', 'C', 'G', 'T') GROUP BY ALL"


CHANNEL = {"plain": ("bulge_dna = 0 AND bulge_rna = 0", "0"), "complete": ("true", "0"), "dna": ("bulge_dna > 0", "bulge_dna"), "rna": ("bulge_rna > 0", "bulge_rna")}


def off_targets(kw: dict, channel: str) -> str:
    where, size = CHANNEL[channel]
    return f"WITH {hits(**kw)} SELECT guide_id, least(mismatches, {kw['mm']}) AS mm, CAST({size} AS INT) AS size, count(*) AS n FROM hits WHERE {where} GROUP BY ALL"


def summary(kw: dict, channel: str) -> str:
    where, _ = CHANNEL[channel]
    return f"""WITH {hits(**kw)}, n AS (SELECT guide_id, count(*) FILTER (mismatches = 0) AS ont, count(*) FILTER (mismatches > 0) AS offt, CAST(sum(mismatches) AS DOUBLE) AS e FROM hits WHERE {where} GROUP BY 1)
SELECT guide_id, coalesce(ont, 0) AS ont, coalesce(offt, 0) AS offt, CASE WHEN coalesce(offt, 0) > 0 THEN round(e / offt, 6) ELSE 0.0 END AS mm_per_offt FROM guides LEFT JOIN n USING (guide_id)"""


def cfd(kw: dict) -> str:
    return f"""WITH {hits(**kw)},
c AS (SELECT *, substr(translate(upper(g), 'T', 'U'), i, 1) AS x, substr(translate(upper(t), 'T', 'U'), i, 1) AS y FROM (
  SELECT *, unnest(range(1, length(g) + 1)) AS i FROM (SELECT row_number() OVER () AS id, *, substr(grna, 1, length(grna) - 3) AS g, substr(spacer, 1, length(spacer) - 3) AS t FROM hits))),
f AS (SELECT id, product(CASE WHEN x = y THEN 1 WHEN x = '-' OR y = '-' THEN (CASE WHEN i = 1 THEN 0 ELSE 1 END)
    WHEN i <= 12 AND x IN ('A', 'C', 'G', 'U') THEN round(0.3017 + 0.0511 * i - CASE WHEN x = 'G' THEN 0.0973 ELSE 0 END, 4) ELSE 1 END) AS p,
  any_value(spacer) AS sp, {', '.join(f'any_value({k}) AS {k}' for k in ('chrom', 'pos', 'strand', 'grna', 'spacer', 'guide_id'))} FROM c GROUP BY id)
SELECT chrom, pos, strand, grna, spacer, guide_id, round(p * CASE upper(right(sp, 2)) WHEN 'GG' THEN 0.9 WHEN 'AG' THEN 0.2 ELSE 1 END, 2) AS cfd_score FROM f"""


BED = "bed AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'annotation1' ELSE 'annotation2' END AS track, 'chr' || (event_id % (SELECT greatest(count(*), 1) FROM documents)) AS chrom, (user_id * 13) % 500 AS s0, (user_id * 13) % 500 + 20 + event_id % 50 AS e0, event_type AS label, event_id AS ord FROM events)"


def annotate(kw: dict, tracks: dict[str, str], leftmost: bool = False) -> str:
    lo = "pos - 1" if leftmost else "CASE WHEN strand = '-' THEN pos - 1 - fp ELSE pos - 1 END"
    cols = ", ".join(f"""coalesce((SELECT string_agg(label, ',' ORDER BY s0, ord) FROM (SELECT label, min(s0) AS s0, min_by(ord, (s0, ord)) AS ord FROM o WHERE o.id = h.id AND ({cond}) GROUP BY label)), 'NA') AS {name}""" for name, cond in tracks.items())
    return f"""WITH {hits(**kw)}, {BED},
h AS MATERIALIZED (SELECT *, {lo} AS lo, {lo} + fp AS hi FROM (SELECT row_number() OVER () AS id, *, length(replace(spacer, '-', '')) AS fp FROM hits)),
o AS MATERIALIZED (SELECT h.id, track, label, s0, ord FROM h JOIN bed ON bed.chrom = h.chrom AND s0 < hi AND lo < e0)
SELECT chrom, pos, strand, spacer, guide_id, {cols} FROM h"""


VARIANTS = f"""vs AS (SELECT l.doc_id, quality, sequence AS s, 'chr' || l.doc_id AS contig, 1 + (l.doc_id * 37) % length(sequence) AS pos FROM labels l JOIN genome g ON g.doc_id = l.doc_id WHERE length(sequence) > 0),
vr AS (SELECT *, substr(s, pos, 1) AS ref FROM vs),
vcf AS (SELECT contig, pos, 'rs' || doc_id AS id, ref, s AS sequence,
  CASE WHEN doc_id % 3 = 0 THEN ref || 'TT' WHEN doc_id % 5 = 0 THEN translate(ref, 'ACGT', 'CGTA') || ',' || translate(ref, 'ACGT', 'GTAC') WHEN doc_id % 11 = 0 THEN translate(ref, 'ACGT', 'CGTA') || ',*' ELSE translate(ref, 'ACGT', 'CGTA') END AS alt,
  CASE WHEN quality = 1 THEN 'PASS' ELSE 'LowQual' END AS filter, '0.' || (10 + doc_id % 90) AS af1, '0.0' || (1 + doc_id % 9) AS af2,
  [CASE doc_id % 4 WHEN 0 THEN '0|1' WHEN 1 THEN '1|1' WHEN 2 THEN '0|0' ELSE '1/2' END, CASE WHEN doc_id % 2 = 0 THEN '0|0' ELSE '0|1' END, CASE WHEN doc_id % 3 = 0 THEN '2|1' ELSE '0|0' END] AS gts FROM vr)"""
ALLELES = f"""{GENOME}, {VARIANTS},
al AS (SELECT contig, pos, id, ref, sequence, gts, af1, af2, filter, string_split(alt, ',')[k] AS alt, CAST(k AS INT) AS allele FROM (SELECT *, unnest(range(1, len(string_split(alt, ',')) + 1)) AS k FROM vcf)),
alleles AS (SELECT contig, pos, id, ref, alt, allele, sequence, filter, CASE allele WHEN 1 THEN af1 ELSE af2 END AS af,
  CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snp' ELSE 'indel' END AS kind, contig || '-' || pos || '-' || ref || '/' || alt AS vid,
  array_to_string(list_filter([CASE WHEN list_contains(regexp_split_to_array(gts[i], '[/|]'), allele::VARCHAR) THEN 's' || i END FOR i IN [1, 2, 3]], lambda x: x IS NOT NULL), ',') AS carriers
  FROM al WHERE alt NOT IN ('*', '.', ''))"""
PASSED = ALLELES + ", ok AS (SELECT * FROM alleles WHERE filter = 'PASS')"
CODE = "CASE m WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'M' WHEN 4 THEN 'G' WHEN 5 THEN 'R' WHEN 6 THEN 'S' WHEN 7 THEN 'V' WHEN 8 THEN 'T' WHEN 9 THEN 'W' WHEN 10 THEN 'Y' WHEN 11 THEN 'H' WHEN 12 THEN 'K' WHEN 13 THEN 'D' WHEN 14 THEN 'B' ELSE 'N' END"
BIT = "CASE {} WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END"
CODES = f"{PASSED}, codes AS (SELECT contig, pos, ref, {CODE} AS code FROM (SELECT contig, pos, min(ref) AS ref, bit_or({BIT.format('ref')} | {BIT.format('alt')}) AS m FROM ok WHERE kind = 'snp' GROUP BY contig, pos))"
INDELS = f"""{PASSED}, iw AS (SELECT *, substr(sequence, CAST(greatest(pos - 50, 1) AS INT), CAST(least(50, pos - 1) AS INT)) AS l, substr(sequence, CAST(pos + length(ref) AS INT), 50) AS r FROM ok WHERE kind = 'indel' AND carriers <> ''),
w AS (SELECT *, l || ref || r AS refseq, l || alt || r AS indelseq FROM iw),
lay AS (SELECT *, CAST(1 + row_number() OVER o AS INT) AS idx, CAST(sum(length(indelseq) + 1) OVER (o ROWS UNBOUNDED PRECEDING) - length(indelseq) - 1 AS BIGINT) AS start FROM w WINDOW o AS (PARTITION BY contig ORDER BY pos, ref, allele, alt)),
layout AS (SELECT *, start + length(indelseq) AS stop FROM lay)"""


def report_rows(kw: dict) -> str:
    return f"{hits(**kw)}, rep AS (SELECT grna, spacer, mismatches, CASE (pos % 7) WHEN 0 THEN 'NA' WHEN 1 THEN 'exon' WHEN 2 THEN 'intron' WHEN 3 THEN 'exon,promoter' ELSE 'promoter' END AS gene FROM hits)"


def logo(kw: dict) -> str:
    cell = lambda s: f"coalesce(count(*) FILTER (sym = '{s}'), 0) / any_value(n.rows) AS \"{s}\""
    return f"""WITH {report_rows(kw)},
n AS (SELECT count(*) AS rows, max(length(replace(grna, '-', ''))) AS len FROM rep),
c AS (SELECT upper(substr(grna, i, 1)) AS g, upper(substr(spacer, i, 1)) AS t, length(replace(substr(grna, 1, i - 1), '-', '')) + 1 AS p FROM (SELECT *, unnest(range(1, length(grna) + 1)) AS i FROM rep)),
e AS (SELECT p, CASE WHEN g = '-' THEN 'D' WHEN t = '-' THEN 'R' WHEN g <> t AND g <> 'N' AND t IN ('A', 'C', 'G', 'T') THEN t END AS sym FROM c)
SELECT CAST(x.p AS INT) AS position, {', '.join(cell(s) for s in 'ACGTDR')} FROM (SELECT unnest(range(1, len + 1)) AS p FROM n) x CROSS JOIN n LEFT JOIN e ON e.p = x.p GROUP BY x.p"""


def radar(kw: dict, top: int, per_guide: bool) -> str:
    key = "replace(grna, '-', '')" if per_guide else "'all'"
    show = "guide, " if per_guide else ""
    return f"""WITH {report_rows(kw)},
k AS (SELECT unnest(range(0, {top + 1})) AS ceiling),
c AS (SELECT {key} AS guide, ceiling, gene AS label, count(*) AS n FROM rep JOIN k ON mismatches <= ceiling WHERE gene <> 'NA' GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY guide, ceiling) AS most FROM c) WHERE n > 0.1 * most)
SELECT {show}CAST(ceiling AS INT) AS ceiling, label, n, n / sum(n) OVER (PARTITION BY guide, ceiling) AS part FROM f"""


def logo_by_guide(kw: dict) -> str:
    """As ``logo`` for each guide; the places of the PAM's ``N`` are left out and the others renumbered."""
    cell = lambda s: f"count(*) FILTER (sym = '{s}') / any_value(x.rows) AS \"{s}\""
    return f"""WITH {report_rows(kw)},
r AS (SELECT *, replace(grna, '-', '') AS guide FROM rep),
n AS (SELECT guide, count(*) AS rows FROM r GROUP BY guide),
x AS (SELECT guide, rows, p, row_number() OVER (PARTITION BY guide ORDER BY p) AS place FROM (SELECT guide, rows, unnest(range(1, length(guide) + 1)) AS p FROM n) WHERE substr(guide, p, 1) <> 'N'),
c AS (SELECT guide, upper(substr(grna, i, 1)) AS g, upper(substr(spacer, i, 1)) AS t, length(replace(substr(grna, 1, i - 1), '-', '')) + 1 AS p FROM (SELECT *, unnest(range(1, length(grna) + 1)) AS i FROM r)),
e AS (SELECT guide, p, CASE WHEN g = '-' THEN 'D' WHEN t = '-' THEN 'R' WHEN g <> t AND g <> 'N' AND t IN ('A', 'C', 'G', 'T') THEN t END AS sym FROM c)
SELECT x.guide, CAST(x.place AS INT) AS position, {', '.join(cell(s) for s in 'ACGTDR')} FROM x LEFT JOIN e ON e.guide = x.guide AND e.p = x.p GROUP BY x.guide, x.place"""


def profile_cells(kw: dict, cell: str) -> str:
    """Cells of a profile file by guide and position."""
    return f"SELECT DISTINCT guide, pos, {cell} AS cell FROM ({position_counters(kw)}) JOIN ({GUIDE_LIST}) USING (guide_id)"


GUIDE_LIST = f"WITH {GENOME}, {GUIDES} SELECT guide_id, guide FROM guides"


def extended_file(kw: dict) -> str:
    ext = extended(kw)
    return f"""WITH x AS ({ext}), k AS (SELECT unnest(['A', 'C', 'G', 'T', 'DNA', 'RNA']) AS symbol)
SELECT CASE WHEN length(symbol) = 1 THEN 'NUCLEOTIDE ' ELSE 'BULGE ' END || symbol AS kind, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM k LEFT JOIN x USING (symbol) GROUP BY symbol
UNION ALL SELECT 'MISMATCHES', CAST(coalesce(sum(n), 0) AS BIGINT) FROM x WHERE length(symbol) = 1"""


GATE = """WITH m AS (SELECT unnest(['CCCA','ATTN','NGA','NGC','NGG','NGK','NGN','NNG','NNGRRT','NNNNGATT','NNNRRT','NRG','TATV','TCCA','TCTA','TTCN','TTN','TTTA','TTTN','TTTR','TTTV','TTYN','TYCV','YTTV']) AS motif),
s AS (SELECT motif, u AS upstream, CASE
  WHEN u AND motif = 'TTCN' THEN 'CasX' WHEN u AND motif IN ('NNGRRT', 'NNNRRT') THEN 'SaCas9'
  WHEN u AND motif NOT LIKE 'N%' THEN 'Cas12a'
  WHEN NOT u AND motif IN ('NGG', 'NGA', 'NRG', 'NGC') THEN 'SpCas9' WHEN NOT u AND motif IN ('NGK', 'NGN', 'NNG') THEN 'xCas9' ELSE 'unknown' END AS cas_system
  FROM m, (VALUES (false), (true)) v(u))
SELECT motif, upstream, cas_system, cas_system IN ('SpCas9', 'xCas9') AS scored FROM s"""
