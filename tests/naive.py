"""A naive search in plain Python: positions, strands and alignments one by one."""

from siteseer.functions.iupac import CODES, reverse_complement_text


def fits(code, base):
    return base in CODES and bool(set("ACGT" if code == "N" else CODES[code]) & set(CODES[base]))


def alignments(query, body, mm, dna, rna, single):
    """(guide, target) strings from the PAM outwards."""
    out = set()

    def go(i, j, m, d, r, a, t):
        if i == len(query):
            out.add((a, t, m, d, r))
            return
        if j >= len(body):
            return
        same = fits(query[i], body[j])
        if same or m < mm:
            go(i + 1, j + 1, m + (not same), d, r, a + query[i], t + (body[j] if same else body[j].lower()))
        if d < dna and j + 1 < len(body) and not (single and r):
            go(i, j + 1, m, d + 1, r, a + "-", t + body[j])
        if r < rna and not (single and d):
            go(i + 1, j, m, d, r + 1, a + query[i], t + "-")

    go(0, 0, 0, 0, 0, "", "")
    return out


def sites(sequence, pam, bmax):
    size = pam.total + bmax
    for p in range(len(sequence) - size + 1):
        for strand in "+-":
            w = sequence[p : p + size] if strand == "+" else reverse_complement_text(sequence[p : p + size])
            motif = w[: pam.size] if pam.upstream else w[size - pam.size :]
            if "N" in w or not all(fits(c, b) for c, b in zip(pam.motif, motif)):
                continue
            yield strand, p, w[pam.size :] if pam.upstream else w[: size - pam.size][::-1], motif


def search(sequence, guide, pam, mm, dna=0, rna=0, single=False, bmax=0):
    """Set of (pos, strand, grna, spacer, mm, dna, rna)."""
    out, size = set(), pam.total + bmax
    for strand, p, body, motif in sites(sequence, pam, bmax):
        for a, t, m, d, r in alignments(guide if pam.upstream else guide[::-1], body, mm, dna, rna, single):
            used = len(t.replace("-", "")) + pam.size
            at_right = (strand == "+") != pam.upstream
            left = p + size - used if at_right else p
            g, s = (pam.motif + a, motif + t) if pam.upstream else (a[::-1] + pam.motif, t[::-1] + motif)
            out.add((left + 1, strand, g, s, m, d, r))
    return out
