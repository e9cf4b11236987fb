"""Document fingerprints from prefix polynomial hashes.

One modular prefix array per text answers the hash of any span of code points
in constant time: two spans are equal when their hashes are, and the longest
common extension of two places is found by binary search over span lengths.
Two moduli of 31 bits and fixed bases make false matches negligible (the
chance is about length / 2**61 a comparison).

A fingerprint samples span hashes: every span of ``SPAN`` code points falls
into one of ``SLOTS`` slots by its hash, and each slot keeps 16 bits of its
least hash and the first place of that span.  Texts shorter than a span are
one span.  A fingerprint is four hexadecimal digits per slot (``0000``: no
span), so equal texts have equal fingerprints.

Two fingerprints are compared with the prefix arrays behind them.  Slots that
agree are anchors; an anchor counts if its two spans are equal, and grows to
both sides by longest common extension.  Likeness is the share of code points
of both texts that lie in such common runs: 1 for equal texts, 0 where no
anchor agrees.

Defined cases: a null text is empty, its fingerprint is all zeros, and two
empty texts have likeness 1; rows with one ``doc_id`` follow each other by
text; null ids come first; a single row is its own next document; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._dist import small_batches
from ._text import release

MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911382323, 972663749)
SPAN, SLOTS = 16, 64
CHUNK_CHARS = 1 << 19
#: Ranges of ids at most.  Rows stream through the task of their range, so more rows make it longer, not larger.
MAX_RANGES = 1 << 16
#: Ids sampled per range to place the cuts; the sample only balances the ranges.
SAMPLED = 64
U = np.uint64
_powers: dict[int, np.ndarray] = {}


def _pow_table(n: int, which: int, inverse: bool) -> np.ndarray:
    """Powers modulo one modulus by repeated doubling."""
    key = 2 * which + inverse
    if key not in _powers or len(_powers[key]) < n:
        p = MODULI[which]
        base = pow(BASES[which], -1, p) if inverse else BASES[which]
        t, m = np.ones(1, U), max(n, CHUNK_CHARS + (1 << 17))
        while len(t) < m:
            t = np.concatenate([t, t * U(pow(base, len(t), p)) % U(p)])
        _powers[key] = t
    return _powers[key][:n]


class Prefix:
    """Prefix arrays of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.acc, self.down = [], []
        for w, p in enumerate(MODULI):
            terms = (codes.astype(U) + U(1)) * _pow_table(self.n, w, False) % U(p)
            acc = np.zeros(self.n + 1, U)
            np.cumsum(terms, out=acc[1:])  # sums stay below 2**64 for 2**32 code points
            self.acc.append(acc)
            self.down.append(_pow_table(self.n + 1, w, True))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of spans."""
        out = np.zeros(len(start), U)
        for acc, down, p in zip(self.acc, self.down, MODULI):
            out = out << U(31) | (acc[end] - acc[start]) % U(p) * down[start] % U(p)
        return out

    def equal(self, i: int, j: int, length: int) -> bool:
        a = np.array([i, j])
        h = self.spans(a, a + length)
        return bool(h[0] == h[1])

    def common_extension(self, i: int, j: int) -> int:
        """Length of the longest common run that starts at ``i`` and at ``j``."""
        return int(extensions(self, self, np.array([i]), np.array([j]), np.array([self.n - max(i, j)]))[0])


def extensions(p: Prefix, q: Prefix, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
    """Longest common runs that start at places ``i`` of one sequence and ``j`` of another, or end there, up to ``most``.

    All searches advance together: a step halves every interval of lengths.
    """
    lo, hi = np.zeros(len(i), np.int64), most.astype(np.int64)
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live] + 1) // 2
        a, b = i[live], j[live]
        same = p.spans(a - mid, a) == q.spans(b - mid, b) if back else p.spans(a, a + mid) == q.spans(b, b + mid)
        lo[live], hi[live] = np.where(same, mid, lo[live]), np.where(same, hi[live], mid - 1)
    return lo


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sketches:
    """Fingerprints of several texts as a matrix of 16-bit values, with the prefix arrays and places behind them."""

    def __init__(self, texts: list[np.ndarray], span: int = SPAN, slots: int = SLOTS):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.n)])
        self.span, self.values = span, np.zeros((len(texts), slots), np.uint16)
        self.place = np.zeros((len(texts), slots), np.int64)
        self.prefix = Prefix(np.concatenate(texts) if texts else np.zeros(0, np.uint32))
        count = np.where(self.n >= span, self.n - span + 1, (self.n > 0).astype(np.int64))
        total = int(count.sum())
        if not total:
            return
        first = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(texts)), count)
        start = np.arange(total) - first[doc] + self.offs[doc]
        h = _mix(self.prefix.spans(start, np.minimum(start + span, self.offs[doc + 1])))
        slot = doc * slots + (h >> U(58)).astype(np.int64) % slots
        h &= U((1 << 58) - 1)
        least = np.full(len(texts) * slots, np.iinfo(np.uint64).max, U)
        np.minimum.at(least, slot, h)
        got = least != np.iinfo(np.uint64).max
        # 0 is kept for slots without a span
        self.values.reshape(-1)[got] = (_mix(least[got]) % U(65535) + U(1)).astype(np.uint16)
        at = np.flatnonzero(h == least[slot])[::-1]  # the first place is written last
        self.place.reshape(-1)[slot[at]] = start[at]


def likeness(a: Sketches, x: np.ndarray, b: Sketches, y: np.ndarray) -> np.ndarray:
    """Likeness of text ``x[i]`` of one group and ``y[i]`` of another; no text is in two pairs of a side."""
    pair, slot = np.nonzero((a.values[x] == b.values[y]) & (a.values[x] != 0))
    i, j = a.place[x[pair], slot], b.place[y[pair], slot]
    size = np.minimum(a.span, a.n[x[pair]])
    fits = (size == np.minimum(b.span, b.n[y[pair]])) & (size > 0)
    pair, i, j, size = pair[fits], i[fits], j[fits], size[fits]
    same = a.prefix.spans(i, i + size) == b.prefix.spans(j, j + size)
    pair, i, j = pair[same], i[same], j[same]
    ahead = extensions(a.prefix, b.prefix, i, j, np.minimum(a.offs[x[pair] + 1] - i, b.offs[y[pair] + 1] - j))
    behind = extensions(a.prefix, b.prefix, i, j, np.minimum(i - a.offs[x[pair]], j - b.offs[y[pair]]), back=True)
    covered = _union(pair, i - behind, i + ahead, len(x)) + _union(pair, j - behind, j + ahead, len(x))
    whole = a.n[x] + b.n[y]
    return np.where(whole > 0, covered / np.maximum(whole, 1), 1.0)


def _union(pair: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Length of the union of the intervals of each pair; intervals of different pairs do not meet."""
    order = np.argsort(start, kind="stable")
    pair, start, end = pair[order], start[order], end[order]
    upto = np.maximum.accumulate(end) if len(end) else end
    before = np.concatenate([np.zeros(min(1, len(end)), np.int64), upto[:-1]])
    return np.bincount(pair, np.maximum(0, end - np.maximum(start, before)), minlength=n)


def _hex(m: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in m]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _groups(texts: list[np.ndarray]):
    """Ranges of texts of bounded size, at least one text each."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` per row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            codes = [_codes(t or "") for t in b.column(1).to_pylist()]
            hexes = [h for i, j in _groups(codes) for h in _hex(Sketches(codes[i:j]).values)]
            yield pa.record_batch({"doc_id": b.column(0), "n_chars": np.array([len(c) for c in codes], np.int64), "fingerprint": pa.array(hexes, pa.string())})
        release()

    return small_batches(docs).select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def range_of(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below ``x``, by two short scans."""
    if not cuts:
        return F.lit(0)
    w = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + w] for i in range(0, len(cuts), w)]
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= x))
    ends = F.from_json(F.lit(json.dumps([r[-1] for r in rows])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    at = below(ends)
    return at * w + F.coalesce(below(F.get(table, at)), F.lit(0)) - F.when(at >= len(rows), F.lit(len(rows) * w - len(cuts))).otherwise(F.lit(0))


def range_cuts(ids: DataFrame, n: int, ranges: int) -> list[int]:
    """About equal ranges of the ids ``i``; at most ``SAMPLED * ranges`` ids reach the driver."""
    if ranges < 2:
        return []
    some = ids if SAMPLED * ranges >= n else ids.sample(SAMPLED * ranges / n, 17)
    got = np.sort(some.toArrow()["i"].to_numpy())
    return sorted({int(got[len(got) * j // ranges]) for j in range(1, ranges)}) if len(got) else []


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = 4000) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness.

    The edited text has its last ``floor(n / 2)`` code points replaced by the
    first as many of the next document by id (the last: of the first).  Ids are
    cut into ranges; texts move once, a range to a task, and each range also
    gets a copy of the first document of the range after it.
    """
    src = small_batches(docs).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = src.select(least.alias("i"))
    n = ids.count()
    cuts = range_cuts(ids, n, min(MAX_RANGES, -(-n // rows_per_range)))
    src = src.withColumn("r", range_of(least, cuts).cast("int"))
    # the first row of each range: as many rows as there are ranges
    firsts = src.groupBy("r").agg(F.min(F.struct(least.alias("i"), F.xxhash64("text").alias("h"))).alias("k")).orderBy("r").collect()
    if not firsts:
        return docs.sparkSession.createDataFrame([], OUT)
    goes = {}
    for at, row in enumerate(firsts):
        goes[row["k"]["i"], row["k"]["h"]] = firsts[at - 1]["r"]
    table = docs.sparkSession.createDataFrame([(i, h, r) for (i, h), r in goes.items()], "fi bigint, fh bigint, fr int")
    # at most MAX_RANGES rows of 20 bytes
    src = src.join(F.broadcast(table), (least == F.col("fi")) & (F.xxhash64("text") == F.col("fh")), "left")
    own, halo = F.struct("r", F.lit(0).alias("halo")), F.struct(F.col("fr").alias("r"), F.lit(1).alias("halo"))
    copies = F.when(F.col("fr").isNull(), F.array(own)).otherwise(F.array(own, halo))
    sent = src.select("doc_id", "text", F.explode(copies).alias("c")).select("c.r", "c.halo", least.alias("i"), "doc_id", F.xxhash64("text").alias("h"), "text")
    return sent.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("r", "halo", "i", "h").mapInArrow(_pairs, OUT)


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows sorted by range, halo and id: each real row meets the row after it."""
    held = None  # the last row, its next not yet seen: (range, id, codes)
    for b in batches:
        r, halo, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(5)
        at = 0
        while at < len(r):
            rows, size = ([held] if held else []), 0
            while at < len(r) and size < CHUNK_CHARS:
                c = _codes(texts[at].as_py())
                rows.append((r[at], halo[at], ids[at], c))
                size += len(c)
                at += 1
            held = rows[-1]
            if len(rows) > 1:
                yield _emit(rows)
    # the last row of a range is always a halo row, so nothing is left over
    release()


def _emit(rows) -> pa.RecordBatch:
    """Results of all rows but halo rows, each with the row after it; the last row is only a next one."""
    real = np.array([i for i in range(len(rows) - 1) if rows[i][1] == 0], np.int64)
    codes = [x[3] for x in rows]
    edited = []
    for i in real.tolist():
        half = len(codes[i]) // 2
        edited.append(np.concatenate([codes[i][: len(codes[i]) - half], codes[i + 1][:half]]))
    own, new = Sketches(codes), Sketches(edited)
    prints = _hex(own.values)
    return pa.record_batch({
        "doc_id": pa.array([rows[i][2] for i in real], pa.int64()),
        "n_chars": own.n[real],
        "edited_sha256": pa.array([hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode()).hexdigest() for e in edited], pa.string()),
        "fingerprint": pa.array([prints[i] for i in real], pa.string()),
        "edited_fingerprint": pa.array(_hex(new.values), pa.string()),
        "near_edited": likeness(own, real, new, np.arange(len(real))),
        "near_next": likeness(own, real, own, real + 1),
    })
