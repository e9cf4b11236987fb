"""N-gram Jaccard join by multiple-global-order prefix filtering.

A document's set is its distinct shingles of ``k`` words, and an order is a
hash order of all shingles.  Two steps find every link:

1. Documents that share the first shingle of their prefixes under three orders
   of a band meet the least document of that list, and go on if they share the
   first shingle under most orders.  Verified links give first components.
2. What may be missing lies between components.  For a threshold of ``pct``
   percent, linked sets share a shingle among the first
   ``n - ceil(pct * n / 100) + 1`` of each, under *any* order, and ``e`` of them
   if the prefixes are ``e - 1`` longer.  A document stays only if, order after
   order, enough of its longer prefix occurs in prefixes of other components.
   Those left meet the documents of a size near their own on the list of each
   prefix shingle, under all orders at once.  Two of a list are chained if the
   parity bitmaps of their sets differ in no more places than the sets of a
   link can, which loses no link; the filters are intersected, as candidates
   must lie in one component under every order; and they are verified too.

Pairs of a list are looked at in memory, and only a forest of those that are
chained leaves the task.  Sets travel once to their candidate group, where
overlaps are counted exactly (on 52 bits of each shingle's hash) and pairs that
are connected already are skipped.  Groups beyond ``BLOCK`` members or
``BLOCK_SHINGLES`` shingles are dealt out in blocks, and members outside the
largest component meet every block in a second step, so no group is held whole
and no link is lost.  Shingles common in the corpus come last in every order of step 2; they
are counted over all documents.

Equal sets count as one member until the end.

Defined cases: null, empty and blank texts have an empty set and no link; a
text with fewer than ``k`` words has its whole sequence as one shingle; rows
with one ``doc_id`` are one document to ``join_components``, so that their
links meet there, and each has a row of its own, and are documents of their
own to ``keep_one``; a null ``doc_id`` takes no part and is its own (null)
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import bucket_count, connected_components, discard, least_of_component, small_batches, small_reads, stash, text_bytes
from ._lookup import Found, Turn, by_turns, turns, without
from ._text import LOWER, U, chunks, deltas, doc_of, flat, mix, pack, release, unpack, windows, words

#: First filter: bands of orders, and orders in all under which first shingles must agree.
BANDS, ROWS, AGREE = 5, 3, 9
ORDERS = 3
#: By how much of a set the prefixes of the first filters are longer than they must be.
EXTRA = 0.15
BUCKET_BYTES = 24 << 20
#: Prefix shingles whose lists become links in one bucket, and pairs of a list that are tested at once.
EDGE_BUCKET = 1 << 20
PAIRS = 1 << 20
#: A shingle in more than this share of documents (and 32) counts as common.
COMMON = 1 / 2000
#: Members of a candidate group, and shingles of all of them, in one block; a task compares up to two blocks.
BLOCK = 2000
BLOCK_SHINGLES = 1 << 20
FLUSH = 1 << 20


def sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted, with offsets."""
    h, wo = words(buf, offs, LOWER)
    sh, so = windows(h, wo, k)
    parts, n = [], np.diff(wo).tolist()
    at = so.tolist()
    for i, m in enumerate(n):
        if m >= k:
            x = sh[at[i] : at[i + 1]]
            x.sort()
            parts.append(x)
        elif m:
            parts.append(windows(h[wo[i] : wo[i + 1]], np.array([0, m]), m, seed=100 + m)[0])
    if not parts:
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    flat_ = np.concatenate(parts)
    has = np.flatnonzero(np.array(n))
    first = np.zeros(len(flat_), bool)
    sizes = np.array([len(x) for x in parts])
    first[np.cumsum(sizes) - sizes] = True
    keep = first.copy()
    keep[1:] |= flat_[1:] != flat_[:-1]
    upto = np.concatenate([[0], np.cumsum(keep)])
    count = np.zeros(len(n), np.int64)
    ends = np.cumsum(sizes)
    count[has] = upto[ends] - upto[ends - sizes]
    return flat_[keep], np.concatenate([[0], np.cumsum(count)])


def each_set(batches, k: int, with_component: bool = False):
    """Chunks of documents as (ids, [components,] shingles, offsets)."""
    for b in batches:
        buf, offs = flat(b.column(1))
        lead = [b.column(0).to_numpy(), *([b.column(2).to_numpy()] if with_component else [])]
        for i, j in chunks(offs):
            yield *[x[i:j] for x in lead], *sets(buf, offs[i : j + 1], k)


def met(batches, blobs: list, only: bool):
    """``(doc_id, text, component)`` of the documents that take part.

    ``blobs`` have components by id, of copies their own id: copies drop out.
    With ``only`` nothing but the ids they have takes part, each with the
    component it has there; else ids that they do not have are their own.
    """
    found = Found(blobs)
    for b in batches:
        did = b.column(0).to_numpy()
        row, value = found(did)
        comp, keep = did.copy(), np.full(len(did), not only)
        comp[row] = value
        keep[row] = True if only else value != did[row]
        if keep.any():
            kept = b.select([0, 1]).filter(pa.array(keep))
            yield pa.record_batch({"doc_id": kept.column(0), "text": kept.column(1), "comp": comp[keep]})


def prefix_size(n: np.ndarray, pct: int) -> np.ndarray:
    return n - (pct * n + 99) // 100 + 1


def signatures(sh: np.ndarray, so: np.ndarray) -> pa.Array:
    """The first shingle of each set under every order of the bands, 31 bits of it."""
    n = len(so) - 1
    out = np.zeros((n, BANDS * ROWS), np.int32)
    has = np.flatnonzero(np.diff(so))
    if len(has):
        for o in range(BANDS * ROWS):
            least = np.minimum.reduceat(mix(sh, 61 + o), so[has])
            out[has, o] = (least >> U(33)).astype(np.int32)
    return pa.ListArray.from_arrays(np.arange(0, out.size + 1, BANDS * ROWS, dtype=np.int32), pa.array(out.reshape(-1)))


def band_edges(classes: DataFrame) -> DataFrame:
    """``(part, a, b)`` between class representatives that share a band and agree under most orders."""
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(BANDS)])
    rows = classes.select("rep", "sig", F.explode(keys).alias("key"))
    heads = rows.groupBy("key").agg(F.min(F.struct("rep", "sig")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "head")
    same = F.size(F.filter(F.zip_with("sig", F.col("head.sig"), lambda x, y: x == y), lambda x: x))
    j = rows.join(heads, "key").where((F.col("rep") != F.col("head.rep")) & (same >= AGREE))
    return j.select(F.lit(0).alias("part"), F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct()


def survey(docs: DataFrame, k: int, share: float) -> DataFrame:
    """One pass: set sizes and digests of all documents, and counts of shingles that may be common.

    Rows with a ``doc_id`` are ``(doc_id, sig, n, d1, d2)``.  Rows without are
    ``(d1: shingle, n: count)``: a flush of many documents reports a shingle
    only above half of ``share`` of its own documents, so every shingle above
    the share in the corpus is reported, with at least half its count.
    """

    def run(batches):
        held, size, docs_held = [], 0, 0

        def flush():
            v = np.concatenate(held)
            v.sort()
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            c = np.diff(np.concatenate([at, [len(v)]]))
            keep = c > max(1, docs_held * share / 2)
            v, c = v[at[keep]].view(np.int64), c[keep].astype(np.int64)
            return pa.record_batch({"doc_id": pa.nulls(len(v), pa.int64()), "sig": pa.nulls(len(v), pa.list_(pa.int32())), "n": c, "d1": v, "d2": np.zeros(len(v), np.int64)})

        for did, sh, so in each_set(batches, k):
            a = np.concatenate([np.zeros(1, U), np.cumsum(mix(sh, 21))])
            c = np.concatenate([np.zeros(1, U), np.cumsum(mix(sh, 22))])
            yield pa.record_batch({"doc_id": did, "sig": signatures(sh, so), "n": np.diff(so).astype(np.int64), "d1": (a[so[1:]] - a[so[:-1]]).view(np.int64), "d2": (c[so[1:]] - c[so[:-1]]).view(np.int64)})
            held.append(sh)
            size += len(sh)
            docs_held += len(did)
            if size >= FLUSH:
                yield flush()
                held, size, docs_held = [], 0, 0
        if size:
            yield flush()
        held = []
        release()

    return docs.mapInArrow(run, "doc_id bigint, sig array<int>, n bigint, d1 bigint, d2 bigint")


def common_shingles(surveyed: DataFrame, n_docs: int, share: float) -> np.ndarray:
    """Shingles in more than about ``share`` of all documents.

    At most ``2 * shingles per document / share`` come back, whatever the corpus.
    """
    got = surveyed.where(F.col("doc_id").isNull()).groupBy("d1").agg(F.sum("n").alias("c")).where(F.col("c") > max(32, n_docs * share / 2))
    return np.sort(np.array([r["d1"] for r in got.select("d1").collect()], np.int64).view(U))


def prefixes(docs: DataFrame, view: list[Turn], only: bool, k: int, pct: int, common: np.ndarray, buckets: int, orders: list[int], extra: float = 0.0) -> DataFrame:
    """``(part, bucket, blob)``: packed (shingle, document) of the prefixes under each order, of the documents that ``met`` lets through.

    With ``extra`` a prefix is longer by that share of the set.
    """
    shift = U(64 - (buckets.bit_length() - 1))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(common)

    def flush(held, o):
        d, c, h = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        d, c, h = d[order], c[order], h[order]
        at = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U))
        rows = [i for i in range(buckets) if at[i] < at[i + 1]]
        blobs = []
        for i in rows:
            ids, one, inv = np.unique(d[at[i] : at[i + 1]], return_index=True, return_inverse=True)
            blobs.append(pack(deltas(ids), deltas(c[at[i] : at[i + 1]][one]), deltas(h[at[i] : at[i + 1]]), inv.astype(np.uint32)))
        return pa.record_batch({"part": pa.array([o] * len(rows), pa.int32()), "bucket": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def run(batches, blobs):
        heavy = shared.value
        held, size = {o: [] for o in orders}, 0
        for did, comp, sh, so in each_set(met(batches, blobs.value, only), k, with_component=True):
            n = np.diff(so)
            p = np.where(n > 0, np.minimum(n, prefix_size(n, pct) - 1 + shared_least(n, extra)), 0)
            late = np.zeros(len(sh), U)
            if len(heavy) and len(sh):
                i = np.minimum(np.searchsorted(heavy, sh), len(heavy) - 1)
                late = (heavy[i] == sh).astype(U) << U(63)
            own, owns = np.repeat(did, p), np.repeat(comp, p)
            for o in orders:
                key = (mix(sh, 31 + o) >> U(1)) | late
                picked = []
                for a, z, m in zip(so[:-1].tolist(), so[1:].tolist(), p.tolist()):
                    if m:
                        picked.append(a + (np.argpartition(key[a:z], m - 1)[:m] if m < z - a else np.arange(z - a)))
                if picked:
                    held[o].append((own, owns, sh[np.concatenate(picked)]))
            size += int(p.sum())
            if size >= FLUSH:
                yield from (flush(x, o) for o, x in held.items() if x)
                held, size = {o: [] for o in orders}, 0
        yield from (flush(x, o) for o, x in held.items() if x)
        release()

    return by_turns(docs, view, lambda own, blobs: own.mapInArrow(lambda b: run(b, blobs), "part int, bucket int, blob binary"))


def shared_least(n: np.ndarray, extra: float) -> np.ndarray:
    """Prefix shingles that a set of size ``n`` and its partner have in common, if both prefixes are so much longer."""
    return np.maximum(1, np.floor(n * extra)).astype(np.int64)


def supported(blobs: DataFrame, sizes: DataFrame, pct: int, extra: float, groups: int) -> DataFrame:
    """``doc_id`` of documents with enough prefix shingles in other prefixes to have a partner.

    Two linked sets share the first ``shared_least`` of their common shingles
    in both longer prefixes; the partner is at least ``pct`` percent as large.
    """

    def run(key, table):
        _, d, _, size, mixed = _lists(table)
        ids, c = np.unique(d[np.repeat(mixed, size)], return_counts=True)
        g = (mix(ids.view(U), 5) % U(groups)).astype(np.int32)
        order = np.argsort(g, kind="stable")  # ids stay sorted in a group
        ids, c, at = ids[order], c[order].astype(np.uint32), np.searchsorted(g[order], np.arange(groups + 1))
        full = [i for i in range(groups) if at[i] < at[i + 1]]
        blobs = [pack(deltas(ids[at[i] : at[i + 1]]), c[at[i] : at[i + 1]]) for i in full]
        return pa.table({"grp": pa.array(full, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def add(table):
        parts = [unpack(x.as_py()) for x in table.column("blob")]
        ids, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in parts]), return_inverse=True)
        c = np.bincount(at, np.concatenate([x[1] for x in parts]))
        return pa.table({"doc_id": ids, "c": c.astype(np.int64)})

    # counts of many documents travel packed, a blob per bucket and group of documents
    got = blobs.groupBy("part", "bucket").applyInArrow(run, "grp int, blob binary").groupBy("grp").applyInArrow(add, "doc_id bigint, c bigint")
    need = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * (pct / 100)) * extra))
    return got.join(sizes.groupBy("doc_id").agg(F.min("n").alias("n")), "doc_id").where(F.col("c") >= need).select("doc_id")


def _lists(table) -> tuple[np.ndarray, ...]:
    """Packed prefixes by shingle: shingles, documents, starts and sizes of lists, and which of them span components."""
    hs, ids, comps = [], [], []
    for blob in table.column("blob"):
        u, c, h, inv = unpack(blob.as_py())
        hs.append(np.cumsum(h))
        ids.append(np.cumsum(u)[inv])
        comps.append(np.cumsum(c)[inv])
    h, d, c = np.concatenate(hs), np.concatenate(ids), np.concatenate(comps)
    order = np.argsort(h)
    h, d, c = h[order], d[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.concatenate([first, [len(h)]]))
    mixed = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    return h, d, first, size, mixed


def size_classes(most: int, pct: int) -> np.ndarray:
    """Least sizes of the classes up to ``most``: sizes of a link lie in one class or in two that are neighbours."""
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * 100 // pct + 1)
    return np.array(least, np.int64)


def class_buckets(least: np.ndarray, shingles: dict[int, int], pct: int) -> np.ndarray:
    """Buckets of every group of classes; ``shingles`` has them by size.  A group is a class with the one below."""
    own = np.zeros(len(least) + 1)
    for n, c in shingles.items():
        g = int(np.searchsorted(least, n, "right")) - 1
        own[g : g + 2] += c * (100 - pct) / 100
    return np.maximum(1, np.ceil(own / EDGE_BUCKET)).astype(np.int64)


def bitmap_words(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the bitmap of a set of size ``n``: the least power of two with a bit per shingle."""
    return 1 << np.ceil(np.log2(np.maximum(1, (n + 63) // 64))).astype(np.int64)


def bitmaps(sh: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all sets, with offsets: a bit says whether an odd number of shingles falls on it.

    Two bitmaps differ in no more bits than the sets have shingles apart.
    """
    w = bitmap_words(np.diff(so))
    wo = np.concatenate([[0], np.cumsum(w)])
    d = doc_of(so)
    at = wo[d] * 64 + (mix(sh, 91).view(np.int64) & (w[d] * 64 - 1))
    odd = (np.bincount(at, minlength=int(wo[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U), wo


def _rows_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def prefix_rows(docs: DataFrame, view: list[Turn], k: int, pct: int, common: np.ndarray, least: np.ndarray, buckets: np.ndarray, orders: list[int]) -> DataFrame:
    """``(part, bucket, blob)``: packed sets and shingles of their prefixes under each order, by group of size classes; of the ids in ``view``."""
    base = np.concatenate([[0], np.cumsum(buckets)])
    shared = docs.sparkSession.sparkContext.broadcast((common, least, buckets, base))

    def flush(sets_, tokens, o):
        _, least, buckets, base = shared.value
        did, comp, n, words_, sizes = (np.concatenate(x) for x in zip(*sets_))
        starts = np.cumsum(sizes) - sizes
        first = np.cumsum([0, *[len(x[0]) for x in sets_]])
        row = np.concatenate([r + f for (r, _), f in zip(tokens, first)])
        h = np.concatenate([x for _, x in tokens])
        cls = np.searchsorted(least, n, "right") - 1
        out = []
        for up in (0, 1):
            g = cls[row] + up
            to = base[g] + ((h >> U(32)) * buckets[g].astype(U) >> U(32)).astype(np.int64)
            order = np.lexsort((h, to))
            to = to[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            for a, z in zip(at.tolist(), [*at[1:].tolist(), len(to)]):
                r, inv = np.unique(row[order[a:z]], return_inverse=True)
                blob = pack(deltas(did[r]), deltas(comp[r]), n[r], deltas(h[order[a:z]]), inv.astype(np.uint32), words_[_rows_of(starts[r], sizes[r])])
                out.append((int(to[a]), up == 0, blob))
        return pa.record_batch({"part": np.full(len(out), o, np.int32), "bucket": pa.array([x[0] for x in out], pa.int64()), "home": pa.array([x[1] for x in out], pa.bool_()), "blob": pa.array([x[2] for x in out], pa.binary())})

    def run(batches, blobs):
        heavy = shared.value[0]
        held, tokens, size = [], {o: [] for o in orders}, 0
        for did, comp, sh, so in each_set(met(batches, blobs.value, True), k, with_component=True):
            n = np.diff(so)
            p = np.where(n > 0, prefix_size(n, pct), 0)
            if not p.any():
                continue
            words_, wo = bitmaps(sh, so)
            late = np.zeros(len(sh), U)
            if len(heavy):
                i = np.minimum(np.searchsorted(heavy, sh), len(heavy) - 1)
                late = (heavy[i] == sh).astype(U) << U(63)
            held.append((did, comp, n, words_, np.diff(wo)))
            row = np.repeat(np.arange(len(n)), p)
            for o in orders:
                key = (mix(sh, 31 + o) >> U(1)) | late
                picked = [a + (np.argpartition(key[a:z], m - 1)[:m] if m < z - a else np.arange(z - a)) for a, z, m in zip(so[:-1].tolist(), so[1:].tolist(), p.tolist()) if m]
                tokens[o].append((row, sh[np.concatenate(picked)]))
            size += int(p.sum())
            if size >= FLUSH:
                yield from (flush(held, x, o) for o, x in tokens.items())
                held, tokens, size = [], {o: [] for o in orders}, 0
        if held:
            yield from (flush(held, x, o) for o, x in tokens.items())
        release()

    return by_turns(docs, view, lambda own, blobs: own.mapInArrow(lambda b: run(b, blobs), "part int, bucket bigint, home boolean, blob binary"))


def _pairs(row: np.ndarray, h: np.ndarray, n: np.ndarray, pct: int):
    """Pairs of rows on one list whose sizes a link allows, the smaller first, in batches; ``row`` and ``h`` are sorted by list and size."""
    end = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    end = end[np.searchsorted(end, np.arange(len(h)), "right")]
    live, off = np.arange(len(h)), 1
    while True:
        live = live[live + off < end[live]]
        # sizes only grow along a list
        live = live[n[row[live + off]] * pct <= 100 * n[row[live]]]
        if not len(live):
            return
        yield row[live], row[live + off]
        off += 1


def prefix_edges(rows: DataFrame, pct: int) -> DataFrame:
    """``(part, a, b)``: a forest of the documents that share a prefix shingle and whose bitmaps allow a link; components known already add nothing."""

    def run(key, table):
        ids, comps, ns, homes, hs, invs, maps = [], [], [], [], [], [], []
        at = 0
        for home, blob in zip(table.column("home").to_pylist(), table.column("blob")):
            d, c, n, h, inv, words_ = unpack(blob.as_py())
            ids.append(np.cumsum(d))
            comps.append(np.cumsum(c))
            ns.append(n)
            homes.append(np.full(len(n), home))
            hs.append(np.cumsum(h))
            invs.append(inv.astype(np.int64) + at)
            maps.append(words_)
            at += len(n)
        d, c, n, home, h, row = (np.concatenate(x) for x in (ids, comps, ns, homes, hs, invs))
        order = np.lexsort((n[row], h))
        h, row = h[order], row[order]
        bits = folded(np.concatenate(maps), n)
        apart = n.astype(np.int64)
        a_, b_ = [], []

        def test(codes):
            codes = np.unique(np.concatenate(codes))
            step = max(1, (4 << 20) // bits.shape[1])
            for i in range(0, len(codes), step):
                x, y = codes[i : i + step] // at, codes[i : i + step] % at
                both = apart[x] + apart[y]
                most = both - 2 * -(-pct * both // (100 + pct))
                ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most
                a_.append(d[x[ok]])
                b_.append(d[y[ok]])

        codes, size = [], 0
        for x, y in _pairs(row, h, n, pct):
            # of two of the class below, the group of that class knows
            ok = (c[x] != c[y]) & (home[x] | home[y])
            codes.append(x[ok] * at + y[ok])
            size += int(ok.sum())
            if size >= PAIRS:
                test(codes)
                codes, size = [], 0
            if len(a_) > 64:
                nodes, least = least_of_component(np.concatenate(a_), np.concatenate(b_))
                a_[:], b_[:] = [least], [nodes]
        if size:
            test(codes)
        nodes, least = least_of_component(np.concatenate([np.zeros(0, np.int64), *a_]), np.concatenate([np.zeros(0, np.int64), *b_]))
        far = nodes != least
        release()
        return pa.table({"part": np.full(int(far.sum()), key[0].as_py(), np.int32), "a": least[far], "b": nodes[far]})

    return rows.groupBy("part", "bucket").applyInArrow(run, "part int, a bigint, b bigint").distinct()


def folded(words_: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bitmaps of sets of sizes ``n`` as a matrix, folded to the shortest of them; they still differ in no more bits than the sets."""
    w = bitmap_words(n)
    starts, width = np.cumsum(w) - w, int(w.min())
    out = np.zeros((len(n), width), U)
    for size in np.unique(w).tolist():
        which = np.flatnonzero(w == size)
        for i in range(0, size, width):
            out[which] ^= words_[starts[which][:, None] + np.arange(i, i + width)]
    return out


def link_group(ids: np.ndarray, members: list[np.ndarray], pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the linked members of one group, as (root, member).

    Overlaps of one member with all others come from posting lists.  The
    members of the smaller components are counted first; as soon as all that
    are left lie in one component, every pair is decided.
    """
    m = len(ids)
    n = np.array([len(s) for s in members])
    tok, inv = np.unique(np.concatenate(members), return_inverse=True)
    own = np.repeat(np.arange(m), n)
    order = np.argsort(inv, kind="stable")
    post, po = own[order], np.concatenate([[0], np.cumsum(np.bincount(inv, minlength=len(tok)))])
    so = np.concatenate([[0], np.cumsum(n)])
    comp = np.arange(m)
    seen = np.zeros(m, bool)

    def count(x: int) -> None:
        t = inv[so[x] : so[x + 1]]
        lens = po[t + 1] - po[t]
        at = np.repeat(po[t] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        both = np.bincount(post[at], minlength=m)
        linked = 100 * both >= pct * (n + n[x] - both)
        linked &= both > 0
        roots = np.unique(comp[linked])
        comp[np.isin(comp, roots)] = roots[0]
        seen[x] = True

    while True:
        left = np.flatnonzero(~seen)
        if not len(left):
            break
        c, size = np.unique(comp[left], return_counts=True)
        if len(c) == 1:
            break
        # one member of the largest component not yet probed, then everything outside it
        big = c[np.argmax(size)]
        inside = left[comp[left] == big]
        if not seen[comp == big].any():
            count(int(inside[0]))
            continue
        outside = left[comp[left] != big]
        count(int(outside[0]))
    return ids[comp], ids


def verify(docs: DataFrame, units: DataFrame, k: int, pct: int) -> DataFrame:
    """``(part, a, b)`` links inside units; ``units`` has ``(doc_id, units)``, a list of unit ids."""

    def ship(batches, blobs):
        found = Found(blobs.value)
        for b in batches:
            row, unit = found(b.column(0).to_numpy())
            if not len(row):
                continue
            some, at = np.unique(row, return_inverse=True)
            order = np.argsort(at, kind="stable")
            b, at, unit = b.take(pa.array(some)), at[order], unit[order]
            buf, offs = flat(b.column(1))
            did = b.column(0).to_numpy()
            for i, j in chunks(offs):
                sh, so = sets(buf, offs[i : j + 1], k)
                sent = [pack(deltas(sh[x:z] >> U(12))) for x, z in zip(so[:-1].tolist(), so[1:].tolist())]
                own = slice(*np.searchsorted(at, [i, j]))
                yield pa.record_batch({"unit": unit[own], "doc_id": did[at[own]], "s": pa.array([sent[r - i] for r in at[own].tolist()], pa.binary())})

    def run(table):
        ids = table.column("doc_id").to_numpy()
        members = [np.cumsum(unpack(s.as_py())[0]) for s in table.column("s")]
        keep = [i for i, s in enumerate(members) if len(s)]
        if len(keep) < 2:
            return pa.table({"part": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = link_group(ids[keep], [members[i] for i in keep], pct)
        del members
        release()
        far = a != b
        return pa.table({"part": pa.array([0] * int(far.sum()), pa.int32()), "a": a[far], "b": b[far]})

    asked = turns(stash(units.select("doc_id", F.explode("units").alias("value")), "units"), "asked")
    sent = by_turns(docs, asked, lambda own, blobs: own.mapInArrow(lambda b: ship(b, blobs), "unit bigint, doc_id bigint, s binary"))
    return sent.groupBy("unit").applyInArrow(run, "part int, a bigint, b bigint")


def join_components(docs: DataFrame, k: int = 4, pct: int = 85, doc_id: str = "doc_id", text: str = "text", orders: int = ORDERS, block: int = BLOCK, share: float = COMMON) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``."""
    docs = small_reads(small_batches(docs)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    live = docs.where(F.col("doc_id").isNotNull())
    n_docs, size = text_bytes(live)
    surveyed = stash(survey(live, k, share), "survey")
    every = surveyed.where(F.col("doc_id").isNotNull()).select("doc_id", "n", "d1", "d2")
    # one member per set; the least document stands for its copies
    classes = surveyed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("s"))
    classes = stash(classes.select("n", "d1", "d2", F.col("s.doc_id").alias("rep"), F.col("s.sig").alias("sig")), "classes")
    near = connected_components(band_edges(classes), "bands")
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n").alias("n"))
    links = stash(_verified(live, near.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), sizes, k, pct, block), "links")
    first = stash(connected_components(links, "first"), "first")
    # step 2 looks between components: copies take no part, other members carry theirs
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = every.where("n > 0").select("doc_id").distinct().join(reps, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("value"))
    moved = first.where("node <> component").select(F.col("node").alias("doc_id"), F.col("component").alias("value"))
    marks = stash(copies.unionByName(moved), "marks")
    common = common_shingles(surveyed, n_docs, share)
    buckets = bucket_count(size, BUCKET_BYTES, 8)
    view = turns(marks, "view")
    for o in range(2):
        ids = stash(supported(prefixes(live, view, o > 0, k, pct, common, buckets, [o], EXTRA), every.select("doc_id", "n"), pct, EXTRA, buckets), "supported")
        view = turns(stash(ids.join(moved, "doc_id", "left").select("doc_id", F.coalesce("value", "doc_id").alias("value")), "rest"), "view")
    # shingles by rounded size, an eighth of an octave apart
    size = F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 8) / 8))
    left = {r["s"]: (r["c"], r["most"]) for r in every.where("n > 0").join(ids, "doc_id", "left_semi").groupBy(size.alias("s")).agg(F.sum("n").alias("c"), F.max("n").alias("most")).collect()}
    if left:
        least = size_classes(max(x for _, x in left.values()), pct)
        buckets = class_buckets(least, {s: c for s, (c, _) in left.items()}, pct)
        rows = prefix_rows(live, view, k, pct, common, least, buckets, list(range(orders)))
        chained = connected_components(prefix_edges(rows, pct), "prefix")
        keyed = chained.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("part", "component"))).alias("key")).where(F.size("key") == orders)
        links = links.unionByName(stash(_verified(live, keyed.select(F.col("node").alias("doc_id"), F.xxhash64("key").alias("cluster")), sizes, k, pct, block), "links"))
        first = connected_components(links, "links")
    comp = first.select(F.col("node").alias("rep"), "component")
    named = classes.join(comp, "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    lone = every.join(named, ["n", "d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return lone.unionByName(docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))


def _verified(live: DataFrame, members: DataFrame, sizes: DataFrame, k: int, pct: int, block: int) -> DataFrame:
    """``(part, a, b)``: the exact links inside candidate groups, ``members`` being ``(doc_id, cluster)`` and ``sizes`` having their shingles."""
    members = stash(members.join(sizes, "doc_id", "left"), "members")
    groups = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("head"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).where("m > 1")
    groups = groups.withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("bigint")).drop("size")
    blocks = F.col("blocks")
    cand = stash(members.drop("n").join(groups, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks)), "candidates")
    # the least member of a group of several blocks visits all of them: nearly always it ties their cores
    every_block = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda i: F.xxhash64("cluster", i))
    mine = F.array(F.xxhash64("cluster", F.col("block").cast("bigint")))
    units = cand.select("doc_id", F.when(F.col("doc_id") == F.col("head"), every_block).otherwise(mine).alias("units"))
    links = stash(verify(live, units, k, pct), "links")
    large = cand.where("blocks > 1")
    if large.limit(1).count():
        links = links.unionByName(_across_blocks(live, large, links, k, pct))
    return links


def _across_blocks(docs: DataFrame, large: DataFrame, links: DataFrame, k: int, pct: int) -> DataFrame:
    """Links between blocks of large groups: members outside the largest component meet every block."""
    comp = connected_components(links, "blocks").select(F.col("node").alias("doc_id"), "component")
    cur = stash(large.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "blocks")
    main = cur.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max_by("component", "c").alias("main"))
    cur = cur.join(main, "cluster")
    rest = cur.where("component <> main")
    # as many slices of the rest as its share of the group makes of the blocks
    share = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("out"))
    rest = rest.join(share, "cluster").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.ceil(F.col("blocks") * F.col("out") / F.col("m"))))
    slices = rest.select("cluster", "slice").distinct()
    # a slice of the rest meets each block of its group; a member of the rest goes along with every block
    out = rest.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("blk"), "cluster", "slice").select("doc_id", F.xxhash64("cluster", "slice", "blk").alias("u"))
    ins = cur.join(slices, "cluster").select("doc_id", F.xxhash64("cluster", "slice", F.col("block")).alias("u"))
    units = out.unionByName(ins).groupBy("doc_id").agg(F.collect_set("u").alias("units"))
    return verify(docs, units, k, pct)


def keep_one(docs: DataFrame, k: int = 5, pct: int = 80) -> DataFrame:
    """One row of each component, with all its columns; rows without a shingle stay.

    Rows are judged, not ids: two rows of one ``doc_id`` are two documents.
    The row of the least ``doc_id`` stays (a null one counts as the largest),
    of several the one of the least hash of its text, and one of equal rows.
    """
    row = "__siteseer_row"
    numbered = stash(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    comp = stash(join_components(numbered, k, pct, doc_id=row).where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "components")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.col(row).alias("row"))
    # a row alone in its component stays: only the others meet
    many = comp.groupBy("component_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("component_id")
    named = stash(comp.join(many, "component_id", "left_semi").join(numbered.select(row, place.alias("o")), row), "named")
    # written, so that a component of very many rows is a skewed key of a plain join
    first = stash(named.groupBy("component_id").agg(F.min("o").alias("first")), "first")
    gone = stash(named.join(first, "component_id").where(F.col("o.row") != F.col("first.row")).select(row), "gone")
    discard(comp, named, first)
    return without(numbered, gone, row)
