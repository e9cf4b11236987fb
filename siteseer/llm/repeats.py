"""Substring dedup over the de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge from the node of its first ``k - 1``
words to the node of its last ``k - 1``.  The steps:

1. Edges meet by hash in buckets, where each finds its source: the smallest
   document, and the first place in it.  Edges that recur in a later document
   are repeated; they form the graph, each once, at its source coordinates.
   Very common windows, found by a count over all documents, send one
   occurrence per buffer to their bucket and learn their source in a second
   pass over the texts, so no bucket grows with them.
2. Source documents give the hash of every node on their lines of repeated
   edges.  A node's degrees are counts over all lines.  Lines are cut where a
   join with the nodes shows that edges of other lines enter or leave: what
   remains are the nonbranching paths.
3. In the documents, occurrences that follow each other along a source line
   are walks, cut where their path ends, through a join on the source.
4. Source coordinates verify each piece: a second, independent hash of its
   words is taken at both places, and joins keep the pieces whose two hashes
   agree.  Windows of pieces that fail (the first hashes collided) are grouped
   again by both hashes.  Words under a verified piece whose source is a
   smaller document are removed, from the rows whose words have that hash.

Windows travel as packed columns: sorted hashes as differences, places as
small integers.  The number of buckets follows the corpus; only packed walks,
nodes and requests follow.

Defined cases: null, empty and short texts have no window and keep their
words; equal windows of one document do not remove each other; rows with one
``doc_id`` count as one document, and each loses its own repeats; a null
``doc_id`` is smaller than none and its texts are left as they are; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._dist import bucket_count, discard, hot_keys, lookup_join, skew_join, small_batches, stash, text_bytes
from ._text import U, chunks, deltas, flat, mix, pack, powers, release, unpack, windows, words

#: Bytes of text whose windows meet in one bucket.
BUCKET_BYTES = 6 << 20
#: Windows buffered by a task before they are sent.
FLUSH = 3 << 19
#: Span requests that travel with one copy of a text.
REQUESTS = 5000
#: A window with more than this share of all windows is very common; there are at most ``2 / COMMON`` of them.
COMMON = 1 / 50_000
#: Fewer occurrences are never common.
COMMON_LEAST = 1000
SPANS = "__siteseer_spans"
#: Bits of the first hash; the second one settles what collides.
HASH_BITS = 64


def first_hashes(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First hashes of every window, and offsets by document."""
    h, wo = words(buf, offs)
    h, o = windows(h, wo, k)
    return h << U(64 - HASH_BITS), o


def _buffered(batches, k: int, size: int):
    """Windows of many documents at a time: ids, windows per document, hashes."""
    ids, counts, hs, held = [], [], [], 0
    for b in batches:
        buf, offs = flat(b.column(1))
        did = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in chunks(offs):
            h, o = first_hashes(buf, offs[i : j + 1], k)
            n = np.diff(o)
            has = np.flatnonzero(n)
            ids.append(did[i:j][has])
            counts.append(n[has])
            hs.append(h)
            held += len(h)
            if held >= size:
                yield np.concatenate(ids), np.concatenate(counts), np.concatenate(hs)
                ids, counts, hs, held = [], [], [], 0
    if held:
        yield np.concatenate(ids), np.concatenate(counts), np.concatenate(hs)


def common_windows(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted first hashes of the windows with more than about ``COMMON`` of all occurrences.

    A buffer reports a window above half of the share of its own, so every
    common window is reported by some; counts of a window combine by sum.
    """

    def run(batches):
        for _, _, h in _buffered(batches, k, 1 << 20):
            n = len(h)
            h.sort()
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            c = np.diff(np.concatenate([at, [n]]))
            keep = c > max(1, n * COMMON / 2)
            yield pa.record_batch({"h": np.concatenate([h[at[keep]].view(np.int64), np.zeros(1, np.int64)]), "c": np.concatenate([c[keep], np.zeros(1, np.int64)]), "n": np.concatenate([np.zeros(int(keep.sum()), np.int64), [n]])})
        release()

    got = docs.mapInArrow(run, "h bigint, c bigint, n bigint").groupBy("h").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    got = stash(got, "common")
    total = got.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = got.where(F.col("c") > max(COMMON_LEAST, int(total * COMMON / 2))).select("h").collect()
    discard(got)
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(U))


def _is_in(h: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def edges(docs: DataFrame, k: int, buckets: int, common: np.ndarray) -> DataFrame:
    """``(bucket, blob)``: packed (hash, document, place) of every window; of a common one the least occurrence of each buffer."""
    shift = U(64 - (buckets.bit_length() - 1)) if buckets > 1 else None
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def flush(ids, n, h):
        starts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        often = np.flatnonzero(_is_in(h, shared.value))
        if len(often):
            doc = ids[np.searchsorted(starts, often, "right") - 1]
            by = often[np.lexsort((often - starts[np.searchsorted(starts, often, "right") - 1], doc, h[often]))]
            once = by[np.concatenate([[True], h[by[1:]] != h[by[:-1]]])]
            sent = np.ones(len(h), bool)
            sent[often] = False
            sent[once] = True
            order = np.flatnonzero(sent)
            order = order[np.argsort(h[order])]
        else:
            order = np.argsort(h)
        h = h[order]
        at = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=U)) if buckets > 1 else np.array([0, len(h)])
        table = (deltas(ids), n.astype(np.uint32))
        rows = [i for i in range(buckets) if at[i] < at[i + 1]]
        blobs = [pack(*table, deltas(h[at[i] : at[i + 1]]), order[at[i] : at[i + 1]].astype(np.uint32)) for i in rows]
        return pa.record_batch({"bucket": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def run(batches):
        for ids, n, h in _buffered(batches, k, FLUSH):
            yield flush(ids, n, h)
        release()

    return docs.mapInArrow(run, "bucket int, blob binary")


#: Kinds of rows that buckets give: occurrences by document, repeated edges by source, sources of common windows.
OCCURRENCE, EDGE, SOURCE = 0, 1, 2


def _dealt(kind: int, key: np.ndarray, groups: int, by: tuple[np.ndarray, ...], packed) -> list[tuple[int, int, bytes]]:
    """Rows of one kind, dealt into groups of documents and sorted in each."""
    g = (mix(key.astype(U), 5) % U(groups)).astype(np.int32)
    order = np.lexsort((*by, g))
    at = np.searchsorted(g[order], np.arange(groups + 1))
    return [(kind, i, packed(order[at[i] : at[i + 1]])) for i in range(groups) if at[i] < at[i + 1]]


def repeated(edge_blobs: DataFrame, groups: int, common: np.ndarray) -> DataFrame:
    """``(kind, grp, blob)``: occurrences of repeated windows in later documents, and the repeated edges at their sources."""
    shared = edge_blobs.sparkSession.sparkContext.broadcast(common)

    def run(table):
        rows = find(table)
        release()
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "grp": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    def find(table):
        hs, ids, pos = [], [], []
        for blob in table.column("blob"):
            did, n, h, at = unpack(blob.as_py())
            did, starts = np.cumsum(did), np.concatenate([[0], np.cumsum(n.astype(np.int64))])
            d = np.searchsorted(starts, at.astype(np.int64), "right") - 1
            hs.append(np.cumsum(h))
            ids.append(did[d])
            pos.append((at - starts[d]).astype(np.int32))
        h = np.concatenate(hs)
        del hs
        did = np.concatenate(ids)
        del ids
        p = np.concatenate(pos)
        del pos
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(new)
        many = np.diff(np.concatenate([first, [len(h)]])) > 1
        often = _is_in(h[first], shared.value)
        grp = np.cumsum(new) - 1
        keep = (many | often)[grp]
        order, h = order[keep], h[keep]
        if not len(order):
            return []
        did, p = did[order], p[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.concatenate([first, [len(h)]]))
        src = np.minimum.reduceat(did, first)
        place = np.minimum.reduceat(np.where(did == np.repeat(src, size), p, np.iinfo(np.int64).max), first)
        often = _is_in(h[first], shared.value)
        out = []
        if often.any():
            out.append((SOURCE, -1, pack(h[first][often], src[often], place[often])))
        again = often | (np.maximum.reduceat(did, first) > src)
        s, q = src[again], place[again]
        out += _dealt(EDGE, s, groups, (q, s), lambda i: pack(deltas(s[i]), deltas(q[i])))
        src, place = np.repeat(src, size), np.repeat(place, size)
        far = did > src
        did, p, src, place = did[far], p[far], src[far], place[far]
        diag = place - p
        return out + _dealt(OCCURRENCE, did, groups, (p, did), lambda i: pack(deltas(did[i]), p[i].astype(np.uint32), deltas(src[i]), deltas(diag[i])))

    return edge_blobs.groupBy("bucket").applyInArrow(run, "kind int, grp int, blob binary")


def common_occurrences(docs: DataFrame, k: int, groups: int, sources: list[bytes]) -> DataFrame:
    """``(grp, blob)``: occurrences of the common windows, whose sources are known."""
    cols = [np.concatenate(c) for c in zip(*[unpack(b) for b in sources])]
    order = np.argsort(cols[0])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(c[order] for c in cols))

    def run(batches):
        keys, src, place = shared.value
        for ids, n, h in _buffered(batches, k, FLUSH):
            i = np.flatnonzero(_is_in(h, keys))
            starts = np.concatenate([[0], np.cumsum(n)])
            d = np.searchsorted(starts, i, "right") - 1
            at = np.searchsorted(keys, h[i])
            far = ids[d] > src[at]
            did, p, s, q = ids[d][far], (i - starts[d])[far], src[at][far], place[at][far]
            rows = _dealt(OCCURRENCE, did, groups, (p, did), lambda x: pack(deltas(did[x]), p[x].astype(np.uint32), deltas(s[x]), deltas(q[x] - p[x])))  # noqa: B023
            yield pa.record_batch({"grp": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})
        release()

    return docs.mapInArrow(run, "grp int, blob binary")


def walks(occurrences: DataFrame) -> DataFrame:
    """``(doc_id, start, n, src, src_start)``: maximal runs of windows along one source line."""

    def run(table):
        cols = [unpack(b.as_py()) for b in table.column("blob")]
        did, p = np.concatenate([np.cumsum(c[0]) for c in cols]), np.concatenate([c[1] for c in cols]).astype(np.int64)
        src, diag = np.concatenate([np.cumsum(c[2]) for c in cols]), np.concatenate([np.cumsum(c[3]) for c in cols])
        # rows that share an id may lie on several lines at one place
        order = np.lexsort((p, diag, src, did))
        did, p, src, diag = did[order], p[order], src[order], diag[order]
        line = (did[1:] != did[:-1]) | (src[1:] != src[:-1]) | (diag[1:] != diag[:-1])
        once = np.concatenate([[True], line | (p[1:] != p[:-1])])
        did, p, src, diag = did[once], p[once], src[once], diag[once]
        line = (did[1:] != did[:-1]) | (src[1:] != src[:-1]) | (diag[1:] != diag[:-1])
        at = np.flatnonzero(np.concatenate([[True], line | (p[1:] != p[:-1] + 1)]))
        n = np.diff(np.concatenate([at, [len(p)]]))
        out = pa.table({"doc_id": did[at], "start": p[at], "n": n.astype(np.int64), "src": src[at], "src_start": p[at] + diag[at]})
        release()
        return out

    return occurrences.groupBy("grp").applyInArrow(run, "doc_id bigint, start bigint, n bigint, src bigint, src_start bigint")


def source_lines(source_edges: DataFrame) -> DataFrame:
    """``(src, start, n)``: maximal runs of repeated edges that follow each other in their source."""

    def run(table):
        cols = [unpack(b.as_py()) for b in table.column("blob")]
        src, p = np.concatenate([np.cumsum(c[0]) for c in cols]), np.concatenate([np.cumsum(c[1]) for c in cols])
        order = np.lexsort((p, src))
        src, p = src[order], p[order]
        at = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (p[1:] != p[:-1] + 1)]))
        n = np.diff(np.concatenate([at, [len(p)]]))
        return pa.table({"src": src[at], "start": p[at], "n": n.astype(np.int64)})

    return source_edges.groupBy("grp").applyInArrow(run, "src bigint, start bigint, n bigint")


def _to_texts(docs: DataFrame, asked: DataFrame, how: str = "inner") -> DataFrame:
    """Texts beside what is asked of them.

    Requests grow with the corpus, so they are never broadcast; each task
    hashes the requests of its documents and streams their texts past.
    """
    return docs.join(asked.hint("shuffle_hash"), ["doc_id"], how)


def nodes(docs: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """``(node, src, place, ins, outs)``: the nodes on source lines, and whether an edge of the line enters and leaves there."""
    by = stash(lines.groupBy("src").agg(F.collect_list(F.struct("start", "n")).alias("spans")).withColumnRenamed("src", "doc_id"), "lines")

    def run(batches):
        for b in batches:
            buf, offs = flat(b.column(1))
            did = b.column(0).to_numpy()
            for i, j in chunks(offs):
                h, o = words(buf, offs[i : j + 1])
                h, o = windows(h, o, k - 1, seed=3)
                doc, spans = _spans_of(b, 2, i, j)
                st, n = spans.field("start").to_numpy(), spans.field("n").to_numpy()
                own = n + 1  # a line of n edges has n + 1 nodes
                line = np.repeat(np.arange(len(n)), own)
                step = np.arange(len(line)) - np.repeat(np.cumsum(own) - own, own)
                place = st[line] + step
                there = place < np.diff(o)[doc][line]  # rows that share an id may be shorter
                line, step, place = line[there], step[there], place[there]
                yield pa.record_batch({
                    "node": h[o[doc[line]] + place].view(np.int64), "src": did[i:j][doc[line]], "place": place,
                    "ins": (step > 0).astype(np.int32), "outs": (step < n[line]).astype(np.int32),
                })
        release()

    joined = _to_texts(docs, by).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "node bigint, src bigint, place bigint, ins int, outs int")


def branch_places(on_lines: DataFrame) -> DataFrame:
    """``(src, cuts)``: sorted places inside source lines where the graph branches.

    A node inside a line has an edge in and one out; it branches if the nodes
    of all lines bring more.
    """
    degree = on_lines.groupBy("node").agg(F.sum("ins").alias("i"), F.sum("outs").alias("o"), F.max(F.col("ins") * F.col("outs")).alias("inside"))
    branching = stash(degree.where("inside = 1 AND (i > 1 OR o > 1)").select("node"), "branching")
    cut = lookup_join(on_lines.where("ins = 1 AND outs = 1"), branching, ["node"], "left_semi", row_bytes=24)
    out = stash(cut.groupBy("src").agg(F.sort_array(F.collect_set("place")).alias("cuts")), "cuts")
    discard(branching)
    return out


def paths(lines: DataFrame, cuts: DataFrame) -> DataFrame:
    """``(src, start, n)``: the nonbranching paths of the graph at their source coordinates."""
    return _cut(lines, cuts, F.col("start"))


def _cut(spans: DataFrame, cuts: DataFrame, at: Column) -> DataFrame:
    """Spans of ``n`` edges, ``at`` a place of ``src``, cut where their source line branches; ``start`` and ``src_start`` move along."""
    j = lookup_join(spans, cuts, ["src"], "left", row_bytes=F.lit(48) + 8 * F.size("cuts"))
    inside = F.filter("cuts", lambda c: (c > at) & (c < at + F.col("n")))
    marks = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("bigint"), F.col("n"))).otherwise(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(inside, lambda c: c - at), F.array(F.col("n"))))
    part = F.explode(F.transform(F.slice("marks", 1, F.size("marks") - 1), lambda m, i: F.struct(m.alias("lo"), F.get("marks", i + 1).alias("hi"))))
    moved = {c: (F.col(c) + F.col("p.lo")).alias(c) for c in ("start", "src_start")} | {"n": (F.col("p.hi") - F.col("p.lo")).alias("n")}
    return j.select(*spans.columns, marks.alias("marks")).select(*spans.columns, part.alias("p")).select(*[moved.get(c, F.col(c)) for c in spans.columns])


def _spans_of(b: pa.RecordBatch, at: int, i: int, j: int) -> tuple[np.ndarray, pa.StructArray]:
    """Documents, from 0, and structs of a list column for rows ``i`` to ``j``."""
    col = b.column(at)
    o = np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    vals = col.flatten()
    return np.repeat(np.arange(j - i), np.diff(o[i : j + 1])), vals.slice(o[i], o[j] - o[i])


def second_hashes(buf: np.ndarray, offs: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Independent hashes of word spans; 0 where a text has no such words."""
    h, wo = words(buf, offs, seed=7)
    up, down = powers(len(h) + 1)
    acc = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=acc[1:])
    lo, hi = wo[doc] + start, wo[doc] + end
    bad = hi > wo[doc + 1]
    lo, hi = np.where(bad, 0, lo), np.where(bad, 0, hi)
    return mix((acc[hi] - acc[lo]) * down[lo], 9).view(np.int64)


def span_hashes(docs: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """A second hash of asked word spans: ``(doc_id, start, n, h)``."""
    # a document that many others point to gets its requests in parts, each with a copy of the text
    hot = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > REQUESTS)
    part = F.when(F.col("c").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("start", "n"), F.ceil(F.col("c") / REQUESTS)))
    asked = spans.join(hot, "doc_id", "left").groupBy("doc_id", part.alias("part")).agg(F.collect_list(F.struct("start", "n")).alias("asks"))
    asked = stash(asked.select("doc_id", "asks"), "asks")

    def run(batches):
        for b in batches:
            buf, offs = flat(b.column(1))
            did = b.column(0).to_numpy()
            for i, j in chunks(offs):
                doc, asks = _spans_of(b, 2, i, j)
                st, n = asks.field("start").to_numpy(), asks.field("n").to_numpy()
                yield pa.record_batch({"doc_id": did[i:j][doc], "start": st, "n": n, "h": second_hashes(buf, offs[i : j + 1], doc, st, st + n + k - 1)})

    joined = _to_texts(docs, asked).select("doc_id", "text", "asks")
    return joined.mapInArrow(run, "doc_id bigint, start bigint, n bigint, h bigint").distinct()


def settle(docs: DataFrame, failed: DataFrame, k: int) -> DataFrame:
    """``(doc_id, start, n, h)`` of windows in pieces whose first hashes collided, grouped by both hashes.

    First hashes of 64 bits collide about once in 2**64 pairs, so what fails is little.
    """
    asks = stash(failed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asks")), "failed")

    def look(batches):
        for b in batches:
            buf, offs = flat(b.column(1))
            for i, j in chunks(offs):
                h, o = first_hashes(buf, offs[i : j + 1], k)
                doc, a = _spans_of(b, 2, i, j)
                st, n = a.field("start").to_numpy(), a.field("n").to_numpy()
                place = np.repeat(st - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                d = np.repeat(doc, n)
                own = place < np.diff(o)[d]
                yield pa.record_batch({"w": np.unique(h[o[d[own]] + place[own]]).view(np.int64)})

    with_asks = _to_texts(docs, asks).select("doc_id", "text", "asks")
    wanted = np.sort(np.array([r["w"] for r in with_asks.mapInArrow(look, "w bigint").distinct().collect()], np.int64).view(U))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def gather(batches):
        for b in batches:
            buf, offs = flat(b.column(1))
            did = b.column(0).to_numpy()
            for i, j in chunks(offs):
                h, o = first_hashes(buf, offs[i : j + 1], k)
                at = np.flatnonzero(_is_in(h, shared.value))
                doc = np.searchsorted(o, at, "right") - 1
                place = at - o[doc]
                yield pa.record_batch({"doc_id": did[i:j][doc], "start": place, "w": h[at].view(np.int64), "h": second_hashes(buf, offs[i : j + 1], doc, place, place + k)})

    seen = stash(docs.mapInArrow(gather, "doc_id bigint, start bigint, w bigint, h bigint"), "settled")
    least = stash(seen.groupBy("w", "h").agg(F.min("doc_id").alias("src")), "least")
    return seen.join(least, ["w", "h"]).where("doc_id > src").select("doc_id", "start", F.lit(1).cast("bigint").alias("n"), "h").distinct()


def verified(docs: DataFrame, pieces: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Written pieces whose words have one second hash at both places, with it as ``h``, and those that differ."""
    asks = pieces.select("doc_id", "start", "n").unionByName(pieces.select(F.col("src").alias("doc_id"), F.col("src_start").alias("start"), "n")).distinct()
    hashes = stash(span_hashes(docs, asks, k), "spanhashes")
    key = ["src", "src_start", "n"]
    theirs = hashes.select(F.col("doc_id").alias("src"), F.col("start").alias("src_start"), "n", "h").groupBy(*key).agg(F.collect_set("h").alias("theirs"))
    # a passage that very many documents share is one source span: it travels to them
    hot = stash(hot_keys(pieces, key, pieces.count()), "hotspans")
    both = skew_join(pieces, stash(theirs, "theirs"), key, ["theirs"], hot, "hotspans")
    both = both.join(hashes.withColumnRenamed("h", "mine"), ["doc_id", "start", "n"]).withColumn("fits", F.array_contains("theirs", F.col("mine")))
    judged = stash(both.select(*pieces.columns, F.col("mine").alias("h"), "fits"), "judged")
    discard(hashes, hot)
    good, bad = judged.where("fits").drop("fits"), stash(judged.where(~F.col("fits")).drop("fits", "h").distinct(), "collided")
    if bad.limit(1).count():  # rows that share an id: a piece that fits one of them has not failed
        bad = stash(bad.join(good.select(*pieces.columns), pieces.columns, "left_anti"), "collided")
    return good, bad


def graph(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walks, source lines, and the places where the lines branch, as written tables."""
    _, size = text_bytes(small_batches(docs))
    buckets = bucket_count(size, BUCKET_BYTES, 16)
    common = common_windows(docs, k)
    rep = stash(repeated(edges(docs, k, buckets, common), buckets, common), "repeated")
    occurrences = rep.where(F.col("kind") == OCCURRENCE).select("grp", "blob")
    # at most 2 / COMMON windows, three numbers each
    sources = [bytes(r["blob"]) for r in rep.where(F.col("kind") == SOURCE).select("blob").collect()]
    if sources:
        occurrences = occurrences.unionByName(common_occurrences(docs, k, buckets, sources))
    found = stash(walks(occurrences), "walks")
    lines = stash(source_lines(rep.where(F.col("kind") == EDGE).select("grp", "blob")), "lines")
    discard(rep)
    on_lines = stash(nodes(docs, lines, k), "nodes")
    cuts = branch_places(on_lines)
    discard(on_lines)
    return found, lines, cuts


def repeated_paths(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(src, start, n)``: every nonbranching path of repeated windows: its source, first word and number of windows."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    _, lines, cuts = graph(docs, k)
    return paths(lines, cuts)


def repeated_spans(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, spans)``: verified word spans to remove, sorted, with the second hash of their words, per document that has any."""
    live = docs.where(F.col("doc_id").isNotNull())
    found, lines, cuts = graph(live, k)
    pieces = stash(_cut(found, cuts, F.col("src_start")), "pieces")
    discard(found, lines, cuts)
    good, bad = verified(live, pieces, k)
    good = good.select("doc_id", "start", "n", "h")
    if bad.limit(1).count():
        good = good.unionByName(settle(live, bad, k))
    end = F.col("start") + F.col("n") + (k - 1)
    spans = stash(good.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", end.alias("end"), "h"))).alias("spans")), "spans")
    discard(pieces, bad)
    return spans


def _kept(raw: bytes, spans) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    w = raw.split()
    parts, at = [], 0
    for start, end in spans:
        if start > at:
            parts += w[at:start]
        at = max(at, end)
    parts += w[at:]
    return len(w), len(w) - len(parts), b" ".join(parts)


def _edited(b: pa.RecordBatch, text: int, spans: int):
    """``(n_words, n_removed, kept words)`` of each row: spans go where the row's words have their hash."""
    buf, offs = flat(b.column(text))
    for i, j in chunks(offs):
        doc, s = _spans_of(b, spans, i, j)
        of: list[list] = [[] for _ in range(i, j)]
        if len(doc):
            st, end, h = (s.field(c).to_numpy() for c in ("start", "end", "h"))
            fits = second_hashes(buf, offs[i : j + 1], doc, st, end) == h
            for d, x, y in zip(doc[fits].tolist(), st[fits].tolist(), end[fits].tolist()):
                of[d].append((x, y))
        for r in range(i, j):
            yield _kept(buf[offs[r] : offs[r + 1]].tobytes(), of[r - i])


def remove_repeats(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``, one row per row of ``docs``.

    ``kept_text`` is the kept words joined by one space.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    spans = repeated_spans(docs, k)

    def run(batches):
        for b in batches:
            got = list(_edited(b, 1, 2))
            yield pa.record_batch({"doc_id": b.column(0), "n_words": pa.array([g[0] for g in got], pa.int64()), "n_removed": pa.array([g[1] for g in got], pa.int64()), "kept_text": pa.array([g[2] for g in got], pa.binary()).cast(pa.string())})
        release()

    joined = _with_spans(docs, spans).select("doc_id", "text", SPANS)
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return _to_texts(docs, spans.withColumnRenamed("spans", SPANS), "left")


def edit_documents(docs: DataFrame, k: int = 13) -> DataFrame:
    """All rows of ``documents``: repeated words are gone from ``text``, other texts stay byte for byte."""
    spans = repeated_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), k)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for b in batches:
            at = names.index("text")
            texts = [t if not g[1] else g[2].decode() for t, g in zip(b.column(at).to_pylist(), _edited(b, at, len(names)))]
            yield pa.record_batch({f.name: b.column(i) for i, f in enumerate(schema.fields)} | {"text": pa.array(texts, pa.string())})
        release()

    out = _with_spans(docs, spans).select(*[F.col(f"`{c}`") for c in names], SPANS).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in names else out
