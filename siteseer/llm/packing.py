"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most one sequence.  Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the
driver.  From the longest length down, a combination of one, two or three
other lengths that fills the gap exactly is looked up in the set of available
lengths and used as often as the counts allow; what no combination fills
exactly takes the largest lengths that fit.  The plan is a list of patterns
with counts, bounded by the number of lengths.  Rows then get a rank among the
rows of their length, from salted windows, and find their place in the plan by
that rank.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import discard, lookup_join, power_of_two, small_batches, stash
from ._text import flat, release

CAPACITY = 2048
END_ID = 0
#: Entries of each of a worker's caches; one that is full is emptied.
CACHE = 300_000
#: Runs for which splitting by hand is the tokenizer's own: visible ASCII and precomposed Latin letters.
SIMPLE = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
# The tokenizer's own split pattern, over lower-case text.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Chunks(dict):
    """Ids of a run of characters without white space, as little-endian bytes.

    The tokenizer drops white space and never joins across it, nor across the
    borders of its split pattern, so the ids of a text are those of its parts
    in order.  Runs and parts are cached; a run with other characters, or with
    what may be a special token, goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        s = chunk.decode()
        if "<|" in s or not SIMPLE.fullmatch(s):
            out = np.array(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            get = self.parts.get
            out = b"".join([get(p) or self.part(p) for p in PARTS.findall(s.lower())])
        self[chunk] = out
        return out

    def part(self, p: str) -> bytes:
        if len(self.parts) >= CACHE:
            self.parts.clear()
        shown = p if p.isascii() else "".join([self.letters[b] for b in p.encode()])
        out = self.parts[p] = struct.pack(f"<{len(t := self.model.tokenize(shown))}I", *[x.id for x in t])
        return out

    def forget(self) -> None:
        self.clear()
        self.parts.clear()

    def ids(self, raw: bytes) -> bytes:
        return b"".join(map(self.__getitem__, raw.split()))


_caches: dict[str, Chunks] = {}


def encoder(path: str) -> Chunks:
    if path not in _caches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _caches[path] = Chunks(path)
    return _caches[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: ids, the end token, cut into pieces."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches):
        enc = encoder(tokenizer)
        for b in batches:
            buf, offs = flat(b.column(1))
            raw = buf.tobytes()
            row, start, length, crc, blob = [], [], [], [], []
            for i in range(len(offs) - 1):
                ids = enc.ids(raw[offs[i] : offs[i + 1]]) + END_ID.to_bytes(4, "little")
                for at in range(0, len(ids), 4 * capacity):
                    p = ids[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(p) // 4)
                    crc.append(zlib.crc32(p))
                    if with_ids:
                        blob.append(p)
            start = np.array(start, np.int64)
            out = {"doc_id": b.column(0).take(pa.array(row, pa.int64())), "piece": pa.array(start // capacity, pa.int32()), "start": start, "length": np.array(length, np.int64), "ids_crc32": np.array(crc, np.int64)}
            yield pa.record_batch(out | ({"ids": pa.array(blob, pa.binary())} if with_ids else {}))
        # workers live on between stages: their memory is for what comes next
        enc.forget()
        release()

    return small_batches(docs).select(doc_id, text).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


class Stock:
    """Counts by length with look-ups of exact sums."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()

    def single(self, gap: int):
        return (gap,) if 0 < gap < len(self.n) and self.n[gap] else None

    def pair(self, gap: int):
        """The pair with the longest first part whose lengths sum to ``gap``."""
        a = np.arange(gap // 2 + gap % 2, gap)
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0) & ((a != gap - a) | (self.n[a] > 1))
        return (int(a[ok][-1]), gap - int(a[ok][-1])) if ok.any() else None

    def triple(self, gap: int):
        for a in np.flatnonzero(self.n[:gap])[::-1].tolist():
            if 3 * a < gap:
                return None
            self.n[a] -= 1
            rest = self.pair(gap - a) if gap - a > 1 else None
            self.n[a] += 1
            if rest and rest[0] <= a:
                return (a, *rest)
        return None

    def largest(self, gap: int):
        have = np.flatnonzero(self.n[: gap + 1])
        return int(have[-1]) if len(have) else None

    def take(self, lengths) -> int:
        """Use a combination as often as the counts allow."""
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        t = min(int(self.n[x]) // c for x, c in need.items())
        for x, c in need.items():
            self.n[x] -= t * c
        return t


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences take each; uses every piece once."""
    s, out = Stock(counts), []
    for top in range(capacity, 0, -1):
        while s.n[top]:
            base, gap = [top], capacity - top
            s.n[top] -= 1  # what the pattern holds so far is set aside while it grows
            exact: tuple[int, ...] = ()
            while gap and not exact:
                exact = s.single(gap) or s.pair(gap) or s.triple(gap) or ()
                big = None if exact else s.largest(gap)
                if big is None:
                    break
                base.append(big)
                gap -= big
                s.n[big] -= 1
            for x in base:
                s.n[x] += 1
            whole = (*base, *exact)
            out.append((whole, s.take(whole)))
    return out


def places(patterns) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks with their sequence and offset, sorted by (length, rank)."""
    used, first, rows = defaultdict(int), 0, []
    for base, t in patterns:
        offset = 0
        slots = defaultdict(list)
        for x in base:
            slots[x].append(offset)
            offset += x
        for x, offs in slots.items():
            for o in offs:
                rows.append((x, used[x], t, first, o))
                used[x] += t
        first += t
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "count", "sequence", "offset"), cols.T))


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY, per_salt: int = 1 << 20) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a (written) table of pieces."""
    n = cut.count()
    salts = power_of_two(n / per_salt, 16)
    rows = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sums = stash(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("c")), "lengths")
    # the driver sees the histogram alone: at most ``capacity`` rows, whatever the corpus
    counts = np.zeros(capacity + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("c").alias("c")).collect():
        counts[r["length"]] = r["c"]
    before = stash(sums.select("length", "salt", F.expr("sum(c) over (partition by length order by salt) - c").alias("before")), "ranks")
    discard(sums)
    at = places(plan(counts, capacity))
    key = at["length"] << 44 | at["rank"] if len(at["length"]) else np.zeros(0, np.int64)
    rows = rows.withColumn("rn", F.expr("row_number() over (partition by length, salt order by doc_id, piece, start)"))
    rows = lookup_join(rows, before, ["length", "salt"], row_bytes=40).withColumn("place", F.col("before") + F.col("rn") - 1)
    cols = [c for c in cut.columns]

    def put(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "place"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            out = {c: b.column(b.schema.get_field_index(c)) for c in cols}
            yield pa.record_batch(out | {"sequence_id": at["sequence"][i] + rank - at["rank"][i], "offset": at["offset"][i]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return rows.select(*cols, "place").mapInArrow(put, fields + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece."""
    return pack_pieces(stash(pieces(docs, tokenizer, doc_id, text, capacity), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: packed ids in order; needs pieces with their ids."""
    s = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("ps"))
    whole = F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return s.select("sequence_id", whole.alias("ids"), F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"))
