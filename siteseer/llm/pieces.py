"""SentencePiece encoding and decoding by batched numpy Viterbi.

The model is byte-pair encoding: the best segmentation is the one its merges
reach, and that is the only one whose neighbouring pieces are all compatible
(two pieces are compatible when merging their characters gives back those
two).  So the Viterbi lattice scores a step by compatibility with the piece
before it.  Words of equal length advance together: at each place all
substrings that end there are hashed from prefix arrays, the hashes that begin
like a key probe the sorted piece keys, and the vectorised maximum over the candidates is stored as
a backpointer.  Compatibility of a pair is found once by merging and kept.

Words are cached, so each distinct word of a worker is segmented once; a full
cache is emptied.  Runs of space marks, whose pieces tie in score, and words
beyond ``LONG`` characters, whose lattice would hold a row of substrings a
character, are merged directly, which costs little more than their length.
Characters outside the vocabulary become their UTF-8 bytes.

Defined cases: null and empty texts have no ids and decode to an empty text;
repeated rows are encoded one by one; an empty table gives no rows; other
columns are ignored.  A text's own U+2581 decodes to a space, as in the model.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._dist import small_batches
from ._text import U, mix, powers, release

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words, and parts of words, that a worker keeps.
CACHE = 400_000
#: Pairs of pieces whose compatibility is kept, and bits of the number of those at hand: a pair has one place there.
PAIRS = 2_000_000
AT_HAND = 20
#: Pairs that are gathered before they are sorted in among the others.
FRESH = 20_000
#: Leading bits of the substring keys that tell most substrings that are no piece.
SIEVE = 22
#: Strings of up to so many characters are merged by scanning.
SHORT = 40
#: Words beyond so many characters are merged without a lattice.
LONG = 4096
#: Ids of characters outside the vocabulary inside the lattice: this plus the code point.
OTHER = 1 << 21
START = (1 << 21) - 1


class Model:
    """Pieces, their sorted substring keys, and what has been found out about pairs."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {p: b for b, p in enumerate(self.bytes)}
        self.odd = np.array([sp.is_byte(i) or sp.is_control(i) for i in range(n)])
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.rank = {self.text[i]: (-sp.get_score(i), i) for i in range(n) if not skip(i)}
        ids = np.array([i for i in range(n) if not skip(i)], np.int64)
        self.longest = max(len(self.text[i]) for i in ids)
        keys = np.concatenate([self._keys(self.text[i]) for i in ids.tolist()])
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.sieve = self.sieved = None
        self.size = np.array([len(t) for t in self.text])
        self.pairs, self.known = np.zeros(0, np.int64), np.zeros(0, bool)
        self.fresh: dict[int, bool] = {}
        self.place, self.fine = np.full(1 << AT_HAND, -1, np.int64), np.zeros(1 << AT_HAND, bool)
        # two characters that no piece holds side by side: no merge crosses there
        self.touching = {s[i : i + 2] for s in self.rank for i in range(len(s) - 1)}
        self.cache: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        acc = np.zeros((codes.shape[0], codes.shape[1] + 1), U)
        np.cumsum((codes.astype(U) + U(1)) * powers(codes.shape[1])[0], axis=1, out=acc[:, 1:])
        return acc

    def _keys(self, s: str) -> np.ndarray:
        acc = self._prefix(np.array([[ord(c) for c in s]]))
        return mix(acc[:, -1] + np.array([len(s)], U) * U(0xA24BAED4963EE407))

    def merge(self, s: str) -> list[str]:
        """The segmentation by merges: best score first, leftmost among equals.

        Parts form a linked list, and possible merges a heap, so a word costs
        little more than its length, however long it is; a few characters are
        scanned faster.
        """
        if len(s) <= SHORT:
            return self._scan(list(s))
        parts: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        rank, heap = self.rank, []
        for i in range(len(s) - 1):
            if (r := rank.get(s[i : i + 2])) is not None:
                heap.append((r[0], i, s[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            left = parts[i]
            # an entry is stale when either side has changed since
            if left is None or j >= len(parts) or len(left) + len(parts[j]) != len(whole) or not whole.startswith(left):
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                new = whole + parts[after[i]]
                if (r := rank.get(new)) is not None:
                    heapq.heappush(heap, (r[0], i, new))
            if before[i] >= 0:
                new = parts[before[i]] + whole
                if (r := rank.get(new)) is not None:
                    heapq.heappush(heap, (r[0], before[i], new))
        return [p for p in parts if p is not None]

    def _scan(self, parts: list[str]) -> list[str]:
        """Merges by looking over all neighbours for each."""
        get = self.rank.get
        ranks = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at])
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1])

    def _name(self, i: int) -> str:
        return "" if i == START else chr(i - OTHER) if i >= OTHER else self.text[i]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 22 | right
        slot = (mix(code.view(U)) >> U(64 - AT_HAND)).view(np.int64)
        out = self.fine[slot]
        far = np.flatnonzero(self.place[slot] != code)
        if len(far):
            new, inv = np.unique(code[far], return_inverse=True)
            if len(self.pairs) + len(self.fresh) > PAIRS:
                self.pairs, self.known = np.zeros(0, np.int64), np.zeros(0, bool)
                self.fresh.clear()
            fine, old = np.zeros(len(new), bool), np.zeros(len(new), bool)
            if len(self.pairs):
                at = np.minimum(np.searchsorted(self.pairs, new), len(self.pairs) - 1)
                old = self.pairs[at] == new
                fine = old & self.known[at]
            for i, c in zip(np.flatnonzero(~old).tolist(), new[~old].tolist()):
                ok = self.fresh.get(c)
                if ok is None:
                    a, b = self._name(c >> 22), self._name(c & (1 << 22) - 1)
                    ok = self.fresh[c] = self.merge(a + b) == ([a, b] if a else [b])
                fine[i] = ok
            if len(self.fresh) > FRESH:
                more = np.array(sorted(self.fresh))
                at = np.searchsorted(self.pairs, more)
                self.pairs, self.known = np.insert(self.pairs, at, more), np.insert(self.known, at, [self.fresh[c] for c in more.tolist()])
                self.fresh.clear()
            out[far] = fine[inv]
            # of several pairs of one place the last stays, in both tables
            slot = (mix(new.view(U)) >> U(64 - AT_HAND)).view(np.int64)
            self.place[slot], self.fine[slot] = new, fine
        return out

    def _leads(self) -> np.ndarray:
        """Which leading bits the keys have."""
        if self.sieved is not self.keys:
            self.sieve = np.zeros(1 << SIEVE, bool)
            self.sieve[self.keys >> U(64 - SIEVE)] = True
            self.sieved = self.keys
        return self.sieve

    def viterbi(self, ws: list[str]) -> np.ndarray:
        """Lattice ids of words of one length, as a matrix of piece ids by end place (-1: none ends there)."""
        n, size = len(ws), len(ws[0])
        codes = np.frombuffer("".join(ws).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.int64)
        acc, down = self._prefix(codes), powers(size + 1)[1]
        leads = self._leads()
        last, back = np.full((n, size + 1), START, np.int64), np.zeros((n, size + 1), np.int64)
        for j in range(1, size + 1):
            m = min(j, self.longest)
            lens = np.arange(1, m + 1)
            h = mix((acc[:, j : j + 1] - acc[:, j - lens]) * down[j - lens] + lens.astype(U) * U(0xA24BAED4963EE407))
            cand = np.full((n, m), -1, np.int64)
            like = np.nonzero(leads[h >> U(64 - SIEVE)])
            h = h[like]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            cand[like] = np.where(self.keys[at] == h, self.ids[at], -1)
            cand[:, 0] = np.where(cand[:, 0] < 0, OTHER + codes[:, j - 1], cand[:, 0])
            r, c = np.nonzero(cand >= 0)
            ok = self.compatible(last[r, j - lens[c]], cand[r, c])
            score = np.zeros((n, m), np.int64)
            score[r[ok], c[ok]] = lens[c[ok]]
            best = score.argmax(1)
            if not score[np.arange(n), best].all():
                raise AssertionError("a prefix without a segmentation")
            last[:, j], back[:, j] = cand[np.arange(n), best], lens[best]
        out = np.full((n, size), -1, np.int64)
        at = np.full(n, size)
        while (live := np.flatnonzero(at > 0)).size:
            out[live, at[live] - 1] = last[live, at[live]]
            at[live] -= back[live, at[live]]
        return out

    def add(self, ws) -> None:
        """Segment words that are not cached, part by part."""
        if len(self.cache) + len(ws) > CACHE:
            self.cache.clear()  # emptied before, so that all of ``ws`` is put back
        if len(self.parts) > CACHE:
            self.parts.clear()
        whole = [w for w in ws if w.lstrip(MARK).isalpha()]
        cut = {w: self._parts(w) for w in set(ws).difference(whole)}
        by: dict[int, list[str]] = {}
        for x in set(whole).union(*cut.values()).difference(self.parts):
            if x.startswith(MARK + MARK) or len(x) > LONG:
                self.parts[x] = self._merged(x)
            else:
                by.setdefault(len(x), []).append(x)
        for size, group in by.items():
            step = max(1, (1 << 18) // size)
            for i in range(0, len(group), step):
                self._solve(group[i : i + step], size)
        parts = self.parts
        self.cache.update((w, parts[w]) for w in whole)
        for w, xs in cut.items():
            self.cache[w] = b"".join([parts[x] for x in xs])

    def _solve(self, part: list[str], size: int) -> None:
        """Segment parts of one length."""
        rows = self.viterbi(part)
        ids, ends = rows[rows >= 0], np.cumsum((rows >= 0).sum(1))
        plain, names = (ids < OTHER).all(), list(map(self._name, ids.tolist()))
        raw = ids.astype("<u4").tobytes() if plain else b""
        # pieces that spell all parts, each within its own length, spell each part
        spelt = plain and np.array_equal(np.cumsum(self.size[ids])[ends - 1], size * np.arange(1, len(part) + 1)) and "".join(names) == "".join(part)
        at = 0
        if spelt:
            for x, end in zip(part, (4 * ends).tolist()):
                self.parts[x] = raw[at:end]
                at = end
            return
        for x, end in zip(part, ends.tolist()):
            if "".join(names[at:end]) != x:  # a substring hash met another piece's key
                self.parts[x] = self._merged(x)
            else:
                self.parts[x] = raw[4 * at : 4 * end] if plain else self._bytes(ids[at:end].tolist())
            at = end

    def _merged(self, x: str) -> bytes:
        return self._bytes([self.rank[p][1] if p in self.rank else OTHER + ord(p) for p in self.merge(x)])

    def _parts(self, w: str) -> list[str]:
        """A word, cut where no piece can reach across; plain words are left whole."""
        if w.lstrip(MARK).isalpha():
            return [w]
        out, at = [], 0
        for i in range(1, len(w)):
            if w[i - 1 : i + 1] not in self.touching:
                out.append(w[at:i])
                at = i
        out.append(w[at:])
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        out = []
        for i in ids:
            out += [self.bytes[b] for b in chr(i - OTHER).encode()] if i >= OTHER else [i]
        return np.array(out, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out, got = [], self.cache
        for i in range(0, len(texts), 500):
            split = [self.split(t) for t in texts[i : i + 500]]
            asked = set().union(*split)
            new = asked - got.keys()
            if new:
                # a full cache is emptied, and then all words of the batch are needed
                self.add(asked if len(got) + len(new) > CACHE else new)
            out += [b"".join(map(got.__getitem__, ws)) for ws in split]
        return out

    def decode(self, ids: np.ndarray) -> str:
        odd, parts = self.odd[ids], []
        cuts = [0, *(np.flatnonzero(odd[1:] != odd[:-1]) + 1).tolist(), len(ids)]
        ids, bytewise = ids.tolist(), bool(len(odd) and odd[0])
        # plain pieces and others in turn
        for a, z in zip(cuts, cuts[1:]):
            parts += self._spelt(ids[a:z]) if bytewise else map(self.text.__getitem__, ids[a:z])
            bytewise = not bytewise
        s = "".join(parts).replace(MARK, " ")
        return s[1:] if s.startswith(" ") else s

    def _spelt(self, ids: list[int]) -> list[str]:
        """Texts of bytes and control pieces; a control piece has none and ends a run of bytes."""
        parts, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            parts.append(run.decode("utf-8", "replace"))
            run = bytearray()
            if i not in self.silent:
                parts.append(self.text[i])
        return [*parts, run.decode("utf-8", "replace")]


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _read_back(m: Model, blobs) -> pa.Array:
    return pa.array([m.decode(np.frombuffer(x or b"", "<u4")) for x in blobs], pa.string())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``(doc_id, text, ids)``; ids are little-endian unsigned 32-bit integers.

    With ``decoded`` the column that ``decode`` adds comes along, from the same
    worker: two operators in a row take two workers a task, each with the
    model, its tables and its caches.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        m = model(path)
        for b in batches:
            ids = m.encode_batch([t or "" for t in b.column(1).to_pylist()])
            more = {"decoded": _read_back(m, ids)} if decoded else {}
            yield pa.record_batch({"doc_id": b.column(0), "text": b.column(1), "ids": pa.array(ids, pa.binary())} | more)
            del ids, more
            release()

    return small_batches(docs).select(doc_id, text).mapInArrow(run, f"doc_id {kind}, text string, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows with ``ids``."""
    cols = encoded.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)

    def run(batches):
        m = model(path)
        for b in batches:
            texts = _read_back(m, b.column(b.schema.get_field_index(ids)).to_pylist())
            yield pa.record_batch({c: b.column(i) for i, c in enumerate(cols)} | {"decoded": texts})

    return encoded.mapInArrow(run, fields + ", decoded string")
