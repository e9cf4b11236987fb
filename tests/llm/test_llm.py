"""Brute force against the operators on small, awkward tables."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteseer.llm import _dist, _lookup, _text, chat, fingerprint, jaccard, packing, pieces, quality, registry, repeats, shards, toxicity, urlfilter
from siteseer.llm.registry import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def awkward(seed=0):
    """Null, empty and blank texts, copies, near copies, odd white space, other scripts."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Été", "ß", "日本", "😀", "A", "a", "\u00a0x", "\x1cy"]
    make = lambda n: " ".join(rnd.choices(vocab, k=n))
    base = [make(rnd.randint(20, 120)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "one two three", "one two three", "ONE two three four", "one two three four"]
    for b in base:
        texts += [b, b] if rnd.random() < 0.4 else [b]
        for _ in range(rnd.randint(0, 3)):
            w = b.split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            texts.append(rnd.choice(["  ", "\n", ""]) + rnd.choice([" ", "\t", "\n"]).join(w))
    passage = make(60)
    texts += [make(10) + " " + passage + " " + make(10) for _ in range(4)] + [passage, passage + " " + passage]
    rnd.shuffle(texts)
    return texts


# words and packing of columns


def test_words_and_hashes():
    texts = [t or "" for t in awkward(3)]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, wo = _text.words(buf, offs)
    seen = {}
    for i, t in enumerate(texts):
        ws = WORD.findall(t)
        assert len(ws) == wo[i + 1] - wo[i]
        for w, x in zip(ws, h[wo[i] : wo[i + 1]].tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for c in (np.array([5, -3, 2**40], np.int64), np.array([], np.uint32), np.array([1, 2**64 - 1], np.uint64)):
        assert (_text.unpack(_text.pack(c, c))[1] == c).all()


def test_components(spark):
    rnd = random.Random(1)
    edges = [(p, rnd.randrange(60), rnd.randrange(60)) for p in (0, 1) for _ in range(40)] + [(2, i, i + 1) for i in range(100, 140)] + [(3, 7, 7)]
    got = {(r["part"], r["node"]): r["component"] for r in _dist.connected_components(spark.createDataFrame(edges, "part int, a long, b long")).collect()}
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for p, a, b in edges:
        if a != b:
            x, y = root((p, a)), root((p, b))
            up[max(x, y)] = min(x, y)
            up.setdefault(min(x, y), min(x, y))
    nodes = {(p, v) for p, a, b in edges if a != b for v in (a, b)}
    assert got == {n: root(n)[1] for n in nodes}
    assert _dist.connected_components(spark.createDataFrame([], "part int, a long, b long")).count() == 0


def test_small_graphs_are_solved_by_one_task(spark, monkeypatch):
    """In rounds or at once: the same components."""
    rnd = random.Random(2)
    edges = spark.createDataFrame([(p, rnd.randrange(90), rnd.randrange(90)) for p in (0, 4) for _ in range(60)] + [(1, i, i + 1) for i in range(40, 0, -1)], "part int, a long, b long")
    solved = []
    monkeypatch.setattr(_dist, "_solved", lambda e, f=_dist._solved: solved.append(1) or f(e))
    got = []
    for small in (0, 10**6):
        monkeypatch.setattr(_dist, "SMALL_GRAPH", small)
        got.append(sorted(tuple(r) for r in _dist.connected_components(edges).collect()))
    assert got[0] == got[1] and len(solved) == 1


# 1 toxicity


def toxic_tables(spark, n=600):
    rnd = random.Random(4)
    plain, bad = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)], ["vile", "rotten", "grubby", "mukki"]
    texts, labels = [], []
    for i in range(n):
        t = i % 6 == 0
        w = rnd.choices(plain, k=rnd.randint(5, 80))
        if t:
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(bad) + rnd.choice(["", ",", "."])
        texts.append(" ".join(w))
        labels.append((i, 1, int(t)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_finds_held_out(spark):
    docs, labels, truth = toxic_tables(spark)
    clf = toxicity.fit(docs, labels)
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "VILE rotten", "en", "s", 0)], SCHEMA)
    rows = {r["doc_id"]: r for r in toxicity.score(docs.unionByName(extra), clf).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert rows[9001]["score"] == rows[9002]["score"] < 0.5 and rows[None]["predicted"] == 1
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in rows if rows[i]["held_out"]} == set(held) | {i for i in (9001, 9002) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [rows[i]["predicted"] == t for i, _, t in truth if i in set(held)]
    assert sum(right) / len(right) > 0.97
    kept = toxicity.reject(docs, clf)
    assert kept.columns == docs.columns and kept.count() == sum(1 for i, _, _ in truth if not rows[i]["predicted"])


def test_toxicity_without_evidence(spark):
    docs, labels, _ = toxic_tables(spark, 30)
    for lab in (labels.where("false"), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        clf = toxicity.fit(docs, lab)
        assert {r["predicted"] for r in toxicity.score(docs, clf).collect()} == {0}
    assert toxicity.score(docs.where("false"), clf).count() == 0


def test_label_model_weighs_voters():
    rnd = np.random.default_rng(0)
    y = rnd.random(4000) < 0.2
    good = np.where(rnd.random(4000) < 0.9, y, ~y).astype(int)
    poor = np.where(rnd.random(4000) < 0.55, y, ~y).astype(int)
    gold = np.where(rnd.random(4000) < 0.9, y, ~y).astype(int)
    post, acc, corr = toxicity.label_model(np.column_stack([good, good, poor]), gold)
    assert ((post > 0.5) == y).mean() > 0.88
    assert acc[1][2][0] > acc[1][2][2] and corr[0, 1] > 0.9 > abs(corr[0, 2])


# 2 pieces


def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    sp, m = SentencePieceProcessor(model_file=path), pieces.Model(path)
    texts = [t or "" for t in awkward(5)] + ["a  b   c", "  x", "x ", "\n\n", "    if (a==b){", "日本語のテキスト𐍈", "https://a.b/c?d=1", "e\u0301", "<s> </s> <0x41>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789 10000000"]
    rnd = random.Random(2)
    texts += ["".join(rnd.choices("abehinorst ,.", k=80)) for _ in range(200)]
    got = [np.frombuffer(b, "<u4").tolist() for b in m.encode_batch(texts)]
    assert got == sp.encode(texts)
    docs = frame(spark, [*texts, None])
    rows = pieces.decode(pieces.encode(docs, path), path).collect()
    assert all((r["text"] or "") == r["decoded"] for r in rows) and len(rows) == len(texts) + 1
    assert pieces.encode(docs.where("false"), path).count() == 0


def test_pieces_are_read_back_by_their_worker(spark, tmp_path):
    """The same rows as by two operators, and one step of Python in the query's plan: a task has one worker with the tables."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = frame(spark, [*awkward(6), "日本𐍈 <s>\u2581x", None])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    one = registry.op2_sentencepiece(spark, str(tmp_path))
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = pieces.decode(pieces.encode(docs, path), path).collect()
    assert Counter(tuple(r) for r in pieces.encode(docs, path, decoded=True).collect()) == Counter(tuple(r) for r in two)
    got = {r["doc_id"]: r for r in one.collect()}
    assert len(got) == len(two)
    for r in two:
        x = got[r["doc_id"]]
        assert (x["n_ids"], x["ids_crc32"]) == (len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        assert x["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest() and x["round_trip"] == (r["decoded"] == (r["text"] or ""))


def test_pieces_survive_colliding_keys():
    """A substring whose hash meets another piece's key does not get that piece."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    sp, m = SentencePieceProcessor(model_file=path), pieces.Model(path)
    for odd, piece in (("zq", "th"), ("xj", "▁the"), ("q", "a")):
        key = m._keys(odd)
        at = np.searchsorted(m.keys, key)
        if m.keys[at[0]] != key[0]:
            m.keys, m.ids = np.insert(m.keys, at, key), np.insert(m.ids, at, m.rank[piece][1])
    texts = ["azqb zq the", "xj xjx axj", "thzq zqth", "quick brown"]
    assert [np.frombuffer(b, "<u4").tolist() for b in m.encode_batch(texts)] == sp.encode(texts)


# 3 chats


def test_pieces_with_small_tables(monkeypatch):
    """Pairs that share a place and substrings that the sieve lets through change no id; most substrings are never searched."""
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    texts = [t or "" for s in (2, 3) for t in awkward(s)]
    rnd = random.Random(4)
    texts += ["".join(rnd.choices("abehinorst", k=12)) + f" id{i * 7919 % 100003}" for i in range(300)]
    searched, found = [], np.searchsorted
    monkeypatch.setattr(pieces.np, "searchsorted", lambda a, v, *x, **y: searched.append(np.size(v)) or found(a, v, *x, **y))
    for bits, sieve, pairs, fresh in ((20, 22, 2_000_000, 20_000), (1, 1, 2_000_000, 7), (3, 12, 50, 9)):
        for name, value in (("AT_HAND", bits), ("SIEVE", sieve), ("PAIRS", pairs), ("FRESH", fresh)):
            monkeypatch.setattr(pieces, name, value)
        searched.clear()
        m = pieces.Model(path)
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode_batch(texts)] == [sp.encode(t) for t in texts]
        asked = sum(len(x) * (len(x) + 1) // 2 for x in m.parts if len(x) <= m.longest)
        assert (sum(searched) < asked / 2) == (sieve == 22)


def test_chats_round_trip(spark):
    rnd = random.Random(3)
    bits = ["<|turn|>", "<|end|>", "<|", "<||", "|>", "<", "|", "</s>[INST]", "x", "\n", "é", "<|joint|>"]
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 7)):
            rows.append((c if c else None, t if rnd.random() < 0.9 else 0, rnd.choice(["user", "assistant", "assistant", "system", None, "<|text|>", ""]), rnd.choice([None, ""]) if rnd.random() < 0.2 else "".join(rnd.choices(bits, k=5)), "other"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat.format_chats(df)
    back = {r["conv_id"]: r for r in chat.read_chats(out).collect()}
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append((t, r or "", x or ""))
    assert set(back) == set(groups)
    for c, g in groups.items():
        g.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in g]
        assert back[c]["loss_texts"] == [x[2] for x in g if x[1] == "assistant"]
    for r in out.collect():
        at = 0
        for m in r["loss"]:  # the mask points at the escaped texts
            at += m["skip"]
            piece = r["formatted"][at : at + m["take"]]
            assert not re.search(r"<\|(?!\|)", piece)
            at += m["take"]
        assert r["formatted"][at:] == chat.END
    assert chat.format_chats(df.where("false")).count() == 0


# 4 packing


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, mine = Tokenizer.from_file(path), packing.Chunks(path)
    rnd = random.Random(1)
    letters = "aAbé ÉßÄñ'st'S'LL!?_09½²Ⅷ\u0301İıŉΣς一ǅ<|>\t\n  \u0085\x1c-…𐍈ﬁ₂"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(800)] + ["<|endoftext|>", "a<|startoftext|>b c"]
    for t in texts:
        assert np.frombuffer(mine.ids(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rnd = random.Random(6)
    texts = [None, "", *[" ".join(rnd.choices(["red", "green", "blue"], k=rnd.randint(1, 90))) for _ in range(300)], "word " * 200]
    docs = frame(spark, texts)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    enc = packing.encoder(path)
    for i, t in enumerate(texts):
        ids = enc.ids((t or "").encode()) + bytes(4)
        ps = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in ps] == list(range(len(ps))) and [p["start"] for p in ps] == [64 * j for j in range(len(ps))]
        assert [p["ids_crc32"] for p in ps] == [zlib.crc32(ids[256 * j : 256 * j + 256]) for j in range(len(ps))]
        assert sum(p["length"] for p in ps) == len(ids) // 4
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 64) + 2
    assert packing.pack_documents(docs.where("false"), path).count() == 0
    cut = packing.pieces(docs, path, capacity=64, with_ids=True)
    whole = packing.sequences(packing.pack_pieces(_dist.stash(cut, "t"), 64)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * total and max(len(r["ids"]) for r in whole) <= 256


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_piece_once(seed):
    rnd = np.random.default_rng(seed)
    counts = np.zeros(257, np.int64)
    for x in rnd.integers(1, 257, rnd.integers(0, 3000)) if seed % 2 else rnd.geometric(0.02, 2000).clip(1, 256):
        counts[x] += 1
    used = Counter()
    n = 0
    for base, t in packing.plan(counts, 256):
        assert sum(base) <= 256 and t > 0
        n += t
        for x in base:
            used[x] += t
    assert used == Counter({i: int(c) for i, c in enumerate(counts) if c})
    assert n <= -(-int((np.arange(257) * counts).sum()) // 256) * 1.02 + max(1, (counts[129:] > 0).any() * counts[129:].sum() * (seed % 2))


# 5 shards


def test_shards(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("abc é", k=rnd.randint(0, 200))) for _ in range(1500)] + ["same text " * 9] * 60 + [None, ""]
    docs = frame(spark, texts)
    rows = shards.shard(docs, 8).collect()
    assert len(rows) == len(texts)
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()), "bytes", None)
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / 8
    assert max(size.values()) - min(size.values()) < 0.03 * share
    assert all(len(s) == 1 for s in where.values())
    assert shards.shard(docs.where("false"), 8).count() == 0


def test_one_text_heavier_than_a_share(spark):
    texts = ["x" * 50] * 400 + ["y%d" % i * 10 for i in range(400)]
    rows = shards.shard(frame(spark, texts), 4).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.2 * min(size.values())


# 6 fingerprints


def test_prefix_hashes():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(97, 99, 400)
    p = fingerprint.Prefix(codes)
    for i, j in rnd.integers(0, 400, (60, 2)).tolist():
        k = 0
        while i + k < 400 and j + k < 400 and codes[i + k] == codes[j + k]:
            k += 1
        assert p.common_extension(i, j) == k
        assert p.equal(i, j, k)


def naive_hash(codes):
    out = 0
    for p, b in zip(fingerprint.MODULI, fingerprint.BASES):
        out = out << 31 | sum((c + 1) * pow(b, i, p) for i, c in enumerate(codes)) % p
    return out


def mix64(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def naive_sketch(text):
    """Slot -> (least hash, its first place), by plain loops."""
    codes, out = [ord(c) for c in text], {}
    spans = [codes[i : i + 16] for i in range(len(codes) - 15)] if len(codes) >= 16 else [codes] * bool(codes)
    for i, s in enumerate(spans):
        h = mix64(naive_hash(s))
        slot, h = h >> 58, h & (1 << 58) - 1
        if slot not in out or h < out[slot][0]:
            out[slot] = (h, i)
    return out


def naive_hex(sk):
    return "".join(f"{mix64(sk[s][0]) % 65535 + 1 if s in sk else 0:04x}" for s in range(64))


def naive_likeness(a, b):
    """Code points of both texts in common runs around agreeing slots."""
    if not a and not b:
        return 1.0
    x, y = naive_sketch(a), naive_sketch(b)
    in_a, in_b = set(), set()
    for s in x.keys() & y.keys():
        (h, i), (g, j) = x[s], y[s]
        if h != g:
            continue
        n = min(16, len(a))
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        while i and j and a[i - 1] == b[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        in_a |= set(range(i, i + n))
        in_b |= set(range(j, j + n))
    return (len(in_a) + len(in_b)) / (len(a) + len(b))


def test_fingerprints_equal_plain_loops(spark):
    rnd = random.Random(12)
    texts = [t[:260] if t else t for t in awkward(9)[:30]] + ["a" * 40, "a" * 55, "x" * 15, "xyxyxyxyxyxyxyxyxyxyxyxyxy", "\U0001F600" * 20]
    base = "".join(rnd.choices("abcde fgh", k=200))
    texts += [base, base[:90] + "Q" + base[90:], base[50:150], "zz" + base, base]
    rows = {r["doc_id"]: r for r in fingerprint.compare_with_edits(frame(spark, texts), rows_per_range=6).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i]["fingerprint"] == naive_hex(naive_sketch(t)) and rows[i]["edited_fingerprint"] == naive_hex(naive_sketch(edited))
        assert rows[i]["near_edited"] == pytest.approx(naive_likeness(t, edited)) and rows[i]["near_next"] == pytest.approx(naive_likeness(t, nxt))
    assert rows[len(texts) - 5]["near_next"] > 0.9


def test_ranges_of_ids(spark):
    cuts = sorted(random.Random(1).sample(range(-500, 500), 77))
    df = spark.range(-600, 600).select("id", fingerprint.range_of(F.col("id"), cuts).alias("r"))
    assert all(r["r"] == sum(c <= r["id"] for c in cuts) for r in df.collect())
    ids = spark.range(1000).select(F.col("id").alias("i"))
    assert fingerprint.range_cuts(ids, 1000, 1) == [] and len(fingerprint.range_cuts(ids, 1000, 8)) == 7


def test_fingerprints(spark):
    texts = awkward(8)
    docs = frame(spark, texts).withColumn("doc_id", F.col("doc_id") * 3 - 50)
    rows = fingerprint.compare_with_edits(docs, rows_per_range=7).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    same = {}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        r, half = by[3 * i - 50], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == alone[3 * i - 50] == same.setdefault(t, r["fingerprint"])
        assert r["edited_fingerprint"] == same.setdefault(edited, r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if t == nxt:
            assert r["near_next"] == 1
    assert fingerprint.compare_with_edits(docs.where("false")).count() == 0
    assert fingerprint.compare_with_edits(docs.where("doc_id = 1")).collect()[0]["near_next"] == 1


# 7 joins


def brute_join(texts, k, pct):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= pct * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed,k,pct,agree,block", [(1, 4, 85, 9, 2000), (2, 5, 80, 99, 2000), (3, 2, 60, 99, 3), (4, 3, 85, 99, 4), (5, 4, 85, 9, 3)])
def test_join_equals_brute_force(spark, monkeypatch, seed, k, pct, agree, block):
    """``agree`` 99 leaves all links to the second step; small blocks deal groups out."""
    monkeypatch.setattr(jaccard, "AGREE", agree)
    texts = awkward(seed)
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, k, pct, block=block, share=0.2).collect()}
    assert got == brute_join(texts, k, pct)
    assert jaccard.join_components(docs.where("false"), k, pct).count() == 0


def test_bitmaps_lose_no_link():
    rnd = np.random.default_rng(3)
    for pct in (50, 80, 85, 100):
        least = jaccard.size_classes(400, pct)
        at = lambda n: int(np.searchsorted(least, n, "right")) - 1
        assert all(at(b) - at(a) <= 1 for a in range(1, 400) for b in range(a, min(400, 100 * a // pct) + 1))
    sets = [rnd.integers(0, 1 << 63, int(n)).astype(np.uint64) for n in rnd.integers(0, 700, 30)]
    sets += [np.concatenate([x[len(x) // 9 :], rnd.integers(0, 1 << 63, 9).astype(np.uint64)]) for x in sets]
    so = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    words, wo = jaccard.bitmaps(np.concatenate(sets), so)
    assert len(words) == wo[-1]
    m = jaccard.folded(words, np.diff(so))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(m[i] ^ m[j]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_pairs_of_lists():
    """All pairs of a list whose sizes fit, each once."""
    h = np.array([3, 3, 3, 3, 7, 9, 9], np.uint64)
    n = np.array([10, 11, 12, 40, 5, 6, 7])
    got = [(int(a), int(b)) for x, y in jaccard._pairs(np.arange(7), h, n, 80) for a, b in zip(x, y)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (5, 6)]


def test_passages_do_not_chain_documents(spark, monkeypatch):
    """Documents that share passages, each with other ones, are no candidates: groups do not grow with the table."""
    monkeypatch.setattr(jaccard, "AGREE", 99)
    seen = []
    monkeypatch.setattr(jaccard, "_verified", lambda live, members, *a, f=jaccard._verified: seen.append([r["count"] for r in members.groupBy("cluster").count().collect()]) or f(live, members, *a))
    rnd = random.Random(8)
    passages = [[f"p{i}x{j}" for j in range(40)] for i in range(60)]
    texts = [" ".join(passages[i] + passages[(i + 1) % 60] + [f"d{i}x{rnd.random()}" for _ in range(8)]) for i in range(60)]
    near = texts[7].split(" ")
    texts.append(" ".join(near[:-1] + ["other"]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(frame(spark, texts), 4, 85).collect()}
    assert got == brute_join(texts, 4, 85) and got[60][1] == 7
    assert max(x for sizes in seen for x in sizes) < 5


@pytest.mark.parametrize("edges,weight", [(0, 1 << 20), (1 << 20, 40)])
def test_join_in_rounds_and_by_weight(spark, monkeypatch, edges, weight):
    """Graphs in rounds; blocks by the shingles of their members; pairs tested a few at a time."""
    monkeypatch.setattr(_dist, "SMALL_GRAPH", edges)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", weight)
    monkeypatch.setattr(jaccard, "EDGE_BUCKET", 64)
    monkeypatch.setattr(jaccard, "PAIRS", 3)
    monkeypatch.setattr(jaccard, "AGREE", 99 if edges else 9)
    texts = awkward(11)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(frame(spark, texts), 4, 80, share=0.2).collect()}
    assert got == brute_join(texts, 4, 80)


def test_keep_one(spark):
    texts = awkward(6)
    want = {i for i, (_, c) in brute_join(texts, 5, 80).items() if c == i}
    out = jaccard.keep_one(frame(spark, texts), 5, 80)
    assert {r["doc_id"] for r in out.collect()} == want and out.columns[0] == "doc_id"


def test_keep_one_judges_rows(spark):
    a, b, c = ("%s " % x * 3 + " ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, c), (9, b), (9, b), (9, b), (None, c), (None, "only here " * 9), (3, None), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, component_id int").repartition(3)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "")[:3]) for r in jaccard.keep_one(df).collect())
    assert kept == [(False, 1, "a a"), (False, 3, ""), (False, 3, ""), (False, 4, ""), (False, 5, "b b"), (False, 7, "c c"), (True, 0, "onl")]
    equal = spark.createDataFrame([(2, a)] * 5, "doc_id long, text string")
    assert jaccard.keep_one(equal).count() == 1 and jaccard.keep_one(equal.where("false")).count() == 0


def test_join_reads_few_texts_at_once(spark, tmp_path):
    """The reader's batches are bounded for the passes over the texts, a lower bound stays, and rows are the same."""
    key, texts = "spark.sql.parquet.columnarReaderBatchSize", awkward(8) * 20
    frame(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/d")
    docs, before = spark.read.parquet(f"{tmp_path}/d"), spark.conf.get(key)
    got = []
    try:
        for rows, bound in ((4096, _dist.READ_ROWS), (7, 7)):
            spark.conf.set(key, rows)
            got.append(sorted(tuple(r) for r in jaccard.join_components(docs).collect()))
            assert int(spark.conf.get(key)) == bound
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0]) == len(texts)


def test_lookups_do_not_move_texts(spark, monkeypatch):
    """However large a lookup is, texts are not shuffled for it; turns and bitmaps give the same result."""
    texts = awkward(6) + [f"{t} and one more word" for t in awkward(6)[:40] if t and len(t) < 5000] + awkward(6)
    want = brute_join(texts, 5, 80)
    monkeypatch.setattr(_lookup, "TURN_ROWS", 7)
    monkeypatch.setattr(_lookup, "BLOB_ROWS", 3)
    for m in (_dist, jaccard, _lookup):
        if hasattr(m, "lookup_join"):
            monkeypatch.setattr(m, "lookup_join", lambda *a, f=_dist.lookup_join, **b: f(*a, **b | {"limit": 1 << 15}))
    mapped = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, f=type(spark.range(0)).mapInArrow, **b: mapped.append(self) or f(self, *a, **b))
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, 5, 80, share=0.2).collect()}
    assert got == want
    plans = [x._jdf.queryExecution().sparkPlan().toString() for x in mapped if "text" in x.columns]
    assert plans and not any("Join" in x for x in plans)
    assert {r["doc_id"] for r in jaccard.keep_one(docs, 5, 80).collect()} == {i for i, (_, c) in want.items() if c == i}


def test_entries_of_turns(spark, monkeypatch):
    """Every entry is found once, in the turn of its id, whatever the ids."""
    monkeypatch.setattr(_lookup, "BLOB_ROWS", 3)
    ids = [-(1 << 63), -5, 0, 0, 0, 0, 0, 0, 0, 3, 4, 4, 9, 1 << 40, (1 << 63) - 1]
    rows = _dist.stash(spark.createDataFrame([(d, 10 * i - 7) for i, d in enumerate(ids)], "doc_id long, value long").repartition(4), "t")
    asked = spark.createDataFrame([(d,) for d in sorted({*ids, 1, 8})], "doc_id long").repartition(3)

    def run(batches, blobs):
        found = _lookup.Found(blobs.value)
        for b in batches:
            row, value = found(b.column(0).to_numpy())
            yield pa.record_batch({"d": b.column(0).to_numpy()[row], "v": value})

    for most in (2, 4, 100):
        monkeypatch.setattr(_lookup, "TURN_ROWS", most)
        all_turns = _lookup.turns(rows, "t")
        assert len(all_turns) > 1 or most == 100
        got = _lookup.by_turns(asked, all_turns, lambda own, blobs: own.mapInArrow(lambda b: run(b, blobs), "d long, v long")).collect()
        assert sorted((r["d"], r["v"]) for r in got) == sorted((d, 10 * i - 7) for i, d in enumerate(ids))


def test_hubs_do_not_meet(spark, monkeypatch):
    """A hub's edges get its minimum by broadcast: same components with any threshold."""
    edges = spark.createDataFrame([(0, 1000, i) for i in range(200)] + [(0, i, i + 500) for i in range(50)] + [(1, 7, 9)], "part int, a long, b long")
    want = None
    for rows in (10**9, 3, 64):
        monkeypatch.setattr(_dist, "HOT_ROWS", rows)
        got = sorted(tuple(r) for r in _dist.connected_components(edges).collect())
        assert want in (None, got)
        want = got


# 8 urls


def test_cascade_is_exact(spark):
    rnd = random.Random(9)
    hosts = [f"h{i}.example.com" for i in range(3000)]
    bad = set(rnd.sample(hosts, 300))
    df = spark.createDataFrame([(h,) for h in hosts], "key string")
    keys = urlfilter.universe(df, spark.createDataFrame([(h,) for h in bad], "key string"))
    levels = urlfilter.build_cascade(keys)
    assert len(levels) > 1
    assert {r["key"] for r in df.where(urlfilter.contains(F.col("key"), levels)).collect()} == bad
    assert urlfilter.build_cascade(keys, 64) is None and urlfilter.build_cascade(keys.where("false")) == []


def test_large_lists_are_dealt_into_cascades(spark):
    """A list beyond one cascade's bits, in many parts of several levels: still exact, and without a join."""
    pages = spark.createDataFrame([(i, f"http://h{i % 700}.net/x") for i in range(1500)] + [(-1, None)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.net",) for i in range(0, 700, 3)] + [("elsewhere.org",)], "key string")
    out = urlfilter.filter_urls(pages, [], listed, max_bits=1200)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert len(got) == 1501 and all(v == ("block" if i >= 0 and i % 700 % 3 == 0 else "allow") for i, v in got.items())
    keys = urlfilter.universe(spark.createDataFrame([(f"h{i}.net",) for i in range(700)], "key string"), listed)
    parts = urlfilter.build_parts(keys, 1200)
    assert len(parts) >= 4 and max(len(p) for p in parts) > 1


def test_url_rules(spark):
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"), urlfilter.Rule("block", "example.org", "/en/1")]
    urls = [(0, "HTTP://A.Example.ORG/es/x?q#f"), (1, "x://example.org/en/12"), (2, "x://badexample.org/es/"), (3, None), (4, "no scheme"), (5, "x://spam.net?a/b"), (6, "x://ok.net#z"), (7, "x://org"), (8, ""), (9, "x://spam.net/a://b/c")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    listed = spark.createDataFrame([("spam.net",)], "key string")
    for most in (urlfilter.MAX_BITS, 12):  # by one cascade and by two
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(df, rules, listed, max_bits=most).collect()}
        assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block")
        assert got[2][2:] == ("org/", "allow") and got[3] == got[4] == got[8] == ("", "", None, "allow")
        assert got[5] == ("spam.net", "", None, "block") and got[6][3] == "allow" and got[7][2] is None
        assert got[9] == ("spam.net", "/a://b/c", None, "block")
    assert urlfilter.filter_urls(df.where("false"), rules, listed).count() == 0


# 9 repeats


def brute_repeats(texts, k):
    first, words = {}, [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - k + 1):
            first.setdefault(tuple(w[j : j + k]), i)
    out = {}
    for i, w in enumerate(words):
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed,k,bits,common", [(1, 13, 64, 10**9), (2, 3, 64, 0), (3, 5, 11, 10**9), (4, 4, 9, 0)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, k, bits, common):
    """``bits``: first hashes that collide are settled; ``common`` 0: windows that recur in a buffer take the second pass."""
    monkeypatch.setattr(repeats, "REQUESTS", 3)
    monkeypatch.setattr(repeats, "HASH_BITS", bits)
    monkeypatch.setattr(repeats, "COMMON_LEAST", common)
    texts = awkward(seed)
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in repeats.remove_repeats(docs, k).collect()}
    assert got == brute_repeats(texts, k)
    if seed > 2:
        return
    kept = {r["doc_id"]: r for r in repeats.edit_documents(docs, k).collect()}
    for i, t in enumerate(texts):
        assert kept[i]["text"] == (t if not got[i][1] else got[i][2]) and kept[i]["lang"] == "en"
    assert repeats.remove_repeats(docs.where("false"), k).count() == 0


def test_paths_do_not_branch(spark):
    """The paths are those of a graph built by hand: repeated k-mers, nodes of k - 1 words, cut where degrees differ from one."""
    k, rnd = 4, random.Random(8)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(12)) for x in "abcd")
    texts = [f"{a} {b}", f"{a} {c}", f"q {a} {b} z", f"{c} {d}", f"{d} {a} {c}", " ".join(rnd.choices("mn", k=40)), " ".join(rnd.choices("mn", k=40))]
    first, docs_of = {}, defaultdict(set)
    for i, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), (i, p))
            docs_of[tuple(w[p : p + k])].add(i)
    edges = {e: first[e] for e, ds in docs_of.items() if len(ds) > 1}
    ins, outs = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    at = {s: e for e, s in edges.items()}
    joined = lambda i, p: (i, p - 1) in at and (i, p) in at and ins[at[i, p][:-1]] == outs[at[i, p][:-1]] == 1
    want = set()
    for i, p in at:
        if not joined(i, p):
            n = 1
            while joined(i, p + n):
                n += 1
            want.add((i, p, n))
    assert {tuple(r) for r in repeats.repeated_paths(frame(spark, texts), k).collect()} == want and len(want) > 5


def test_repeats_judge_rows_of_one_id(spark):
    """Two texts under one id keep their own words where only the other one repeats."""
    a, b = (" ".join(f"{x}{i}" for i in range(20)) for x in "ab")
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (7, "x " + b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["kept_text"]) for r in repeats.remove_repeats(df).collect())
    assert got == [(1, a), (5, ""), (5, b), (7, "x")]


def test_repeats_with_odd_ids(spark):
    text = " ".join(f"t{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (5, text), (5, text), (7, text)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == [("5", 0), ("5", 0), ("7", 20), ("None", 0)]


# 10 quality


@pytest.mark.parametrize("bits", [quality.PLACE_BITS, 5])
def test_quality_equals_brute_force(spark, monkeypatch, bits):
    """With few bits for places, texts of 32 windows and more compare all windows."""
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    texts = ["- a b\n* c\n \u2022 d", "a...\nb\u2026 \nc", "12 34 ab", "\u00e9\u65e5x 1"] + awkward(4) + ["a b c " * 30, "x | y # z\nx | y # z\n \nx | y # z", "!!! " * 60, " ".join(f"q{i % 17}" for i in range(90)), "a\n" * 70]
    rows = {r["doc_id"]: r for r in quality.judge(quality.ledger(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        rep = len({x for p in at.values() if len(p) > 1 for j in p for x in (j, j + 1, j + 2)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[i]
        assert r["n_letters"] == sum(unicodedata.category(c)[0] == "L" for c in t)
        assert (r["n_bullets"], r["n_ellipses"]) == (sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*\u2022" for x in lines), sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "\u2026")) for x in lines))
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), rep)
        assert r["base_failed"] == (len(w) < 50 or 100 * rep > 50 * len(w))
        assert r["kept"] <= (not r["base_failed"]) and r["kept"] == (r["failed"] == 0)
    led = quality.ledger(frame(spark, texts))
    ab = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(led).collect()}
    for b, rule in enumerate(quality.RULES):
        fails = [r["failed"] for r in rows.values() if r["failed"] >> b & 1]
        assert ab[rule] == (len(fails), sum(f == 1 << b for f in fails))
    kept = quality.reject(frame(spark, texts).withColumnRenamed("lang", "w"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]} and "w" in kept.columns
    assert quality.ledger(frame(spark, texts).where("false")).count() == 0
