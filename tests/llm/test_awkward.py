"""Very long texts, repeated rows, null ids and clashing columns, for every operator."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, brute_join, brute_repeats

from siteseer.llm import chat, fingerprint, jaccard, packing, pieces, quality, repeats, shards, toxicity, urlfilter
from siteseer.llm.registry import tokenizer_path

#: Names that the operators use inside.
CLASH = ["h", "n", "src", "start", "spans", "units", "part", "bucket", "blob", "w", "t", "ls", "keys", "row", "ids", "k", "sig", "key", "r", "doc", "failed", "place"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: two of over a mebibyte that share a passage, repeated rows, two texts under one id, null ids."""
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(20_000)]
    a = " ".join(rnd.choices(vocab, k=190_000))
    b = " ".join(rnd.choices(vocab, k=100)) + "\n" + a[5000:9000] + " " + " ".join(rnd.choices(vocab, k=190_000))
    short = " ".join(rnd.choices(vocab, k=60))
    other = " ".join(rnd.choices(vocab, k=70))
    return [(10, a), (20, b), (30, short), (30, short), (40, short + " x"), (50, other), (50, short), (None, other), (None, None), (60, None), (70, ""), (80, " " * 3000 + "y"), (80, " " * 3000 + "y")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *range(len(CLASH))) for i, t in texts], SCHEMA).repartition(4)


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_toxicity(docs, texts):
    clf = toxicity.Classifier({"w:w7": 0, "s:w123": 1}, np.array([2.0, 1.0, *[0.1] * (toxicity.EXTRA - 1), -3.0]))
    got = rows_of(toxicity.score(docs, clf), "doc_id", "score")
    assert got == Counter((i, clf.score(t or "")) for i, t in texts)
    kept = toxicity.reject(docs, clf)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text", "spans") == Counter((i, t, 4) for i, t in texts if clf.score(t or "") < 0.5)


def test_pieces(docs, texts):
    from sentencepiece import SentencePieceProcessor

    path = tokenizer_path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    out = pieces.decode(pieces.encode(docs, path), path).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in out) == Counter((i, t or "") for i, t in texts)
    whole = {r["doc_id"]: r["ids"] for r in out}
    assert np.frombuffer(whole[20], "<u4").tolist() == sp.encode(dict(texts)[20])
    m = pieces.model(path)
    for t in (" " * 100_000, "ab" * 30_000, "x" + " " * 50_000 + "é" * 5000, "w" * 4097, "日" * 9000):
        assert np.frombuffer(m.encode_batch([t])[0], "<u4").tolist() == sp.encode(t)


def test_chats(spark, texts):
    rows = [(c, n, r, t, 0, "z") for c in (1, None) for n, (r, (_, t)) in enumerate(zip(["user", "assistant", "assistant", "user"] * 4, texts))]
    rows += [(2, 5, "assistant", "same", 0, "z")] * 3 + [(3, n, "user" if n % 2 else "assistant", "<|", 0, "z") for n in range(4000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int, ts string").repartition(3)
    back = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = defaultdict(list)
    for c, n, r, t, *_ in rows:
        want[c].append((n, r, t or ""))
    for c, ts in want.items():
        ts.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [x[1:] for x in ts]
        assert back[c]["loss_texts"] == [x[2] for x in ts if x[1] == "assistant"]


def test_masks_must_point_at_texts(spark):
    rows = [(1, 0, "user", "abc"), (1, 1, "assistant", "de"), (1, 2, "assistant", "")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    off = F.transform("loss", lambda m, i: F.struct((m["skip"] + F.when(i == 1, 1).otherwise(0)).alias("skip"), m["take"].alias("take"), m["on"].alias("on")))
    assert chat.read_chats(out).first()["loss_texts"] == ["de", ""]
    for bad in (off, F.slice("loss", 1, 2)):
        with pytest.raises(Exception, match="mask"):
            chat.read_chats(out.withColumn("loss", bad)).collect()


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.update((i, p, 2048 * p, len(x) // 4, zlib.crc32(x)) for p, x in enumerate(ids[j : j + 8192] for j in range(0, len(ids), 8192)))
    out = packing.pack_documents(docs, path)
    assert rows_of(out, "doc_id", "piece", "start", "length", "ids_crc32") == want
    by = defaultdict(list)
    for r in out.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for ps in by.values():
        ps.sort()
        assert [p[0] for p in ps] == [sum(x[1] for x in ps[:i]) for i in range(len(ps))] and sum(x[1] for x in ps) <= 2048


def test_shards(docs, texts):
    rows = shards.shard(docs, 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fingerprints(docs, texts):
    order = sorted(((i is not None, i or 0, t or "") for i, t in texts), key=lambda x: x[:2])
    rows = fingerprint.compare_with_edits(docs, rows_per_range=3).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter((i, len(t or "")) for i, t in texts)
    same = defaultdict(set)
    by = {(r["doc_id"], r["n_chars"]): r for r in rows}
    for i, t in texts:
        same[t or ""].add(by[i, len(t or "")]["fingerprint"])
    assert all(len(s) == 1 for s in same.values())
    a = next(t for ok, i, t in order if i == 10)
    b = next(t for ok, i, t in order if i == 20)
    half = len(a) // 2
    assert by[10, len(a)]["edited_sha256"] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
    assert 0.5 < by[10, len(a)]["near_edited"] < 0.8


def test_join(docs, texts):
    got = rows_of(jaccard.join_components(docs), "doc_id", "n_shingles", "component_id")
    alone = brute_join([t for _, t in texts], 4, 85)
    # ids join what their rows join
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for n, (i, _) in enumerate(texts):
        a, b = sorted((root(("id", i)), root(("set", alone[n][1]))), key=str)
        if i is not None and alone[n][0] and a != b:
            up[b] = a
    least = defaultdict(list)
    for n, (i, _) in enumerate(texts):
        if i is not None and alone[n][0]:
            least[root(("set", alone[n][1]))].append(i)
    want = Counter((i, alone[n][0] if i is not None else 0, None if i is None else min(least[root(("set", alone[n][1]))]) if alone[n][0] else i) for n, (i, _) in enumerate(texts))
    assert got == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and kept.select("spans").distinct().count() == 1


def test_urls(spark):
    long = "http://spam.net/" + "p" * 1_200_000
    urls = [(1, long), (1, long), (None, "x://ok.net"), (2, None), (3, "a" * 1_100_000), (4, "x://" + "h" * 70_000)]
    df = spark.createDataFrame([(i, u, 0, "z", "z", "z") for i, u in urls], "page_id long, url string, part int, host string, key string, hit string")
    got = rows_of(urlfilter.filter_urls(df, [], spark.createDataFrame([("spam.net",), (None,)], "key string")), "page_id", "host", "verdict")
    assert got == Counter({(1, "spam.net", "block"): 2, (None, "ok.net", "allow"): 1, (2, "", "allow"): 1, (3, "", "allow"): 1, (4, "h" * 70_000, "allow"): 1})
    assert urlfilter.filter_urls(df, [], spark.createDataFrame([], "key string")).where("verdict = 'block'").count() == 0


def test_repeats(docs, texts):
    ids = [(i, t) for i, t in texts if i is not None]
    groups = sorted({i for i, _ in ids})
    want = Counter()
    for i, t in texts:
        if i is None:
            want[i, len(WORD.findall(t or "")), 0] += 1
            continue
        # a row against all texts of smaller ids
        before = [x for j, x in ids if j < i]
        got = brute_repeats([*before, t], 13)[len(before)] if not before or max(map(lambda x: len(x or ""), before)) else (0, 0, "")
        # windows among the earlier texts do not matter, only whether they have it
        want[i, got[0], got[1]] += 1
    assert groups and rows_of(repeats.remove_repeats(docs), "doc_id", "n_words", "n_removed") == want
    edited = repeats.edit_documents(docs)
    assert edited.columns == docs.columns and edited.count() == len(texts) and edited.select("spans").distinct().count() == 1


def test_quality(docs, texts):
    led = quality.ledger(docs).collect()
    want = Counter()
    for i, t in texts:
        w = WORD.findall(t or "")
        at = defaultdict(list)
        for j in range(len(w) - 2):
            at[tuple(w[j : j + 3])].append(j)
        want[i, len(w), len({x for p in at.values() if len(p) > 1 for j in p for x in (j, j + 1, j + 2)})] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in led) == want
    assert quality.reject(docs).columns == docs.columns
