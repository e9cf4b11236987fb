"""Toxicity by weak supervision.

Labelled rows show which words and word stems occur far more often in toxic
texts than chance allows; those that share a stem form a lexicon voter.
Patterns over the text (masked and stretched words, shouting, runs of marks,
words set beside each other with a lexicon word) are voters of their own, and
so is the density of lexicon words.  A voter votes toxic, clean or abstains.

A generative label model (two classes, each voter with its own probabilities
of the three votes in each class) is fitted by expectation-maximisation, and
estimates the accuracies of all voters, the label's own among them, which is
one more, noisy voter that starts at ``LABEL_TRUST``.  What voters share
beyond the class is measured as residual correlation, and every round lowers
the weight of correlated voters, so that a group of them counts about once.
A logistic regression on word, stem, pattern and density features is trained
on the posteriors and scores every whole text.

Only ``max_rows`` labelled rows are used for fitting, those with the least
hash of their id; rows that are held out never take part.  The size of the
model is a parameter too: the ``max_features`` words and stems with the most
evidence are features, and each of their stems is a voter.  Scoring reads
every text in full.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; of several labels of one id the largest counts; ids without a text
or label do not take part in the fit; without usable labels nothing is known,
and every score is the least one, below one in a million; repeated rows are
scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import discard, small_batches, stash
from ._text import release

#: Labelled rows used for fitting, at most.
MAX_ROWS = 20_000
#: Size of the model: words and stems with the strongest evidence.
MAX_FEATURES = 400
STEMS = (4, 5)
#: How far the label is trusted at first, and how far at most.
LABEL_TRUST = 0.9
MOST_TRUST = 0.98
WORDS = re.compile(r"[^\W\d_]+")
#: Patterns over a whole text, each a voter and a feature; the fit finds out what they are worth.
PATTERNS = {
    "masked": re.compile(r"[^\W\d_][*@#$%]+[^\W\d_]"),
    "stretched": re.compile(r"([^\W\d_])\1{3}"),
    "marks": re.compile(r"[!?]{2}"),
    "shouting": re.compile(r"\b[A-Z]{4,}\b"),
}
#: Features after the lexicon's: patterns, a pair of lexicon words side by side, any, two or more, share of words, intercept.
EXTRA = len(PATTERNS) + 5


def held_out(doc_id):
    """Rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def text_features(text: str) -> set[str]:
    """Distinct lower-case words, and the beginnings of the longer ones."""
    ws = set(WORDS.findall(text.lower()))
    out = {f"w:{w}" for w in ws}
    for n in STEMS:
        out |= {f"s:{w[:n]}" for w in ws if len(w) > n}
    return out


@dataclass(frozen=True)
class Found:
    """What a text shows: its features, patterns, side-by-side lexicon words, distinct words with a feature, distinct words."""

    features: list[int]
    patterns: list[int]
    beside: bool
    hits: int
    words: int


@dataclass(frozen=True)
class Classifier:
    features: dict[str, int]
    weights: np.ndarray  # one per feature, then EXTRA more

    def look(self, text: str) -> Found:
        ws = WORDS.findall(text.lower())
        get, of, out = self.features.get, {}, set()
        for w in set(ws):
            own = [get("w:" + w)] + [get("s:" + w[:n]) for n in STEMS if len(w) > n]
            own = [i for i in own if i is not None]
            if own:
                of[w] = own
                out.update(own)
        beside = False
        if len(of) > 0:
            beside = any(a in of and b in of for a, b in zip(ws, ws[1:]))
        patterns = [i for i, p in enumerate(PATTERNS.values()) if p.search(text)]
        return Found(sorted(out), patterns, beside, len(of), len(set(ws)))

    def score(self, text: str) -> float:
        f, k = self.look(text), len(self.features)
        x = self.weights[-1] + self.weights[k : k + len(PATTERNS)][f.patterns].sum()
        if f.features:
            extra = self.weights[k + len(PATTERNS) :]
            x += self.weights[f.features].sum() + extra[0] * f.beside + extra[1] + extra[2] * (f.hits > 1) + extra[3] * min(1.0, 10 * f.hits / max(f.words, 10))
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, toxic, text)`` of the bounded sample."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def lexicon(rows: DataFrame, max_features: int = MAX_FEATURES) -> tuple[list[str], int]:
    """Words and stems with significantly many toxic texts, and the number of texts."""

    def run(batches):
        for b in batches:
            f, t = [], []
            for tox, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = text_features(text or "")
                f += own
                t += [tox] * len(own)
            yield pa.record_batch({"f": pa.array(f, pa.string()), "t": pa.array(t, pa.int32())})

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, pos = int(total["n"]), int(total["t"])
    if not 0 < pos < n:
        return [], n
    rate = pos / n
    c = rows.select("doc_id", "toxic", "text").mapInArrow(run, "f string, t int").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    # evidence: the binomial divergence of the toxic share from the base rate
    share = F.col("t") / F.col("n")
    rest = F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - rate))).otherwise(F.lit(0.0))
    c = c.where((share > rate) & (F.col("t") > 2)).withColumn("e", F.col("t") * F.log(share / rate) + rest)
    c = c.where((F.col("e") > math.log(50_000)) & (share > 0.5))
    return sorted(r["f"] for r in c.orderBy(F.col("e").desc(), "f").limit(max_features).select("f").collect()), n


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, accuracies and correlations of voters.

    ``votes`` holds 1 (toxic), 0 (clean) and -1 (abstains); ``gold`` is one
    more voter, whose accuracy is estimated like the others' and kept between
    a half and ``MOST_TRUST``.
    """
    v = np.column_stack([votes, gold]).astype(np.int8)
    n, m = v.shape
    on = lambda c: (v == c).astype(np.float32)  # noqa: E731  of one kind of vote at a time
    right = LABEL_TRUST
    post = np.where(gold == 1, LABEL_TRUST, 1 - LABEL_TRUST)
    weight = np.ones(m)
    for _ in range(rounds):
        counts = np.stack([np.stack([post, 1 - post]).astype(np.float32) @ on(c) for c in (-1, 0, 1)]).astype(float)  # kind, class, voter
        p1 = (counts[:, 0] + 0.1) / (post.sum() + 0.3)
        p0 = (counts[:, 1] + 0.1) / ((1 - post).sum() + 0.3)
        # what voters share beyond the class: residual correlations lower their weights
        fit = on(1)
        fit -= post[:, None].astype(np.float32) * (p1[2] - p0[2]).astype(np.float32)
        fit -= p0[2].astype(np.float32)
        sd = fit.std(0).astype(float) + 1e-9
        corr = (fit.T @ fit) / n / np.outer(sd, sd)
        del fit
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + np.clip(corr, 0, 1).sum(1))
        llr = np.log(p1) - np.log(p0)
        prior = np.log((post.mean() + 1e-6) / (1 - post.mean() + 1e-6))
        trust = np.log(right / (1 - right))
        told = llr * weight
        told[:, -1] = 0  # the label's own vote counts by its trust
        odds = prior + sum(on(c) @ told[c + 1].astype(np.float32) for c in (-1, 0, 1)) + np.where(gold == 1, trust, -trust)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        right = float(np.clip(np.where(gold == 1, post, 1 - post).mean(), 0.5, MOST_TRUST))
        if moved < 1e-4:
            break
    return post, np.stack([p0, p1]), corr


def _design(found: list[Found], k: int) -> np.ndarray:
    x = np.zeros((len(found), k + EXTRA))
    for i, f in enumerate(found):
        x[i, f.features] = 1
        x[i, [k + p for p in f.patterns]] = 1
        x[i, -5:] = f.beside, f.hits > 0, f.hits > 1, min(1.0, 10 * f.hits / max(f.words, 10)), 1
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Newton steps on soft labels; the intercept is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = np.diag(shrink)
        for i in range(0, len(x), 2000):  # in blocks: no second copy of the design
            part = x[i : i + 2000]
            bend += (part * (p * (1 - p))[i : i + 2000, None]).T @ part
        step = np.linalg.solve(bend, x.T @ (p - y) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES) -> Classifier:
    rows = stash(training_rows(docs, labels, max_rows), "toxfit")
    names, _ = lexicon(rows, max_features)
    index = {f: i for i, f in enumerate(names)}
    if not names:
        return Classifier({}, np.array([0.0] * (EXTRA - 1) + [-30.0]))
    blank = Classifier(index, np.zeros(len(index) + EXTRA))

    def run(batches):
        for b in batches:
            got = [blank.look(t or "") for t in b.column(2).to_pylist()]
            yield pa.record_batch({
                "toxic": b.column(1), "features": pa.array([f.features for f in got], pa.list_(pa.int32())), "patterns": pa.array([f.patterns for f in got], pa.list_(pa.int32())),
                "beside": pa.array([f.beside for f in got]), "hits": pa.array([f.hits for f in got], pa.int64()), "words": pa.array([f.words for f in got], pa.int64()),
            })

    # max_rows rows of a few numbers each
    got = rows.select("doc_id", "toxic", "text").mapInArrow(run, "toxic int, features array<int>, patterns array<int>, beside boolean, hits bigint, words bigint").collect()
    discard(rows)
    found, gold = [Found(list(r["features"]), list(r["patterns"]), r["beside"], r["hits"], r["words"]) for r in got], np.array([r["toxic"] for r in got])
    x = _design(found, len(index))
    post, _, _ = label_model(np.column_stack(voters(x, index, np.array([f.words for f in found]))), gold)
    del found
    return Classifier(index, logistic(x, post))


def voters(x: np.ndarray, index: dict[str, int], words: np.ndarray) -> list[np.ndarray]:
    """Votes of the lexicon's stems, of the patterns, and of the density of lexicon words, from the design of the sample."""
    stems: dict[str, list[int]] = {}
    for f, i in index.items():
        stems.setdefault(f[2 : 2 + STEMS[0]], []).append(i)
    out = [np.where(x[:, g].any(1), 1, -1).astype(np.int8) for g in stems.values()]
    out += [np.where(x[:, len(index) + p] > 0, 1, -1) for p in range(len(PATTERNS))]
    beside, some, several, share = x[:, -5] > 0, x[:, -4] > 0, x[:, -3] > 0, x[:, -2]
    out += [np.where(beside, 1, -1), np.where(several, 1, -1), np.where(share > 0.1, 1, -1)]
    return out + [np.where(~some, 0, -1), np.where(~some & (words > 100), 0, -1)]


def score(docs: DataFrame, clf: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "score": np.array([clf.score(t or "") for t in b.column(1).to_pylist()], float)})

    s = small_batches(docs).select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")
    return s.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, clf: Classifier) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    fields = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([clf.score(t or "") < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))
        release()

    return small_batches(docs).mapInArrow(run, fields)
