"""Quality rules: a bitmask ledger over whole texts, built from SQL functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; policies (versioned sets of rule names) and
ablations are bitwise operations over the stored bits, so a new policy never
reads a text again.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are judged one by one; a null ``doc_id`` is kept as it is; an
empty table gives an empty ledger; columns other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._dist import words_column

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_letters", "n_bullets", "n_ellipses")

#: Rule name -> failure condition over the measures; the position is the bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "exclaims": "100 * n_exclaims > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars > 20 * n_words OR word_chars < 2 * n_words",
    "letters": "100 * n_letters < 50 * word_chars",
    "bullets": "100 * n_bullets > 90 * n_lines",
    "ellipses": "100 * n_ellipses > 30 * n_lines",
}

#: Policy version -> the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "exclaims", "duplicate_lines", "word_length"),
    "v2": tuple(RULES),
}

#: Lines that begin with a bullet, and lines that end in an ellipsis.
BULLET = "^[\\x20\\x09-\\x0D]*[-*\u2022\u2023\u25e6]"
ELLIPSIS = "([.][.][.]|\u2026)[\\x20\\x09-\\x0D]*$"

#: Bits of a packed window key that hold its place; longer texts compare all windows exactly.
PLACE_BITS = 20


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``(doc_id, <measures>, failed)``; with ``carry`` the row as struct ``row`` too."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    names = ["row"] if carry else []
    # each step is its own projection: an array that several measures use is built once
    s = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"), *kept)
    s = s.select("doc_id", "t", *names, words_column(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("ls"))
    bare = reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), "#*$%&|<>", F.col("t"))
    s = s.select(
        "doc_id", *names, "w",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        (F.char_length("t") - F.char_length(bare)).cast("long").alias("n_symbols"),
        (F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.char_length(F.regexp_replace("t", "\\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.filter("ls", lambda x: x.rlike(BULLET))).cast("long").alias("n_bullets"),
        F.size(F.filter("ls", lambda x: x.rlike(ELLIPSIS))).cast("long").alias("n_ellipses"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        _window_keys(F.col("w")).alias("keys"),
    )
    rest = [m for m in MEASURES if m != "n_repeat_words"]
    s = s.select("doc_id", *names, "w", *rest, F.sort_array("keys").alias("keys"))
    s = s.select("doc_id", *names, "w", *rest, _candidates().alias("cand"))
    s = s.select("doc_id", *names, *rest, F.sort_array(F.transform("cand", lambda p: F.struct(_window("w", p).alias("s"), p.alias("p")))).alias("cand"))
    s = s.select("doc_id", *names, *rest, _covered().alias("n_repeat_words"))
    failed = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(RULES.values())])
    # a fence: the row number keeps the optimizer from pushing a filter on the bits, and a copy of every measure, below the ledger
    return s.select("doc_id", *MEASURES, F.when(F.monotonically_increasing_id() >= 0, failed.cast("long")).alias("failed"), *names)


def _window(w: str, p: Column) -> Column:
    return F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2))


def _window_keys(w: Column) -> Column:
    """A sortable long per three-word window: high hash bits, low place bits."""
    place = F.sequence(F.lit(0), F.size(w) - 3)
    key = lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), PLACE_BITS).bitwiseOR(i.cast("long"))
    return F.when(F.size(w) >= 3, F.transform(place, key)).otherwise(F.array().cast("array<bigint>"))


def _candidates() -> Column:
    """Places whose hash occurs again: all true repeats, and hardly any other."""
    hi = lambda x: F.shiftright(x, PLACE_BITS)
    near = lambda x, i: (hi(x) == hi(F.get("keys", i - 1))) | (hi(x) == hi(F.get("keys", i + 1)))
    hit = F.transform(F.filter("keys", lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))
    return F.when(F.size("keys") < (1 << PLACE_BITS), hit).otherwise(F.sequence(F.lit(0), F.size("keys") - 1))


def _covered() -> Column:
    """Words in windows that truly repeat: sorted neighbours with equal words."""
    same = lambda x, i: F.coalesce(x["s"] == F.get("cand", i - 1)["s"], F.lit(False)) | F.coalesce(x["s"] == F.get("cand", i + 1)["s"], F.lit(False))
    places = F.transform(F.filter("cand", same), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))
    return F.size(F.array_distinct(F.flatten(places))).cast("long")


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy, from its bits alone; ``base`` rules are part of every policy."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES["base"]) | mask_of(POLICIES[policy]))) == 0


def judge(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``base_failed`` and ``kept`` under a policy."""
    return led.withColumn("base_failed", ~passes("base")).withColumn("kept", passes(policy))


def ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it fails."""
    want = mask_of(POLICIES[policy])
    bits = F.col("failed").bitwiseAND(F.lit(want))
    aggs = []
    for r in POLICIES[policy]:
        m = F.lit(mask_of([r]))
        aggs += [F.count_if(bits.bitwiseAND(m) != 0).alias(f"{r}_a"), F.count_if(bits == m).alias(f"{r}_o")]
    wide = led.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_a").alias("n_failed"), F.col(f"{r}_o").alias("n_only")) for r in POLICIES[policy]])
    return wide.select(F.inline(rows))


def reject(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents a policy keeps, with all their columns."""
    return judge(ledger(docs, carry=True), policy).where("kept").select("row.*")
