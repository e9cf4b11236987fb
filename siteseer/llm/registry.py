"""The queries of this package and, where SQL can say it, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, jaccard, packing, pieces, quality, repeats, shards, toxicity, urlfilter


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    clf = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    return toxicity.score(docs, clf)


def op2_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    e = pieces.encode(_docs(spark, d), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return e.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


EXTRA_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA_CONVERSATION, "conv_id bigint, turn bigint, role string, text string"))
    out = chat.format_chats(rows)
    back = chat.read_chats(out.select("conv_id", "formatted", "loss", F.char_length("formatted").cast("long").alias("formatted_chars")), keep=("formatted_chars",))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), e AS (
  SELECT *, length(replace(text, '<|', '<||'))
    + CASE WHEN prev IS NULL THEN 8 + length(replace(role, '<|', '<||')) + 8
           WHEN prev <> role THEN 7 + 8 + length(replace(role, '<|', '<||')) + 8
           ELSE 9 END AS chars
  FROM o)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, d), tokenizer_path("word_bpe_49k.json"))


def op5_sharding(spark: SparkSession, d: str) -> DataFrame:
    return shards.shard(_docs(spark, d), 16)


def op6_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.compare_with_edits(_docs(spark, d))


def op7_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join_components(_docs(spark, d), k=4, pct=85)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

RULES = [
    urlfilter.Rule("allow", "org", "/"),
    urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"),
    urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"),
]
#: Parts of a host name that put the host on the list.
LISTED_PARTS = "adult|bets|casino|pills|spam|ads|porn|xxx"
LISTED = f"(^|[.-])({LISTED_PARTS})([.-]|$)"


def op8_url_filters(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    host, _ = urlfilter.host_path(F.col("url"))
    listed = pages.select(host.alias("key")).where(F.col("key").rlike(LISTED)).distinct()
    return urlfilter.filter_urls(pages, RULES, listed).drop("listed")


def _op8_sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    fits = [(f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')", r) for r in ordered]
    rule = " ".join(f"WHEN {c} THEN '{r.name}'" for c, r in fits)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN regexp_matches(host, '{LISTED}') THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = repeats.remove_repeats(_docs(spark, d), k=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS src FROM x GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f USING (g) WHERE src < doc_id),
k AS (SELECT d.doc_id, u.p, u.word FROM d, (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) u WHERE u.doc_id = d.doc_id),
j AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.p = k.p WHERE c.p IS NULL GROUP BY k.doc_id),
m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(m.n, 0) AS n_removed, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN j USING (doc_id)
"""


def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    led = quality.judge(quality.ledger(_docs(spark, d)), "v2").withColumn("kept_v1", quality.passes("v1"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_v1", "failed")


def _op10_sql() -> str:
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(quality.RULES.values()))
    base, v1 = (quality.mask_of(quality.POLICIES[p]) for p in ("base", "v1"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, g FROM x GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x JOIN r USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS BIGINT) AS n_letters,
    CAST(len(list_filter(ls, lambda y: regexp_matches(y, '{quality.BULLET}'))) AS BIGINT) AS n_bullets,
    CAST(len(list_filter(ls, lambda y: regexp_matches(y, '{quality.ELLIPSIS}'))) AS BIGINT) AS n_ellipses,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed, failed = 0 AS kept, failed & {v1} = 0 AS kept_v1, failed FROM f
"""


def queries() -> dict:
    fs = [op1_toxicity, op2_sentencepiece, op3_chat, op4_packing, op5_sharding, op6_fingerprints, op7_jaccard, op8_url_filters, op9_substring_dedup, op10_quality]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": OP3_SQL, "op7_jaccard": OP7_SQL, "op8_url_filters": _op8_sql(), "op9_substring_dedup": OP9_SQL, "op10_quality": _op10_sql()}
