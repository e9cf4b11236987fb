"""URL filters: path rules first, then an exact Bloom filter cascade over hosts.

Level 0 encodes the listed keys; each later level encodes the keys of the
other side that the level before lets through by mistake.  As the cascade is
built over the complete key universe of the corpus, it ends with no mistakes,
and membership of any key of that universe is exact without a join.  All of it
is SQL functions: bits are set with ``bit_or`` and tested inside one projection.

Filters travel with the plan, so one cascade holds at most ``MAX_BITS``.  Keys
are dealt into parts by hash, as many as the lists need, and each part has its
own cascade.  Rows are written once by part, and every part is judged by its
cascade alone; with one part nothing needs to be written.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed; repeated rows are judged one by one; an empty
table or list gives an empty cascade that lists nothing; other columns are
ignored.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ._dist import discard, power_of_two, shared_dir, stash

#: Bits that one cascade may take; a list that needs more is dealt into more parts.
MAX_BITS = 1 << 24
HASHES = 4
BITS_PER_KEY = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    words: tuple[int, ...]


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(level), F.lit(j)).bitwiseAND(F.lit(bits - 1)) for j in range(HASHES)]


def _holds(key: Column, level: int, lev: Level) -> Column:
    words = F.from_json(F.lit(json.dumps(lev.words)), "array<bigint>")
    out = F.lit(True)
    for p in _positions(key, level, lev.bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _level(keys: DataFrame, level: int, n: int) -> Level:
    bits = 64
    while bits < BITS_PER_KEY * n:
        bits *= 2
    pos = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    # at most bits / 64 rows come back, and bits is bounded by MAX_BITS
    rows = pos.groupBy(F.shiftright("p", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("b")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["i"]] = r["b"]
    return Level(bits, tuple(words))


def universe(corpus_keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Every key once with ``listed``; both inputs have a column ``key``."""
    both = corpus_keys.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    return stash(both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")), "urlkeys")


def build_cascade(keys: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels over a universe; None when the filters would exceed ``max_bits``."""
    levels: list[Level] = []
    left, side, spent = keys, True, 0
    while True:
        own = left.where(F.col("listed") == side)
        n = own.count()
        if n == 0:
            return levels
        spent += max(64, 2 * BITS_PER_KEY * n)
        if spent > max_bits and n > 1:
            return None
        i = len(levels)
        levels.append(_level(own, i, n))
        left = left.where((F.col("listed") == side) | _holds(F.col("key"), i, levels[i]))
        side = not side


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts)).cast("int")


def build_parts(keys: DataFrame, max_bits: int = MAX_BITS) -> list[list[Level]]:
    """A cascade per part of the keys: as many parts as the list asks for, and twice as many until each cascade is small enough."""
    parts = power_of_two(2.5 * BITS_PER_KEY * keys.where("listed").count() / max_bits)
    while True:
        out = []
        for i in range(parts):
            levels = build_cascade(keys.where(part_of(F.col("key"), parts) == i), max_bits)
            if levels is None:
                break
            out.append(levels)
        else:
            return out
        parts *= 2


def contains(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    if not levels:
        return F.lit(False)
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(_holds(key, i, levels[i]), out).otherwise(F.lit(i % 2 == 1))
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, page_id: str = "page_id", url: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` for every row."""
    host, path = host_path(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    keys = universe(p.select(F.col("host").alias("key")), listed)
    cascades = build_parts(keys, max_bits)
    discard(keys)
    if len(cascades) == 1:
        p = p.withColumn("is_listed", contains(F.col("host"), cascades[0]))
    else:
        p = _judge_parts(p, cascades)
    p = p.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return p.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), F.col("is_listed").alias("listed"))


def _judge_parts(p: DataFrame, cascades: list[list[Level]]) -> DataFrame:
    """Adds ``is_listed`` part by part, each in a job that carries one cascade only."""
    spark, n = p.sparkSession, len(cascades)
    where = f"{shared_dir(spark)}/siteseer-urlparts-{uuid.uuid4().hex}"
    # no exchange: a task writes a file for each part it has rows of, so a hot host stays spread
    p.withColumn("part", part_of(F.col("host"), n)).write.partitionBy("part").parquet(where)
    rows = spark.read.schema(StructType([*p.schema.fields, StructField("part", IntegerType())])).parquet(where)
    out = None
    for i, levels in enumerate(cascades):
        own = stash(rows.where(F.col("part") == i).drop("part").withColumn("is_listed", contains(F.col("host"), levels)), "urlpart")
        out = own if out is None else out.unionByName(own)
    rows._siteseer_path = where
    discard(rows)
    return out
