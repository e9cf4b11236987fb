"""Sharding by histogram sort: shards of near equal bytes, found by exact counting.

Rows are ordered by a hash of their text.  For every shard border a bracket of
keys is refined: each round counts the exact bytes below many candidate keys
over all partitions, and keeps the narrowest bracket around the wanted sum,
until a border is within tolerance or its bracket is a single key.  Rows then
move once.

Equal texts stay together: a group of copies heavier than the tolerance is
placed whole before the borders are sought, heaviest first into the emptiest
shard, and the other rows fill what each shard still lacks.  Only a group
heavier than a whole shard's share is dealt out row by row.

Defined cases: a null text weighs one byte and has the checksum of an empty
text; repeated rows are rows; a null ``doc_id`` is allowed; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._dist import lookup_join, stash

#: Borders and unplaced groups may be off by this share of a shard.
TOLERANCE = 0.002
PROBES = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key"))


def find_borders(rows: DataFrame, wanted: list[int], slack: int, key: str = "key", size: str = "size", probes: int = PROBES) -> list[int]:
    """For each wanted sum the key with about so many bytes at or below it."""
    k = len(wanted)
    lo, hi = [LOW - 1] * k, [HIGH] * k  # bytes at or below lo are fewer than wanted, those up to hi are not
    below_lo, below_hi = [0] * k, [None] * k
    done = [False] * k
    for _ in range(64):
        marks = set()
        for j in range(k):
            if not done[j]:
                span = hi[j] - lo[j]
                marks |= {lo[j] + span * i // (probes + 1) for i in range(1, probes + 1)} - {lo[j]}
                marks.add(hi[j])
        if not marks:
            break
        at = sorted(marks)
        sums = dict(zip(at, np.cumsum(_histogram(rows, at, key, size)).tolist()))
        for j in range(k):
            if done[j]:
                continue
            for m in at:
                if lo[j] < m < hi[j] and sums[m] < wanted[j]:
                    lo[j], below_lo[j] = m, sums[m]
            for m in at:
                if lo[j] < m <= hi[j] and sums[m] >= wanted[j]:
                    hi[j], below_hi[j] = m, sums[m]
                    break
            near = below_hi[j] is not None and below_hi[j] - wanted[j] <= slack
            done[j] = near or hi[j] - lo[j] <= 1 or wanted[j] - below_lo[j] <= slack and lo[j] >= LOW
    return [lo[j] if lo[j] >= LOW and (below_hi[j] is None or wanted[j] - below_lo[j] < below_hi[j] - wanted[j]) else hi[j] for j in range(k)]


def _histogram(rows: DataFrame, marks: list[int], key: str, size: str) -> list[int]:
    """Exact bytes in each interval up to a mark (those above the last are left out)."""
    at = np.array(marks, np.int64)

    def count(batches):
        acc = np.zeros(len(at) + 1, np.int64)
        for b in batches:
            i = np.searchsorted(at, b.column(0).to_numpy(), "left")
            np.add.at(acc, i, b.column(1).to_numpy())
        i = np.flatnonzero(acc)
        yield pa.record_batch({"i": i, "b": acc[i]})

    got = rows.select(key, size).mapInArrow(count, "i bigint, b bigint").groupBy("i").agg(F.sum("b").alias("b")).collect()  # a row per mark at most
    out = [0] * (len(marks) + 1)
    for r in got:
        out[r["i"]] = int(r["b"])
    return out[:-1]


def shard(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` under the law ``bytes``."""
    rows = stash(keyed(docs, doc_id, text), "shardkeys")
    stat = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    share = stat["b"] / n_shards
    slack = max(1, int(share * tolerance))
    # no more than n_shards / tolerance groups are this heavy
    heavy = [(r["key"], int(r["b"])) for r in rows.groupBy("key").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).where((F.col("b") > slack) & (F.col("n") > 1)).collect()]
    load, home = [0] * n_shards, {}
    for k, b in sorted(heavy, key=lambda x: (-x[1], x[0])):
        if b <= share:
            s = min(range(n_shards), key=lambda i: (load[i], i))
            home[k], load[s] = s, load[s] + b
    split = {k for k, b in heavy if b > share}
    placed = F.when(F.lit(False), F.lit(0))
    if home:
        table = rows.sparkSession.createDataFrame([(k, s) for k, s in home.items()], "key bigint, home int")
        rows = rows.join(F.broadcast(table), "key", "left")  # at most n_shards / tolerance rows
        placed = F.col("home")
    else:
        rows = rows.withColumn("home", F.lit(None).cast("int"))
    # rows of a group above a share are dealt by their id instead
    place = F.when(F.col("key").isin(*split), F.xxhash64("key", "doc_id")).otherwise(F.col("key")) if split else F.col("key")
    rows = rows.withColumn("place", place)
    free = _fill(load, stat["b"] - sum(load))
    wanted = np.cumsum(free)[:-1].tolist()
    loose = stash(rows.where(F.col("home").isNull()).select("place", "size"), "shardplaces")
    borders = sorted(find_borders(loose, [max(1, round(w)) for w in wanted], slack, key="place")) if stat["n"] else []
    by_place = F.size(F.filter(F.array(*[F.lit(b) for b in borders]).cast("array<bigint>"), lambda b: b < F.col("place")))
    rows = rows.withColumn("shard", F.coalesce(placed, by_place).cast("int"))
    return _slots(rows, n_shards, stat["n"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _fill(load: list[int], rest: int) -> list[float]:
    """How much each shard takes of the rest so that all end up equal, as far as they can."""
    level = (sum(load) + rest) / len(load)
    free = [max(0.0, level - x) for x in load]
    scale = rest / sum(free) if sum(free) else 0
    return [f * scale for f in free]


def _slots(rows: DataFrame, n_shards: int, n: int, per_part: int = 1 << 20) -> DataFrame:
    """Gapless numbers in each shard: places inside hashed parts, plus the counts of the parts before."""
    parts = max(16, -(-n // (n_shards * per_part)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    sums = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("c"))  # n_shards * parts rows
    before = stash(sums.select("shard", "part", F.expr("sum(c) over (partition by shard order by part) - c").alias("base")), "slots")
    rows = rows.withColumn("rn", F.expr("row_number() over (partition by shard, part order by key, doc_id)"))
    rows = lookup_join(rows, before, ["shard", "part"], "left", row_bytes=40)
    return rows.withColumn("slot", (F.coalesce("base", F.lit(0)) + F.col("rn") - 1).cast("long"))
