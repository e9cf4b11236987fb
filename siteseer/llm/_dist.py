"""Shared distributed helpers: written intermediates, size-checked lookups, skew, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup side is broadcast only up to this many measured bytes; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: A join key with more rows than this, and than one in ``HOT_SHARE`` of all rows, is hot.
HOT_ROWS = 64
HOT_SHARE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, else the warehouse; in local mode a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if spark.sparkContext.master.startswith("local"):
            where = "file://" + tempfile.mkdtemp(prefix="siteseer-")
        else:
            where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/siteseer-scratch"
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Rows of one Arrow batch: whole texts travel, so batches are kept small.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the memory of tasks that hand whole texts to Python; returns ``df``.

    Spark reads the limit from the session when a plan runs, so it is set there; a lower one stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


#: Rows of one batch of the Parquet reader: it holds whole texts on the heap, in arrays that double as they grow.
READ_ROWS = 256


def small_reads(df: DataFrame) -> DataFrame:
    """Bounds the memory of tasks that read whole texts; returns ``df``.  As with ``small_batches``, a lower limit stays."""
    conf, key = df.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    if int(conf.get(key)) > READ_ROWS:
        conf.set(key, READ_ROWS)
    return df


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteseer-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siteseer_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for t in tables:
        path = getattr(t, "_siteseer_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", row_bytes: int | Column = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is broadcast only if its measured size is within ``limit``.

    ``small`` should be a written table, as it is measured first; rows that
    differ in size give ``row_bytes`` as a column.
    """
    width = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    size = small.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("b")).first()["b"]
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def skew_join(big: DataFrame, small: DataFrame, on: list[str], payload: list[str], hot: DataFrame, kind: str) -> DataFrame:
    """Inner equi-join of ``big`` with ``small`` (a row per key) that never shuffles a hot key.

    ``hot`` holds the hot keys, as ``hot_keys`` gives them: few enough, by
    their definition, to travel to every task together with their payload.
    """
    known = stash(small.join(F.broadcast(hot), on, "left_semi").select(*on, *[F.col(c).alias(f"hot_{c}") for c in payload], F.lit(True).alias("is_hot")), kind)
    marked = big.join(F.broadcast(known), on, "left")
    there = marked.where("is_hot").select(*big.columns, *[F.col(f"hot_{c}").alias(c) for c in payload])
    rest = marked.where(F.col("is_hot").isNull()).select(*big.columns)
    return there.unionByName(rest.join(small.select(*on, *payload), on).select(*big.columns, *payload))


def hot_keys(big: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Keys of ``big`` with so many rows that one task should not take them; at most ``HOT_SHARE`` of them.

    Counts combine before the shuffle.
    """
    least = max(HOT_ROWS, rows // HOT_SHARE)
    return big.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > least).select(*on)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column (one small aggregate)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def power_of_two(x: float, least: int = 1) -> int:
    """The first power of two times ``least`` that reaches ``x``; it follows the input without a cap."""
    n = least
    while n < x:
        n *= 2
    return n


#: Buckets up to which their number follows the input in proportion.
MANY = 1 << 16


def bucket_count(size: float, bucket_bytes: int, least: int) -> int:
    """Buckets of about ``bucket_bytes``.

    Beyond ``MANY`` buckets the number and the size of buckets both grow, with
    the root of the input, as a task sends a row to nearly every bucket: 16
    times the buckets and 16 times their size at 256 times the input.
    """
    n = size / bucket_bytes
    return power_of_two(n if n <= MANY else MANY * (n / MANY) ** 0.5, least)


#: Edges that one task solves at once, some 24 MB of them; more are contracted in rounds until so few are left.
SMALL_GRAPH = 1 << 20


def least_of_component(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph in memory, and the least node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        far = x != y
        if not far.any():
            return nodes, nodes[root]
        x, y = x[far], y[far]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _solved(edges: DataFrame) -> DataFrame:
    def run(batches):
        cols = [[], [], []]
        for b in batches:
            for c, x in zip(cols, b.columns):
                c.append(x.to_numpy())
        if not cols[0]:
            return
        part, u, v = map(np.concatenate, cols)
        for p in np.unique(part):
            nodes, least = least_of_component(u[part == p], v[part == p])
            yield pa.record_batch({"part": np.full(len(nodes), p, np.int32), "node": nodes, "component": least})

    return edges.select("part", "u", "v").coalesce(1).mapInArrow(run, "part int, node bigint, component bigint")


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, as ``(part, node, component)``.

    ``edges`` has ``part`` (graphs that are solved side by side), ``a`` and
    ``b``.  Alternating large-star and small-star contraction: every round
    hangs neighbours on the least node of a neighbourhood, so the number of
    rounds grows with the logarithm of the graph's width.  Minima are combined
    before the shuffle; a hub's minimum travels to the hub's edges, which are
    never brought together.  A graph of up to ``SMALL_GRAPH`` edges is solved by
    one task.  Nodes without an edge do not appear; loops are
    ignored; an empty graph gives no rows.
    """
    cur = stash(_toward_min(edges.where(F.col("a") != F.col("b"))), name)
    before = (cur.count(), None)
    for _ in range(max_rounds):
        if before[0] <= SMALL_GRAPH:
            out = stash(_solved(cur), name)
            discard(cur)
            return out
        large = stash(_large_star(cur, 2 * before[0]), name)
        new = stash(_small_star(large, before[0]), name)
        discard(cur, large)
        cur = new
        state = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("part", "u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (state["n"], state["h"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select("part", F.col("v").alias("node")).distinct()
    return cur.select("part", F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _toward_min(edges: DataFrame) -> DataFrame:
    return edges.select("part", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``rows``, about ``n``, with ``m``, the minimum of their ``(part, u)``; hubs by broadcast, the others by a shuffle."""
    most = max(HOT_ROWS, n // HOT_SHARE)  # so about HOT_SHARE hubs at most
    hubs = least.where(F.col("c") > most).select("part", "u", F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), ["part", "u"], "left")
    there = marked.where(F.col("hub_m").isNotNull()).select("part", "u", "v", F.col("hub_m").alias("m"))
    rest = marked.where(F.col("hub_m").isNull()).select("part", "u", "v")
    return there.unionByName(rest.join(least.where(F.col("c") <= most).select("part", "u", "m"), ["part", "u"]).select("part", "u", "v", "m"))


def _large_star(cur: DataFrame, n: int) -> DataFrame:
    both = cur.unionByName(cur.select("part", F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("part", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c"))
    j = _with_least(both.where(F.col("v") > F.col("u")), least, n)
    return j.where(F.col("v") != F.col("m")).select("part", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(cur: DataFrame, n: int) -> DataFrame:
    least = cur.groupBy("part", "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    j = _with_least(cur, least, n)
    hang = j.where(F.col("v") != F.col("m")).select("part", F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.unionByName(least.select("part", "u", F.col("m").alias("v"))).distinct()


def words_column(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
