"""Search of sequences as they arrive.

Site extraction and the near-match join keep no state, so a stream of contigs
is searched with the operators of a batch; a watermark is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import search
from ..operators.sites import extract_sites
from ..sources.inputs import Budget, Guide, Pam


def arriving_contigs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files with ``contig`` and ``sequence``."""
    return spark.readStream.schema("contig string, sequence string").parquet(path)


def search_stream(contigs: DataFrame, guides: list[Guide], pam: Pam, budget: Budget, bmax: int = 0) -> DataFrame:
    return search(extract_sites(contigs, pam, bmax), guides, pam, budget, bmax)


def write_hits(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Searches what is there, exactly once per file, and stops."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
