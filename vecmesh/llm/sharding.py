"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard name) pair has a pseudo-random score and the shard with the highest score holds the row, so the
key and the shards alone decide. A further shard only takes rows into itself: no score of the others changes. All
expressions run inside the JVM; the only exchange carries row numbers, not texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def _score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u) with u uniform in (0, 1) from a hash of key and shard: the weighted rendezvous score."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard-{shard}")), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.lit(-float(weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int, from 0) of a key. Shards of weight 0 hold nothing; a null key counts as one more key."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative and one must be positive")
    ranked = [F.struct(_score(key, i, w).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (-F.array_max(F.array(*ranked))["i"]).cast("int")


def place(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot[, grown_shard]) for all rows of docs, its other columns left out.

    size is the text's UTF-8 bytes plus 1 (null text: as empty). slot numbers a shard's rows without gaps from 0.
    Repeated rows each get a slot; rows of one key share a shard, as the key decides; an empty table gives no rows.

    Slots need no shard in one task: rows are numbered within the (shard, input split) they were read in, bounded
    by the split's size, and one count for each of these pairs gives where its numbers begin.
    """
    kept = [F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32")]
    kept += [shard_of(F.col(key), weights).alias("shard"), *([shard_of(F.col(key), grown).alias("grown_shard")] if grown else []), F.monotonically_increasing_id().alias("__row")]
    rows = stored(docs.select(*kept), "shards").withColumn("__split", F.shiftright("__row", 33))
    counts = rows.groupBy("shard", "__split").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(_window("shard", "__split")) - F.col("__n")
    starts = counts.select("shard", "__split", before.alias("__start"))
    local = F.row_number().over(_window(["shard", "__split"], "__row")) - 1
    return rows.withColumn("__local", local).join(starts, ["shard", "__split"]).withColumn("slot", F.col("__start") + F.col("__local")).drop("__row", "__split", "__start", "__local")


def _window(by, order):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(order)
