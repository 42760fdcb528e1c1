"""The operation log: which of its entries are committed, and the table they amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def committed(ops: DataFrame, log: str = "log_id") -> DataFrame:
    """The INSERT and DELETE entries of ops (log, seq, kind, tx_id, ...[, crc_ok]) that are committed.

    A log ends at its first bad checksum. An entry outside a transaction is committed at once; one inside is if the
    transaction's own COMMIT comes before another BEGIN. A COMMIT counts if it is the first of its id since the
    latest BEGIN and has that id; others are ignored. Each log is one sequence, so it is one window partition:
    a log segment is rotated at a bounded size.
    """
    order = Window.partitionBy(log).orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    rows = ops
    if "crc_ok" in ops.columns:
        bad = F.sum(F.when(F.col("crc_ok"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__bad", bad).where("__bad = 0").drop("__bad")
    begin = F.col("kind") == "BEGIN"
    rows = rows.withColumn("__b", F.last(F.when(begin, F.struct("seq", "tx_id")), ignorenulls=True).over(before))
    match = (F.col("kind") == "COMMIT") & (F.col("tx_id") == F.col("__b.tx_id"))
    # The first matching COMMIT since that BEGIN: no other one after it.
    rows = rows.withColumn("__m", match).withColumn("__lm", F.last(F.when(F.col("__m"), F.col("seq")), ignorenulls=True).over(before))
    rows = rows.withColumn("__m", F.col("__m") & (F.col("__lm").isNull() | (F.col("__lm") < F.col("__b.seq"))))
    state = F.when(begin, F.lit("B")).when(F.col("__m"), F.lit("C"))
    rows = rows.withColumn("__s", state)
    rows = rows.withColumn("__p", F.last("__s", ignorenulls=True).over(before)).withColumn("__n", F.first("__s", ignorenulls=True).over(after))
    kept = rows.where(F.col("kind").isin("INSERT", "DELETE") & ((F.coalesce("__p", F.lit("C")) != "B") | (F.col("__n") == "C")))
    return kept.drop("__b", "__m", "__lm", "__s", "__p", "__n")


def replay(entries: DataFrame) -> DataFrame:
    """The live rows (id, seq, embedding) after entries (seq, kind, id, embedding): the highest seq of an id decides."""
    top = entries.groupBy("id").agg(F.max_by(F.struct("kind", "embedding"), "seq").alias("__top"), F.max("seq").alias("seq"))
    return top.where(F.col("__top.kind") == "INSERT").select("id", "seq", F.col("__top.embedding").alias("embedding"))


def as_of(entries: DataFrame, seq: int) -> DataFrame:
    """replay() of what had happened by `seq`."""
    return replay(entries.where(F.col("seq") <= seq))


def with_checksum(ops: DataFrame) -> DataFrame:
    """ops with crc, the checksum of each entry's frame text."""
    frame = F.concat_ws("|", "seq", "kind", F.coalesce(F.col("tx_id").cast("string"), F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce(F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("")))
    return ops.withColumn("crc", F.crc32(frame))
