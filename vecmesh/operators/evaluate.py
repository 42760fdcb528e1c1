"""Measures of search quality and of the state of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that a group is cut into.
RANGES = 4096


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of k true neighbours (query_id, id) that were found."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("__hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("__hit") / F.lit(k)).alias("recall"))


def bucket_summary(sizes: DataFrame, density: float) -> DataFrame:
    """One row (buckets, least, median, most, sparse) of sizes (bucket_id, n); sparse counts n under `density`."""
    total = sizes.agg(F.count("*").alias("buckets"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum((F.col("n") < density).cast("int")).alias("sparse"))
    placed = sizes.withColumn("__rn", F.row_number().over(Window.orderBy("n", "bucket_id")))  # a row a bucket
    return placed.join(F.broadcast(total)).where(F.col("__rn") == F.floor(F.col("buckets") / 2) + 1).select("buckets", "least", F.col("n").alias("median"), "most", "sparse")


def deleted_hits(found: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row (results, deleted, rate) of results (id) against deleted ids."""
    gone = deletes.select("id").distinct().withColumn("__gone", F.lit(1))
    return found.select("id").join(gone, "id", "left").agg(F.count("*").alias("results"), F.count("__gone").alias("deleted")).withColumn("rate", F.when(F.col("results") > 0, F.col("deleted") / F.col("results")).otherwise(F.lit(0.0)))


def percentile_floor(values: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, n, value at place floor(n * p) in order, the last at most); places count from 0.

    Equal values are counted together and ranges of values are counted before any is sorted: the one range that holds
    the place is sorted alone.
    """
    held = values.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    span = held.groupBy(group).agg(F.sum("__c").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    span = span.withColumn("__at", F.least(F.floor(F.col("n") * p), F.col("n") - 1))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v").cast("double") - F.col("__lo")) / (F.col("__hi").cast("double") - F.col("__lo"))).otherwise(F.lit(0.0))
    cells = held.join(span, group).withColumn("__cell", F.floor(width * RANGES).cast("int"))
    sizes = cells.groupBy(group, "__cell").agg(F.sum("__c").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(group).orderBy("__cell")) - F.col("__size")
    sizes = sizes.withColumn("__before", before).join(span.select(group, "__at"), group).where((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__size")))
    inside = cells.join(sizes.select(group, "__cell", "__before"), [group, "__cell"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(group).orderBy("__v"))
    found = inside.withColumn("__upto", upto).where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__c") <= F.col("__at")))
    return found.select(group, "n", F.col("__v").alias("value"))


def coverage(ids: DataFrame, mapping: DataFrame, share: float = 1.0, seed: int = 0) -> DataFrame:
    """One row (sampled, covered, rate): how many of a sample of ids (id) a map (id, ...) knows."""
    asked = ids.select("id") if share >= 1 else ids.select("id").sample(share, seed)
    known = mapping.select("id").distinct().withColumn("__known", F.lit(1))
    return asked.join(known, "id", "left").agg(F.count("*").alias("sampled"), F.count("__known").alias("covered")).withColumn("rate", F.when(F.col("sampled") > 0, F.col("covered") / F.col("sampled")).otherwise(F.lit(0.0)))
