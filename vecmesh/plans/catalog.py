"""The engine's queries over the driver's tables, each with the SQL that gives the same rows.

`embeddings` plays the collection: label is the bucket, per-label means are centroids. All rows whose vec_id is
divisible by 100 ask, over all rows. Float results are rounded in both forms.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli
from ..functions import metrics, sq8
from ..functions.arrow import matrix
from ..operators import caches, cluster, evaluate, maintain, oplog, routing, search
from ..schema import bad
from ..sources.collection import Collection, Engine
from ..sources import generators
from ..sources.files import Files, shared_dir
from ..streaming.ingest import ingest

K, TARGET, DECAY, DENSITY = 10, 0.5, 5.0, 100.0
CAPACITY = 52


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("bucket_id"), "embedding")


def _queries(rows: DataFrame) -> DataFrame:
    return rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


def _dim(rows: DataFrame) -> int:
    return rows.select(F.size("embedding").alias("n")).first()["n"]


def _out(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


# --- SQL building blocks -------------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id AS id, label AS bucket_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"
_C = """, cm AS (SELECT bucket_id, pos, avg(x) AS m, count(*) AS n FROM (SELECT bucket_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY bucket_id, pos),
c AS (SELECT bucket_id, list(m ORDER BY pos) AS ce, max(n) AS n FROM cm GROUP BY bucket_id)"""


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _cos(a: str, b: str) -> str:
    return f"(1.0 - greatest(-1.0, least(1.0, list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))))))"


def _top(scored: str, k: int = K) -> str:
    """Ranks of a relation (query_id, id, s) whose s is rounded to 9 places."""
    return f"SELECT query_id, rank, id, round(s, 6) AS score FROM (SELECT query_id, id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, id) AS INTEGER) AS rank FROM ({scored})) WHERE rank <= {k}"


_SEL = f""", sd AS (SELECT query_id, bucket_id, n, round(sqrt(round({_l2('qe', 'ce')}, 9)), 9) AS dist FROM q, c),
ss AS (SELECT *, exp(-{DECAY} * dist) * (1 - exp(-n / {DENSITY})) AS sc FROM sd),
sr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, bucket_id) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, bucket_id) AS INTEGER) AS near, sum(sc) OVER (PARTITION BY query_id) AS total,
  coalesce(sum(sc) OVER (PARTITION BY query_id ORDER BY sc DESC, bucket_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM ss),
sel AS (SELECT query_id, bucket_id, place, near, CASE WHEN total > 1e-9 THEN sc / total ELSE 0 END AS share FROM sr
  WHERE prior / greatest(total, 1e-9) < {TARGET} OR place = 1 OR near <= 3 OR total <= 1e-9)"""
_SQ = """, f AS (SELECT id, bucket_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v),
fr AS (SELECT bucket_id, pos, x, row_number() OVER (PARTITION BY bucket_id, pos ORDER BY x) AS rn, count(*) OVER (PARTITION BY bucket_id, pos) AS n FROM f),
sq AS (SELECT bucket_id, pos, max(CASE WHEN rn = CASE WHEN n >= 100 THEN n // 100 ELSE 0 END + 1 THEN x END) AS low,
  max(CASE WHEN rn = n - CASE WHEN n >= 100 THEN n // 100 ELSE 0 END THEN x END) AS high FROM fr GROUP BY bucket_id, pos),
st AS (SELECT bucket_id, pos, low, high, CASE WHEN abs(high - low) < 1e-6 THEN 1.0 ELSE (high - low) / 255.0 END AS step FROM sq),
ec AS (SELECT f.id, f.bucket_id, f.pos, f.x, low, step, CAST(greatest(0, least(255, round((f.x - low) / step))) AS INTEGER) AS code FROM f JOIN st USING (bucket_id, pos)),
rc AS (SELECT id, bucket_id, list(low + code * step ORDER BY pos) AS re FROM ec GROUP BY id, bucket_id)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- Search --------------------------------------------------------------------------------------------------------


@query(f"WITH {_V} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, v"))
def exact_knn_l2(spark, d):
    rows = _rows(spark, d)
    return _out(search.knn(rows, _queries(rows), K, _dim(rows)))


@query(f"WITH {_V} " + _top(f"SELECT query_id, id, round({_cos('qe', 'e')}, 9) AS s FROM q, v"))
def exact_knn_cosine(spark, d):
    rows = _rows(spark, d)
    return _out(search.knn(rows, _queries(rows), K, _dim(rows), "COSINE"))


@query(f"WITH {_V} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, v WHERE id % 7 <> 0"))
def knn_with_tombstones(spark, d):
    rows = _rows(spark, d)
    return _out(search.knn(search.live(rows, rows.where("id % 7 = 0")), _queries(rows), K, _dim(rows)))


_UP = ", up AS (SELECT id, 0 AS seq, e FROM v UNION ALL SELECT a.id, 1 AS seq, b.e FROM v a JOIN v b ON b.id = a.id + 1 WHERE a.id % 10 = 0)"


def _upserts(rows: DataFrame) -> DataFrame:
    """Every tenth id again with the vector of the next one."""
    later = rows.select((F.col("id") - 1).alias("id"), "embedding").where("id >= 0 and id % 10 = 0")
    return rows.select("id", "embedding", F.lit(0).alias("seq")).unionByName(later.withColumn("seq", F.lit(1)))


@query(f"WITH {_V}{_UP} SELECT id, seq, round(list_sum(e), 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM up) WHERE rn = 1")
def upsert_lww(spark, d):
    kept = search.newest(_upserts(_rows(spark, d)))
    return kept.select("id", "seq", F.round(F.aggregate(metrics.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_V}{_UP}, lw AS (SELECT id, max_by(e, seq) AS e FROM up GROUP BY id) " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, lw"))
def knn_after_upserts(spark, d):
    rows = _rows(spark, d)
    return _out(search.knn(search.newest(_upserts(rows)), _queries(rows), K, _dim(rows)))


@query(f"WITH {_V} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, v WHERE {_l2('qe', 'e')} <= 1.5", 1_000_000))
def range_search(spark, d):
    """An extension: all rows within a radius."""
    rows = _rows(spark, d)
    return _out(search.within(rows, _queries(rows), 1.5, _dim(rows)))


# --- Routing -------------------------------------------------------------------------------------------------------


@query(f"WITH {_V}{_C} SELECT id, bucket_id, round(s, 6) AS distance FROM (SELECT v.id, c.bucket_id, round({_l2('e', 'ce')}, 9) AS s, row_number() OVER (PARTITION BY v.id ORDER BY round({_l2('e', 'ce')}, 9), c.bucket_id) AS rn FROM v, c) WHERE rn = 1")
def route_assign(spark, d):
    rows = _rows(spark, d)
    return routing.assign(rows, maintain.centroids(rows), _dim(rows)).withColumn("distance", F.round("distance", 6))


def _selected(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, d)
    return rows, routing.select_buckets(_queries(rows), maintain.centroids(rows), _dim(rows), target=TARGET, decay=DECAY, density=DENSITY)


@query(f"WITH {_V}{_C}{_SEL} SELECT query_id, bucket_id, place, round(share, 6) AS share FROM sel")
def select_buckets(spark, d):
    return _selected(spark, d)[1].select("query_id", "bucket_id", "place", F.round("share", 6).alias("share"))


@query(f"WITH {_V}{_C}{_SEL} SELECT query_id, bucket_id, near FROM sel WHERE near <= 3")
def guardrail_nearest3(spark, d):
    return _selected(spark, d)[1].where("near <= 3").select("query_id", "bucket_id", "near")


@query(f"WITH {_V}{_C}{_SEL} " + _top(f"SELECT q.query_id, v.id, round({_l2('qe', 'e')}, 9) AS s FROM q JOIN sel USING (query_id) JOIN v USING (bucket_id)"))
def pruned_knn(spark, d):
    rows, routes = _selected(spark, d)
    return _out(search.knn(rows, _queries(rows), K, _dim(rows), routes=routes))


@query(f"WITH {_V}{_C} SELECT bucket_id, count(*) AS n FROM (SELECT v.id, c.bucket_id, row_number() OVER (PARTITION BY v.id ORDER BY round({_l2('e', 'ce')}, 9), c.bucket_id) AS rn FROM v, c) WHERE rn = 1 GROUP BY bucket_id")
def partition_batch(spark, d):
    """A flush groups its rows by routed bucket."""
    rows = _rows(spark, d)
    return routing.assign(rows, maintain.centroids(rows), _dim(rows)).groupBy("bucket_id").agg(F.count("*").alias("n"))


# --- Quantisation --------------------------------------------------------------------------------------------------


@query(f"WITH {_V}{_SQ} SELECT bucket_id, CAST(pos - 1 AS INTEGER) AS pos, round(low, 6) AS low, round(high, 6) AS high, round(step, 9) AS step FROM st")
def sq8_train(spark, d):
    rows = _rows(spark, d)
    flat = sq8.train(rows, _dim(rows)).select("bucket_id", F.posexplode(F.arrays_zip("low", "high", "step")).alias("pos", "z"))
    return flat.select("bucket_id", "pos", F.round("z.low", 6).alias("low"), F.round("z.high", 6).alias("high"), F.round("z.step", 9).alias("step"))


def _coded(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _rows(spark, d)
    quantizers = sq8.train(rows, _dim(rows))
    return rows, quantizers, rows.join(quantizers, "bucket_id").select("id", "bucket_id", "embedding", "low", "step", sq8.encode("embedding", "low", "step").alias("codes"))


@query(f"WITH {_V}{_SQ} SELECT id, CAST(pos - 1 AS INTEGER) AS pos, code FROM ec")
def sq8_encode(spark, d):
    return _coded(spark, d)[2].select("id", F.posexplode(F.col("codes").cast("array<int>")).alias("pos", "code"))


@query(f"WITH {_V}{_SQ} SELECT CAST(pos - 1 AS INTEGER) AS pos, round(max(abs(x - (low + code * step))), 6) AS worst FROM ec GROUP BY pos")
def sq8_reconstruct_error(spark, d):
    coded = _coded(spark, d)[2]
    gap = F.zip_with(metrics.doubles("embedding"), sq8.reconstruct("codes", "low", "step"), lambda a, b: F.abs(a - b))
    return coded.select(F.posexplode(gap).alias("pos", "g")).groupBy("pos").agg(F.round(F.max("g"), 6).alias("worst"))


@query(f"WITH {_V}{_SQ} " + _top(f"SELECT query_id, id, round({_l2('qe', 're')}, 9) AS s FROM q, rc"))
def adc_topk_l2(spark, d):
    rows, quantizers, coded = _coded(spark, d)
    return _out(search.knn_codes(coded, quantizers, _queries(rows), K, _dim(rows)))


@query(f"WITH {_V}{_SQ} " + _top(f"SELECT query_id, id, round({_cos('qe', 're')}, 9) AS s FROM q, rc"))
def adc_topk_cosine(spark, d):
    rows, quantizers, coded = _coded(spark, d)
    return _out(search.knn_codes(coded, quantizers, _queries(rows), K, _dim(rows), "COSINE"))


@query(f"WITH {_V}{_SQ} " + _top(f"SELECT query_id, id, round({_l2('qe', 're')}, 9) AS s FROM q, rc"))
def adc_tables_l2(spark, d):
    """By a table of distances for each query and bucket."""
    rows, quantizers, coded = _coded(spark, d)
    return _out(search.knn_codes(coded, quantizers, _queries(rows), K, _dim(rows), tables=True))


_ADC = f", adc AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round({_l2('qe', 're')}, 9), id) AS rn FROM q, rc) WHERE rn <= {search.OVERSAMPLE * K})"


@query(f"WITH {_V}{_SQ}{_ADC} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM adc JOIN q USING (query_id) JOIN v USING (id)"))
def two_stage_search(spark, d):
    rows, quantizers, coded = _coded(spark, d)
    return _out(search.two_stage(coded, quantizers, rows, _queries(rows), K, _dim(rows)))


# --- Buckets and maintenance ---------------------------------------------------------------------------------------


@query(f"WITH {_V} SELECT bucket_id, CAST(pos - 1 AS INTEGER) AS pos, count(*) AS n, round(sum(x), 6) AS total, round(avg(x), 6) AS mean FROM (SELECT bucket_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY bucket_id, pos")
def bucket_stats(spark, d):
    return maintain.position_stats(_rows(spark, d)).select("bucket_id", "pos", "n", F.round("total", 6).alias("total"), F.round("mean", 6).alias("mean"))


@query(f"WITH {_V}{_C}, h AS (SELECT bucket_id, pos, avg(x) AS m FROM (SELECT bucket_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v WHERE id < (SELECT count(*) / 2 FROM v)) GROUP BY bucket_id, pos) SELECT cm.bucket_id, round(sqrt(sum((cm.m - h.m) * (cm.m - h.m))), 6) AS shift FROM cm JOIN h USING (bucket_id, pos) GROUP BY cm.bucket_id")
def centroid_shift(spark, d):
    """How far bucket means have moved from those of the first half of the rows."""
    rows = _rows(spark, d)
    half = rows.count() / 2
    return maintain.shift(rows, maintain.centroids(rows.where(F.col("id") < half))).select("bucket_id", F.round("shift", 6).alias("shift"))


def _stats(spark, d) -> DataFrame:
    rows = _rows(spark, d)
    return maintain.counts(rows, rows.where("id % 4 = 0")).withColumn("temperature", F.lit(0.49))


_ST = f"""s AS (SELECT label AS bucket_id, count(*) AS total, count(*) FILTER (WHERE vec_id % 4 = 0) AS dead FROM embeddings GROUP BY label),
u AS (SELECT *, (CASE WHEN total - dead < {CAPACITY} THEN ({CAPACITY} - (total - dead)) / {CAPACITY}.0 ELSE 0 END) / (0.49 + 0.001) + 3.0 * dead / total AS urgency FROM s)"""


@query(f"WITH {_ST} SELECT bucket_id, total, dead, round(urgency, 6) AS urgency FROM u")
def urgency(spark, d):
    return maintain.decide(_stats(spark, d), CAPACITY).select("bucket_id", "total", "dead", F.round("urgency", 6).alias("urgency"))


@query(f"WITH {_ST} SELECT bucket_id, CASE WHEN total / {CAPACITY}.0 > 1 THEN 'split' WHEN urgency > 1.5 THEN 'merge' ELSE 'none' END AS action FROM u")
def maintenance_decision(spark, d):
    return maintain.decide(_stats(spark, d), CAPACITY).select("bucket_id", "action")


_KM0 = "k0 AS (SELECT CAST(id AS INTEGER) AS cluster, e AS ce FROM v WHERE id IN (0, 1))"


def _kstep(before: str, after: str) -> str:
    near = f"row_number() OVER (PARTITION BY v.id ORDER BY round({_l2('e', 'ce')}, 9), cluster)"
    return f"""{after}m AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM (SELECT v.e, cluster, {near} AS rn FROM v, {before}) WHERE rn = 1) GROUP BY cluster, pos),
{after} AS (SELECT cluster, list(m ORDER BY pos) AS ce FROM {after}m GROUP BY cluster)"""


def _init(rows: DataFrame) -> np.ndarray:
    return matrix(rows.where("id in (0, 1)").orderBy("id").select("embedding").toArrow().column("embedding"), _dim(rows))


def _centres(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(c, p, round(float(x), 6)) for c, row in enumerate(centres) for p, x in enumerate(row)], "cluster int, pos int, mean double")


@query(f"WITH {_V}, {_KM0}, {_kstep('k0', 'k1')} SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS mean FROM k1m")
def kmeans_step(spark, d):
    rows = _rows(spark, d)
    return cluster.step_sums(rows, _init(rows)).select("cluster", "pos", F.round(F.col("total") / F.col("n"), 6).alias("mean"))


@query(f"WITH {_V}, {_KM0}, {_kstep('k0', 'k1')}, {_kstep('k1', 'k2')}, {_kstep('k2', 'k3')} SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS mean FROM k3m")
def kmeans_n_steps(spark, d):
    rows = _rows(spark, d)
    return _centres(spark, cluster.kmeans(rows, 2, _dim(rows), rounds=3, tolerance=0.0, init=_init(rows)))


@query(f"WITH {_V}, u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v), k AS (SELECT CAST(id AS INTEGER) AS cluster, e AS ce FROM u WHERE id IN (0, 1)), n AS (SELECT cluster, e FROM (SELECT u.e, cluster, row_number() OVER (PARTITION BY u.id ORDER BY round({_cos('e', 'ce')}, 9), cluster) AS rn FROM u, k) WHERE rn = 1), m AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM n) GROUP BY cluster, pos) SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY cluster)), 6) AS mean FROM m")
def spherical_step(spark, d):
    rows = _rows(spark, d)
    return _centres(spark, cluster.kmeans(rows, 2, _dim(rows), "COSINE", rounds=1, init=cluster.unit(_init(rows))))


_HALF = f", hv AS (SELECT id, e FROM v WHERE bucket_id = 0), ha AS (SELECT hv.id, round({_l2('hv.e', 'a.e')}, 9) AS d0, round({_l2('hv.e', 'b.e')}, 9) AS d1 FROM hv, (SELECT e FROM hv ORDER BY id LIMIT 1) a, (SELECT e FROM hv ORDER BY id DESC LIMIT 1) b), g AS (SELECT hv.id, min(round({_l2('hv.e', 'ce')}, 9)) AS dg FROM hv, c WHERE c.bucket_id <> 0 GROUP BY hv.id)"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Bucket 0 under split, its first and last row as halves, and the other buckets' centroids."""
    rows = _rows(spark, d)
    dim, own = _dim(rows), rows.where("bucket_id = 0")
    ends = [own.orderBy(o).limit(1).select("embedding").toArrow().column("embedding") for o in (F.asc("id"), F.desc("id"))]
    others = routing.Centroids(maintain.centroids(rows), dim)
    return own, np.concatenate([matrix(e, dim) for e in ends]), others.points[others.ids != 0]


@query(f"WITH {_V}{_C}{_HALF} SELECT id, CAST(d1 < d0 AS INTEGER) AS half, dg < least(d0, d1) * 0.9 AS defects FROM ha JOIN g USING (id)")
def split_defectors(spark, d):
    return cluster.defectors(*_split(spark, d))


def _kbatch(before: str, after: str, rest: int) -> str:
    """One streaming-mean update by the rows of id % 3 = rest; before and after have (cluster, ce, seen)."""
    near = f"row_number() OVER (PARTITION BY v.id ORDER BY round({_l2('e', 'ce')}, 9), cluster)"
    return f"""{after}b AS (SELECT cluster, pos, sum(x) AS t, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM (SELECT v.e, cluster, {near} AS rn FROM v, {before} WHERE v.id % 3 = {rest}) WHERE rn = 1) GROUP BY cluster, pos),
{after}o AS (SELECT cluster, seen, unnest(ce) AS c, generate_subscripts(ce, 1) AS pos FROM {before}),
{after}m AS (SELECT cluster, pos, CASE WHEN n > 0 THEN (c * seen + t) / (seen + n) ELSE c END AS m, seen + coalesce(n, 0) AS seen FROM {after}o LEFT JOIN {after}b USING (cluster, pos)),
{after} AS (SELECT cluster, list(m ORDER BY pos) AS ce, max(seen) AS seen FROM {after}m GROUP BY cluster)"""


@query(f"WITH {_V}, k0 AS (SELECT CAST(id AS INTEGER) AS cluster, e AS ce, 0 AS seen FROM v WHERE id IN (0, 1)), {_kbatch('k0', 'k1', 0)}, {_kbatch('k1', 'k2', 1)}, {_kbatch('k2', 'k3', 2)} SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS mean FROM k3m")
def kmeans_mini_batches(spark, d):
    """Running means over three batches, which are the whole table."""
    rows = _rows(spark, d)
    return _centres(spark, cluster.mini_batches([rows.where(F.col("id") % 3 == r) for r in range(3)], _init(rows)))


@query(f"WITH {_V}{_C}{_HALF}, w AS (SELECT id, d1 < d0 AS h, dg < least(d0, d1) * 0.9 AS f FROM ha JOIN g USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY id) AS rn, count(*) OVER () AS k FROM w), z AS (SELECT id, CAST(h AS INTEGER) AS half FROM r WHERE NOT (f AND rn <= k // 5)) SELECT half, CAST(pos - 1 AS INTEGER) AS pos, count(*) AS n, round(avg(x), 6) AS mean FROM (SELECT half, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM z JOIN hv USING (id)) GROUP BY half, pos")
def split_capped(spark, d):
    """The other split of bucket 0: a fifth of its rows leaves at most; the halves' means after that."""
    own, halves, others = _split(spark, d)
    moved = cluster.capped(cluster.defectors(own, halves, others))
    return cluster.half_means(own, moved).withColumn("mean", F.round("mean", 6))


@query(f"WITH {_V}{_C} SELECT id, bucket_id, round(s, 6) AS distance FROM (SELECT v.id, c.bucket_id, round({_l2('e', 'ce')}, 9) AS s, row_number() OVER (PARTITION BY v.id ORDER BY round({_l2('e', 'ce')}, 9), c.bucket_id) AS rn FROM v, c WHERE v.bucket_id = 3 AND c.bucket_id <> 3) WHERE rn = 1")
def scatter_merge(spark, d):
    rows = _rows(spark, d)
    return routing.assign(rows.where("bucket_id = 3"), maintain.centroids(rows), _dim(rows), apart=3).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0")
def tombstones_union(spark, d):
    ids = _rows(spark, d).select("id")
    return ids.where("id % 7 = 0").union(ids.where("id % 11 = 0")).distinct()


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 = 0 AND vec_id % 11 <> 0")
def tombstones_prune(spark, d):
    ids = _rows(spark, d).select("id")
    return maintain.prune(ids.where("id % 7 = 0"), ids.where("id % 11 = 0"))


@query("SELECT label AS bucket_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id % 7 <> 0 GROUP BY label")
def promote(spark, d):
    rows = _rows(spark, d)
    cut = rows.count() * 0.8
    kept = maintain.promote(rows.where(F.col("id") < cut), rows.where(F.col("id") >= cut), rows.where("id % 7 = 0"))
    return kept.groupBy("bucket_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("WITH e AS (SELECT * FROM embeddings) SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS said, label AS found FROM e WHERE vec_id % 5 = 0")
def id_bucket_validation(spark, d):
    rows = _rows(spark, d)
    said = rows.select("id", F.when(F.col("id") % 5 == 0, (F.col("bucket_id") + 1) % 10).otherwise(F.col("bucket_id")).alias("bucket_id"))
    return maintain.validate_buckets(said, rows)


@query(f"WITH {_V} SELECT bucket_id, CAST(pos - 1 AS INTEGER) AS pos, count(*) AS n, round(sum(x * (id + 1)), 4) AS weighted FROM (SELECT id, bucket_id, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY bucket_id, pos")
def rows_to_columns(spark, d):
    weighted = F.aggregate(F.zip_with("values", "ids", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    cols = maintain.columns(_rows(spark, d)).select("bucket_id", "pos", F.size("values").cast("long").alias("n"), weighted.alias("weighted"))
    return cols.groupBy("bucket_id", "pos").agg(F.sum("n").alias("n"), F.round(F.sum("weighted"), 4).alias("weighted"))


@query(f"WITH {_V} SELECT id, len(e) AS n, round(list_sum(e), 6) AS total FROM v")
def columns_to_rows(spark, d):
    back = maintain.rows_of(maintain.columns(_rows(spark, d)))
    return back.select("id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- The log -------------------------------------------------------------------------------------------------------

_KIND = "CASE WHEN event_id % 9 = 0 THEN 'BEGIN' WHEN event_id % 9 = 7 AND event_id % 4 <> 3 THEN 'COMMIT' WHEN event_id % 5 = 2 THEN 'DELETE' ELSE 'INSERT' END"


def _ops(spark: SparkSession, d: str) -> DataFrame:
    """events as a log: a log for each hundred users, transactions opened and mostly closed by event number."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.expr(_KIND)
    tx = F.when(kind.isin("BEGIN", "COMMIT"), F.floor(F.col("event_id") / 9))
    return e.select((F.col("user_id") % 4).alias("log_id"), F.col("event_id").alias("seq"), kind.alias("kind"), tx.alias("tx_id"), F.col("user_id").alias("id"), F.array("value").alias("embedding"), (F.col("event_id") % 997 != 500).alias("crc_ok"))


_OPS = f"""o AS (SELECT user_id % 4 AS log_id, event_id AS seq, {_KIND} AS kind, CASE WHEN {_KIND} IN ('BEGIN', 'COMMIT') THEN event_id // 9 END AS tx_id, user_id AS id, value, event_id % 997 <> 500 AS crc_ok FROM events),
o1 AS (SELECT * FROM (SELECT *, sum(CASE WHEN crc_ok THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bad FROM o) WHERE bad = 0),
o2 AS (SELECT *, last_value(CASE WHEN kind = 'BEGIN' THEN seq END IGNORE NULLS) OVER w AS bs, last_value(CASE WHEN kind = 'BEGIN' THEN tx_id END IGNORE NULLS) OVER w AS bt FROM o1 WINDOW w AS (PARTITION BY log_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o3 AS (SELECT *, last_value(CASE WHEN kind = 'COMMIT' AND tx_id = bt THEN seq END IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM o2),
o4 AS (SELECT *, CASE WHEN kind = 'BEGIN' THEN 'B' WHEN kind = 'COMMIT' AND tx_id = bt AND (lm IS NULL OR lm < bs) THEN 'C' END AS s FROM o3),
o5 AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(s IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM o4),
done AS (SELECT * FROM o5 WHERE kind IN ('INSERT', 'DELETE') AND (coalesce(p, 'C') <> 'B' OR n = 'C'))"""


@query(f"WITH {_OPS} SELECT log_id, seq, kind, id FROM done")
def wal_committed(spark, d):
    return oplog.committed(_ops(spark, d)).select("log_id", "seq", "kind", "id")


@query(f"WITH {_OPS}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM done) SELECT id, seq, round(value, 6) AS value FROM t WHERE rn = 1 AND kind = 'INSERT'")
def wal_replay(spark, d):
    return oplog.replay(oplog.committed(_ops(spark, d))).select("id", "seq", F.round(F.col("embedding")[0], 6).alias("value"))


@query(f"WITH {_OPS}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM done WHERE seq <= (SELECT max(event_id) // 2 FROM events)) SELECT id, seq, round(value, 6) AS value FROM t WHERE rn = 1 AND kind = 'INSERT'")
def snapshot_at_seq(spark, d):
    """The table as it was at half of the log."""
    ops = _ops(spark, d)
    return oplog.as_of(oplog.committed(ops), ops.agg(F.floor(F.max("seq") / 2)).first()[0] or 0).select("id", "seq", F.round(F.col("embedding")[0], 6).alias("value"))


_CRC = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
fr AS (SELECT *, concat_ws('|', seq, kind, coalesce(CAST(tx_id AS VARCHAR), ''), CAST(id AS VARCHAR), CAST(value AS VARCHAR)) AS f FROM o)"""


@query(f"WITH {_OPS.partition('o1 AS')[0]}{_CRC} SELECT log_id, seq, kind, xor(list_reduce(list_transform(string_split(f, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM fr, tab")
def crc32_frames(spark, d):
    return oplog.with_checksum(_ops(spark, d)).select("log_id", "seq", "kind", "crc")


# --- Evaluation ----------------------------------------------------------------------------------------------------

_EX = f", ex AS ({_top('SELECT query_id, id, round(' + _l2('qe', 'e') + ', 9) AS s FROM q, v')}), pr AS ({_top('SELECT q.query_id, v.id, round(' + _l2('qe', 'e') + ', 9) AS s FROM q JOIN sel USING (query_id) JOIN v USING (bucket_id)')})"


@query(f"WITH {_V}{_C}{_SEL}{_EX} SELECT ex.query_id, round(count(pr.id) / {K}.0, 6) AS recall FROM ex LEFT JOIN pr ON ex.query_id = pr.query_id AND ex.id = pr.id GROUP BY ex.query_id")
def recall_at_k(spark, d):
    rows, routes = _selected(spark, d)
    q, dim = _queries(rows), _dim(rows)
    return evaluate.recall(search.knn(rows, q, K, dim, routes=routes), search.knn(rows, q, K, dim), K).withColumn("recall", F.round("recall", 6))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY n, label) AS rn, count(*) OVER () AS k FROM s) SELECT k AS buckets, (SELECT min(n) FROM s) AS least, n AS median, (SELECT max(n) FROM s) AS most, (SELECT count(*) FROM s WHERE n < 50) AS sparse FROM r WHERE rn = k // 2 + 1")
def bucket_size_summary(spark, d):
    sizes = _rows(spark, d).groupBy("bucket_id").agg(F.count("*").alias("n"))
    return evaluate.bucket_summary(sizes, 50).withColumn("sparse", F.col("sparse").cast("long"))


@query(f"WITH {_V}, ex AS ({_top('SELECT query_id, id, round(' + _l2('qe', 'e') + ', 9) AS s FROM q, v')}) SELECT count(*) AS results, count(*) FILTER (WHERE id % 7 = 0) AS deleted, round(count(*) FILTER (WHERE id % 7 = 0) / count(*), 6) AS rate FROM ex")
def deleted_hit_rate(spark, d):
    rows = _rows(spark, d)
    return evaluate.deleted_hits(search.knn(rows, _queries(rows), K, _dim(rows)), rows.where("id % 7 = 0")).withColumn("rate", F.round("rate", 6))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(value) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, n, round(value, 6) AS value FROM r WHERE rn = least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1")
def percentile_floor(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type", "value")
    return evaluate.percentile_floor(events, "event_type", "value", 0.95).withColumn("value", F.round("value", 6))


@query(f"WITH {_V} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, v WHERE id % 7 <> 0"))
def unified_l0_l1_search(spark, d):
    """The newest fifth as the delta tier, every seventh row deleted."""
    rows = _rows(spark, d)
    cut = rows.count() * 0.8
    return _out(search.unified(rows.where(F.col("id") < cut), rows.where(F.col("id") >= cut), rows.where("id % 7 = 0"), _queries(rows), K, _dim(rows)))


@query("SELECT user_id, count(*) AS touches, round((1 - 0.5 * power(0.95, count(*))) * power(0.98, count(*) FILTER (WHERE event_id % 2 = 0)), 6) AS temperature FROM events GROUP BY user_id")
def temperature_after_ops(spark, d):
    n = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("touches"), F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("cools"))
    return n.select("user_id", "touches", F.round(maintain.temperature(F.col("touches"), F.col("cools")), 6).alias("temperature"))


@query(f"WITH {_V} SELECT a.id, round({_l2('a.e', 'b.e')}, 6) AS l2, round({_cos('a.e', 'b.e')}, 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def scalar_kernels(spark, d):
    rows = _rows(spark, d)
    nxt = rows.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other"))
    return rows.join(nxt, "id").select("id", F.round(metrics.l2_squared("embedding", "other"), 6).alias("l2"), F.round(metrics.cosine_distance("embedding", "other"), 6).alias("cosine"))


@query(f"WITH {_V} SELECT id, round(list_sum(list_transform(e, lambda x: abs(x / sqrt(list_sum(list_transform(e, lambda y: y * y)))))), 6) AS l1 FROM v")
def normalized_rows(spark, d):
    unit = _rows(spark, d).select("id", metrics.normalized("embedding").alias("u"))
    return unit.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query("SELECT count(*) AS sampled, count(*) FILTER (WHERE vec_id % 3 <> 0) AS covered, round(count(*) FILTER (WHERE vec_id % 3 <> 0) / count(*), 6) AS rate FROM embeddings")
def id_map_coverage(spark, d):
    rows = _rows(spark, d)
    return evaluate.coverage(rows, rows.where("id % 3 <> 0")).withColumn("rate", F.round("rate", 6))


# --- Collections ---------------------------------------------------------------------------------------------------


def _engine(spark: SparkSession) -> Engine:
    """A fresh one in the shared folder."""
    return Engine(spark, f"{shared_dir(spark)}/vecmesh-collections/{uuid.uuid4().hex}")


def _collection(spark: SparkSession, d: str, capacity: int = 10_000) -> Collection:
    """A fresh collection in the shared folder: all rows, then every tenth with the next one's vector, then deletes."""
    rows = _rows(spark, d)
    c = _engine(spark).create("c", _dim(rows), capacity=capacity)
    c.insert(rows)
    c.flush()
    c.insert(_upserts(rows).where("seq = 1"))
    c.delete(rows.where("id % 7 = 0"))
    return c


_LIVE = f"{_UP}, lw AS (SELECT id, max_by(e, seq) AS e FROM up WHERE id % 7 <> 0 GROUP BY id)"


@query(f"WITH {_V}{_LIVE} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM q, lw"))
def collection_search(spark, d):
    """Base and log searched as one."""
    return _out(_collection(spark, d).search(_queries(_rows(spark, d)), K, exact=True))


@query(f"WITH {_V}{_LIVE} SELECT id, round(list_sum(e), 6) AS total FROM lw")
def collection_after_maintenance(spark, d):
    """Flush, splits and merges lose, double and revive nothing."""
    c = _collection(spark, d, capacity=200)
    c.flush()
    for _ in range(3):
        c.maintain()
    return c.live().select("id", F.round(F.aggregate(metrics.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id AS id, 'base' AS tier, label AS source_label FROM embeddings")
def streaming_ingest(spark, d):
    """The table as a stream into a collection, each micro-batch one write with a flush behind it."""
    rows = _rows(spark, d)
    c = _engine(spark).create("c", _dim(rows))
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/embeddings.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/embeddings.parquet" if Files(spark, f"{d}/embeddings.parquet").is_folder() else f"{d}/embeddings*.parquet")
    ingest(stream.select(F.col("vec_id").alias("id"), "embedding"), c, f"{c.path}-stream").awaitTermination()
    return c.locate(rows).join(rows.select("id", F.col("bucket_id").alias("source_label")), "id").select("id", "tier", "source_label")


def _adopted(spark: SparkSession, d: str) -> Collection:
    """A collection whose buckets are the labels."""
    rows = _rows(spark, d)
    c = _engine(spark).create("c", _dim(rows))
    c.adopt(rows)
    return c


_OPTIONS = {"target": TARGET, "decay": DECAY, "density": DENSITY}


@query(f"WITH {_V}{_C}{_SEL} " + _top(f"SELECT q.query_id, v.id, round({_l2('qe', 'e')}, 9) AS s FROM q JOIN sel USING (query_id) JOIN v USING (bucket_id)"))
def collection_routed_search(spark, d):
    """The buckets that routing takes are read, no others."""
    return _out(_adopted(spark, d).search(_queries(_rows(spark, d)), K, **_OPTIONS))


@query(f"WITH {_V}{_C}{_SEL} " + _top(f"SELECT q.query_id, v.id, round({_l2('qe', 'e')}, 9) AS s FROM q JOIN sel USING (query_id) JOIN v USING (bucket_id)"))
def collection_hot_search(spark, d):
    """The same with some buckets held on the executors by searches before it."""
    c, asked = _adopted(spark, d), _queries(_rows(spark, d))
    c.keep_hot(buckets=4, rows=_rows(spark, d).count() // 2)
    for _ in range(2):
        c.search(asked, K, **_OPTIONS).count()
    if not c.hot.held:
        raise ValueError("no bucket is held")
    return _out(c.search(asked, K, **_OPTIONS))


@query(f"WITH {_V}{_SQ}{_ADC} " + _top(f"SELECT query_id, id, round({_l2('qe', 'e')}, 9) AS s FROM adc JOIN q USING (query_id) JOIN v USING (id)"))
def collection_two_stage(spark, d):
    """Candidates by a collection's codes, scores by their vectors."""
    return _out(_adopted(spark, d).search(_queries(_rows(spark, d)), K, exact=True, two_stage=True))


@query(f"WITH {_V}{_SQ} SELECT bucket_id, CAST(pos - 1 AS INTEGER) AS pos, round(low, 6) AS low, round(step, 9) AS step FROM st")
def collection_quantizers(spark, d):
    """The quantisers that a snapshot keeps."""
    flat = _adopted(spark, d).quantizers().select("bucket_id", F.posexplode(F.arrays_zip("low", "step")).alias("pos", "z"))
    return flat.select("bucket_id", "pos", F.round("z.low", 6).alias("low"), F.round("z.step", 9).alias("step"))


@query(f"WITH {_V}{_C}{_SEL}, t AS (SELECT DISTINCT bucket_id FROM sel) SELECT c.bucket_id, n AS total, round(CAST(CASE WHEN t.bucket_id IS NULL THEN 0.5 ELSE 1 - 0.5 * 0.95 END AS DOUBLE) * 0.98, 6) AS temperature FROM c LEFT JOIN t USING (bucket_id)")
def collection_warmed(spark, d):
    """The registry of buckets: what a search has read is warmer after the next tick, all are a little cooler."""
    c = _adopted(spark, d)
    c.search(_queries(_rows(spark, d)), K, **_OPTIONS)
    c.capacity = 10**9  # no split is due
    c._warm(c._touched, maintain.COOL)
    heat = spark.createDataFrame(list(c.state().temperature), "bucket_id int, temperature double")
    return c.centroids().join(heat, "bucket_id").select("bucket_id", F.col("n").alias("total"), F.round("temperature", 6).alias("temperature"))


@query(f"WITH {_V}{_UP} SELECT id, CASE WHEN max(seq) = 1 THEN 'delta' ELSE 'base' END AS tier, CASE WHEN max(seq) = 0 THEN any_value(label) END AS bucket_id FROM up JOIN embeddings ON vec_id = id WHERE id % 7 <> 0 GROUP BY id")
def collection_located(spark, d):
    """Where every id is: in the log, or in which bucket; deleted ones are nowhere."""
    rows, c = _rows(spark, d), _adopted(spark, d)
    c.insert(_upserts(rows).where("seq = 1"))
    c.delete(rows.where("id % 7 = 0"))
    return c.locate(rows)


@query("SELECT 2 AS segments, count(*) FILTER (WHERE vec_id % 10 = 0 AND vec_id + 1 IN (SELECT vec_id FROM embeddings)) + count(*) FILTER (WHERE vec_id % 7 = 0) AS rows, count(*) FILTER (WHERE vec_id % 7 = 0) AS deletes, 0 AS segments_after, 0 AS rows_after FROM embeddings")
def collection_log_sizes(spark, d):
    """What waits in the log before a flush and after it, the log's segments dropped by then."""
    c = _collection(spark, d)
    before = c.log_sizes()
    c.flush()
    c.vacuum()
    after = c.log_sizes()
    return spark.createDataFrame([(before["segments"], before["rows"], before["deletes"], after["segments"], after["rows"])], "segments int, rows long, deletes long, segments_after int, rows_after int")


_SUMS = f"WITH {_V}{_LIVE} SELECT id, round(list_sum(e), 6) AS total FROM lw"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round(F.aggregate(metrics.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(_SUMS)
def collection_reopened(spark, d):
    """Compacted, its leftovers dropped, and opened anew from its files."""
    c = _collection(spark, d)
    c.flush()
    c.compact()
    c.vacuum()
    return _totals(Engine(spark, c.files.root).open("c").live())


@query(f"WITH {_V} SELECT id, round(list_sum(e), 6) AS total FROM v")
def collection_as_of(spark, d):
    """Read as it was after its first write, two writes and a flush later."""
    c = _collection(spark, d)
    c.flush()
    return _totals(c.live(upto=1))


@query(f"WITH {_V} SELECT id, round(list_sum(e), 6) AS total FROM v")
def collection_trained(spark, d):
    """Bulk load with clustering; all rows are in some bucket's centroid."""
    rows = _rows(spark, d)
    c = _engine(spark).create("c", _dim(rows), "COSINE")
    c.train(rows, buckets=4, batch=200)
    if c.centroids().agg(F.sum("n")).first()[0] != rows.count():
        raise ValueError("centroids don't count all rows")
    return _totals(c.base())


@query("SELECT 'c' AS name, 'L2' AS metric, 1 AS version, 1 AS snapshot, 0 AS mismatches, count(*) AS base_rows FROM embeddings UNION ALL SELECT 'd', 'COSINE', 0, 0, 0, 0")
def collection_catalogue(spark, d):
    """The collections of an engine: their metric, what is in force, files that differ from their commit, and rows."""
    c = _adopted(spark, d)
    engine = Engine(spark, c.files.root)
    engine.create("d", c.dim, " cosine ", rotate=5)
    rows = [(n, o.metric.value, o.metrics(), len(o.verify("warn"))) for n in engine.names() for o in [engine.create(n, c.dim, None if n == "c" else "Cosine")]]
    return spark.createDataFrame([(n, m, s["version"], s["snapshot"], wrong, s["base_rows"]) for n, m, s, wrong in rows], "name string, metric string, version int, snapshot int, mismatches int, base_rows long")


@query("SELECT count(*) AS base_rows, 0 AS log_rows, 2 AS snapshot FROM embeddings")
def collection_rotated(spark, d):
    """A log that reaches its bound is flushed by the write that brings it there."""
    rows = _rows(spark, d)
    c = _engine(spark).create("c", _dim(rows), rotate=max(1, rows.count() // 3))
    for r in range(2):
        c.insert(rows.where(F.col("id") % 2 == r))
    m = c.metrics()
    return spark.createDataFrame([(m["base_rows"], m["log_entries"], m["snapshot"])], "base_rows long, log_rows int, snapshot int")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 9 = 0) AS bad FROM embeddings")
def checked_rows(spark, d):
    """How many rows a write would refuse: every ninth is cut short."""
    rows = _rows(spark, d)
    cut = rows.select("id", F.when(F.col("id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("embedding"))
    return cut.select(F.count("*").over(Window.partitionBy()).alias("n"), bad(_dim(rows)).alias("b")).groupBy("n").agg(F.sum(F.col("b").cast("long")).alias("bad"))


@query("SELECT * FROM (VALUES ('', 'L2'), (' cosine ', 'COSINE'), ('COSINE', 'COSINE'), ('l2', 'L2'), ('dot', 'error')) t(text, metric)")
def metric_names(spark, d):
    def parsed(text: str) -> str:
        try:
            return metrics.Metric.parse(text).value
        except ValueError:
            return "error"

    return spark.createDataFrame([(t, parsed(t)) for t in ("", " cosine ", "COSINE", "l2", "dot")], "text string, metric string")


@query(f"WITH {_V} SELECT rank, id, round(s, 4) AS score FROM (SELECT id, s, CAST(row_number() OVER (ORDER BY s, id) AS INTEGER) AS rank FROM (SELECT id, round({_l2('qe', 'e')}, 9) AS s FROM v, q WHERE query_id = 0 AND id IN (0, 1, 2, 3) AND id <> 2)) WHERE rank <= 2")
def command_line(spark, d):
    """Create, insert, delete, flush and search by the command line."""
    rows = _rows(spark, d).where("id < 4").orderBy("id").collect()
    root = _engine(spark).files.root
    call = lambda *a: cli.main(["--root", root, *a], spark, quiet=True)
    call("create", "c", "--dim", str(len(rows[0]["embedding"])))
    call("insert", "c", "--vectors", json.dumps({r["id"]: r["embedding"] for r in rows}))
    call("delete", "c", "--ids", "2")
    call("flush", "c")
    found = call("search", "c", "--vector", json.dumps(rows[0]["embedding"]), "--k", "2")
    return spark.createDataFrame([(n + 1, i, round(s, 4)) for n, (i, s) in enumerate(found)], "rank int, id long, score double")


@query("SELECT 1000 AS n, 0 AS outside, 5 AS clusters, 30 AS needles")
def generated_vectors(spark, d):
    """Seeded vectors: how many, how many out of range, how many clusters, how many needles within reach."""
    rows = generators.uniform(spark, 1000, 8, high=10.0)
    outside = rows.where(F.exists("embedding", lambda x: (x < 0) | (x > 10))).count()
    near = generators.clusters(spark, 1000, 8, centres=5, sigma=0.01).select(F.transform("embedding", lambda x: F.round(x / 5))).distinct().count()
    asked = rows.where("id < 3").withColumnRenamed("id", "query_id")
    planted = generators.needles(spark, asked, 10).withColumnRenamed("embedding", "e").join(asked, "query_id").where(metrics.l2_squared("e", "embedding") <= 8 * 0.006**2)
    return spark.createDataFrame([(rows.distinct().count(), outside, min(near, 5), planted.count())], "n int, outside int, clusters int, needles int")


@query()
def queue_cache_trace(spark, d):
    return caches.trace(spark.read.parquet(f"{d}/events.parquet"), "user_id", ["ts", "event_id"], capacity=64)
