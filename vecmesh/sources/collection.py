"""Collections of vectors: an operation log for writes, bucketed Parquet for the base, immutable parts.

Layout under root/name: meta.json; log/<seq>-<rows>, one directory for each acknowledged write; claims/<seq>, made by
writers before they write; rows/part=<n> and codes/part=<n>, partitioned by bucket; deletes/<n>, ids and the seq up to
which they hide rows; snapshots/<n>, centroids, their sums and quantisers; states/<version>, what was in force: parts,
deletes, retired buckets, and the seq up to which the log is in them; numbers/<n>, files/<n>.json: publications begun,
and their files' sizes and checksums. A snapshot also has anchors, the centroids of buckets when they were made. The latest version is in force. Versions and
claims are made exclusively, so of several writers one gets each; readers see one state or the next.

A flush appends a part of what is new and hides what it replaces; a split or merge appends the moved rows and retires
their old bucket, whose files are no longer read. Only compact() and train(buckets=...) write the whole base. A
publication that another one overtook starts anew. A flush takes the log up to the first claim that is still open.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from dataclasses import asdict, dataclass, fields, replace
from functools import wraps
from urllib.parse import unquote

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import sq8
from ..functions.arrow import matrix
from ..functions.metrics import Metric, block_scores
from ..operators import cluster, maintain, oplog, routing, search
from ..schema import BASE, CENTROIDS, CODES, OPS, QUANTIZERS, TOTALS, Conflict, InvalidInput, NotFound, bad, checked
from .files import Files
from .hot import HotBuckets

#: Layout of the files; other ones are refused.
FORMAT = 2
RETRIES = 8


@dataclass(frozen=True)
class State:
    """What is in force: snapshot 0 has no parts. temperature: (bucket, value) of each bucket."""

    version: int = 0
    snapshot: int = 0
    flushed: int = 0
    parts: tuple[int, ...] = ()
    deletes: tuple[int, ...] = ()
    retired: tuple[int, ...] = ()
    temperature: tuple[tuple[int, float], ...] = ()


def _retried(f):
    """Start a publication anew that another one overtook."""

    @wraps(f)
    def run(self, *args, **kwargs):
        for attempt in range(RETRIES):
            try:
                return f(self, *args, **kwargs)
            except Conflict:
                if attempt == RETRIES - 1:
                    raise

    return run


class Engine:
    """All collections under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def create(self, name: str, dim: int, metric: str = "L2", capacity: int = maintain.CAPACITY, rotate: int | None = None) -> Collection:
        """Make a collection or open the one that is there, whose dim and metric must be the same.

        A write that brings the log to `rotate` rows or more is followed by a flush.
        """
        if not name or not name.strip() or "/" in name:
            raise InvalidInput("a collection needs a name")
        if dim < 1 or capacity < 1 or (rotate is not None and rotate < 1):
            raise InvalidInput("dim, capacity and rotate must be 1 or more")
        meta = {"format": FORMAT, "dim": dim, "metric": Metric.parse(metric).value, "capacity": capacity, "rotate": rotate}
        if not self.files.exists(f"{name}/meta.json") and self.files.create(f"{name}/meta.json", json.dumps(meta)):
            return self.open(name)
        return self.open(name, dim, metric)

    def open(self, name: str, dim: int | None = None, metric: str | None = None) -> Collection:
        if not self.files.exists(f"{name}/meta.json"):
            raise NotFound(name)
        meta = json.loads(self.files.read(f"{name}/meta.json"))
        if meta.get("format") != FORMAT:
            raise InvalidInput(f"{name} has format {meta.get('format')}, not {FORMAT}")
        if dim not in (None, meta["dim"]) or (metric is not None and Metric.parse(metric).value != meta["metric"]):
            raise InvalidInput(f"{name} has dim {meta['dim']} and metric {meta['metric']}")
        return Collection(self, name, meta["dim"], Metric.parse(meta["metric"]), meta["capacity"], meta["rotate"])

    def names(self) -> list[str]:
        return [n for n in self.files.names() if self.files.exists(f"{n}/meta.json")]

    def health(self) -> dict:
        return {"ready": True, "spark": self.spark.version, "collections": len(self.names())}


class Collection:
    def __init__(self, engine: Engine, name: str, dim: int, metric: Metric, capacity: int, rotate: int | None = None):
        self.spark, self.files, self.name = engine.spark, engine.files, name
        self.dim, self.metric, self.capacity, self.rotate = dim, metric, capacity, rotate
        self.path = f"{engine.root}/{name}"
        self.counters: Counter = Counter()
        self._touched: Counter = Counter()
        self._known: tuple[int, routing.Centroids] | None = None
        self.hot: HotBuckets | None = None

    # --- State ---

    def state(self, upto: int | None = None) -> State:
        """The state in force; with upto, the latest one whose base has no write after that seq."""
        for name in reversed(self.files.names(f"{self.name}/states")):
            text = self.files.read(f"{self.name}/states/{name}") if name.isdigit() else ""
            if not text:  # whoever made it hasn't written it, or never will
                continue
            held = json.loads(text)
            state = State(**{f.name: tuple(map(tuple, held[f.name])) if f.name == "temperature" else tuple(held[f.name]) if isinstance(held[f.name], list) else held[f.name] for f in fields(State)})
            if upto is None or state.flushed <= upto:
                return state
        return State()

    def _commit(self, state: State, before: State) -> None:
        """Put state in force if parts and buckets are still those of `before`; else raise Conflict.

        What others did to temperatures meanwhile is kept.
        """
        while True:
            now = self.state()
            if replace(now, version=0, temperature=()) != replace(before, version=0, temperature=()):
                raise Conflict(f"another publication overtook this one of {self.name}")
            heat = dict(state.temperature) | (dict(now.temperature) if now.version != before.version else {})
            kept = tuple(sorted((b, heat[b]) for b, _ in state.temperature))
            after = replace(state, version=self._last("states") + 1, temperature=kept)
            if self.files.create(f"{self.name}/states/{after.version:020d}", json.dumps(asdict(after))):
                return

    def _last(self, folder: str) -> int:
        return max((int(n.split("-")[0].removeprefix("part=")) for n in self.files.names(f"{self.name}/{folder}") if n.split("-")[0].removeprefix("part=").isdigit()), default=0)

    def _segments(self) -> dict[int, tuple[str, int]]:
        """seq -> (name, rows) of the log's writes."""
        out = {}
        for n in self.files.names(f"{self.name}/log"):
            if self.files.exists(f"{self.name}/log/{n}/_SUCCESS"):
                out[int(n.split("-")[0])] = n, int(n.split("-")[1])
        return out

    def _claim(self) -> int:
        """A seq that no other write has."""
        seq = max(self._last("claims"), self._last("log"), self.state().flushed) + 1
        while not self.files.create(f"{self.name}/claims/{seq:020d}"):
            seq += 1
        return seq

    def _claims(self) -> tuple[set[int], set[int]]:
        """All claims, and those given up."""
        names = [n for n in self.files.names(f"{self.name}/claims") if n.split("-")[0].isdigit()]
        return {int(n) for n in names if n.isdigit()}, {int(n.split("-")[0]) for n in names if n.endswith("-void")}

    def _settled(self, state: State) -> int:
        """The seq up to which every claim is a write or given up; later ones may still come in between."""
        claims, void = self._claims()
        there = self._segments()
        open_ = [c for c in claims if c > state.flushed and c not in there and c not in void]
        return min(open_) - 1 if open_ else max([*there, state.flushed])

    def log(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """The entries with a higher seq, up to one if given; other segments aren't read."""
        paths = [f"{self.path}/log/{name}" for seq, (name, _) in self._segments().items() if seq > after and (upto is None or seq <= upto)]
        if not paths:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*paths)

    def log_sizes(self) -> dict:
        """What waits in the log: its writes and their rows, and the rows among them that are deletes."""
        state = self.state()
        waiting = {s: r for s, (_, r) in self._segments().items() if s > state.flushed}
        gone = self.log(state.flushed).where("kind = 'DELETE'").count() if waiting else 0
        return {"segments": len(waiting), "rows": sum(waiting.values()), "deletes": gone}

    def _parts(self, name: str, schema, state: State) -> DataFrame:
        """`name` of all parts in force; retired buckets are partitions that the scan leaves out."""
        if not state.parts:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}")
        rows = read.parquet(*[f"{self.path}/{name}/part={n}" for n in state.parts]).select(*schema.names)
        return rows.where(~F.col("bucket_id").isin(list(state.retired))) if state.retired else rows

    def base(self, state: State | None = None) -> DataFrame:
        """(id, seq, embedding, bucket_id) of the base's rows that later flushes haven't hidden."""
        state = state or self.state()
        return self._shown(self._parts("rows", BASE, state), state)

    def _shown(self, rows: DataFrame, state: State) -> DataFrame:
        if not state.deletes:
            return rows
        hidden = self.spark.read.schema("id long, seq long").parquet(*[f"{self.path}/deletes/{n}" for n in state.deletes]).groupBy("id").agg(F.max("seq").alias("__until"))
        return rows.join(hidden, "id", "left").where("__until is null or seq >= __until").select(*rows.columns)

    def centroids(self, snapshot: int | None = None) -> DataFrame:
        return self._table("centroids", CENTROIDS, snapshot)

    # --- Writes ---

    def _append(self, rows: DataFrame, kind: str, seen: Observation) -> int:
        """One acknowledged write, in one pass over rows: a segment appears by a rename once all its rows are sound."""
        seq = self._claim()
        numbered = rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), F.lit(seq).cast("long").alias("tx_id"), "id", "embedding")
        pending = f"{self.name}/pending/{uuid.uuid4().hex}"
        try:
            numbered.write.parquet(f"{self.files.root}/{pending}")
            n, wrong = seen.get["n"], seen.get["bad"]
            if n and not wrong:
                self.files.rename(pending, f"{self.name}/log/{seq:020d}-{n:020d}")
        except BaseException:
            self.files.create(f"{self.name}/claims/{seq:020d}-void")
            raise
        if not n or wrong:
            self.files.create(f"{self.name}/claims/{seq:020d}-void")
            self.files.delete(pending)
            if n:
                raise InvalidInput(f"{wrong} rows lack an id or {self.dim} numbers")
            return 0
        if seq in self._claims()[1]:  # given up by a sweep meanwhile: a flush may have passed it
            self.files.delete(f"{self.name}/log/{seq:020d}-{n:020d}")
            raise OSError("this write took longer than a sweep waits; it isn't part of the collection")
        self.counters[f"{kind.lower()}s"] += n
        if self.rotate and self.log_sizes()["rows"] >= self.rotate:
            self.flush()
        return n

    def insert(self, rows: DataFrame) -> int:
        """Upsert rows (id, embedding) and say how many; an id twice in a batch keeps one of its rows, the greatest vector."""
        seen = Observation()
        one = checked(rows, self.dim, seen).groupBy("id").agg(F.max("embedding").alias("embedding"))
        return self._append(one, "INSERT", seen)

    def delete(self, ids: DataFrame) -> int:
        """Delete rows by id (id); ids that aren't there do nothing."""
        seen = Observation()
        gone = ids.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("embedding")).distinct()
        return self._append(gone.observe(seen, F.count("*").alias("n"), F.sum(F.col("id").isNull().cast("int")).alias("bad")), "DELETE", seen)

    def train(self, rows: DataFrame, buckets: int | None = None, seed: int = 0, batch: int | None = None) -> int:
        """Bulk load; with `buckets`, cluster all rows afresh into so many, by mini-batches of `batch` rows if given."""
        n = self.insert(rows)
        if buckets:
            self.flush()
            self._cluster(buckets, seed, batch)
        return n

    @_retried
    def _cluster(self, buckets: int, seed: int, batch: int | None) -> None:
        state = self.state()
        base = self.base(state)
        centres = cluster.kmeans(base, buckets, self.dim, self.metric, seed=seed, batch=batch)
        first = max([b for b, _ in state.temperature] + list(state.retired), default=0) + 1
        made = self._table_of(centres, first)
        placed = routing.place(base, made, self.dim, self.metric).drop("distance")
        self._publish(placed, State(snapshot=state.snapshot, flushed=state.flushed, temperature=state.temperature), state)

    def _table_of(self, centres: np.ndarray, first: int) -> DataFrame:
        return self.spark.createDataFrame([(first + i, [float(x) for x in c], 0) for i, c in enumerate(centres)], CENTROIDS)

    @_retried
    def adopt(self, rows: DataFrame) -> None:
        """Make rows (id, embedding, bucket_id) the base as they are, in place of all there was."""
        before, seq = self.state(), self._claim()
        self.files.create(f"{self.name}/claims/{seq:020d}-void")
        if not rows.where(bad(self.dim) | F.col("bucket_id").isNull()).isEmpty():
            raise InvalidInput(f"rows need an id, a bucket and {self.dim} numbers")
        kept = rows.select(F.col("id").cast("long"), F.lit(seq).cast("long").alias("seq"), F.col("embedding").cast("array<float>"), F.col("bucket_id").cast("int"))
        self._publish(kept, State(snapshot=before.snapshot, flushed=seq), before)

    # --- Reads ---

    def live(self, upto: int | None = None) -> DataFrame:
        """(id, seq, embedding) of all live rows: base and log as one, the highest seq of an id decides.

        With upto, as it was after the write of that seq, unless a vacuum has dropped what that takes.
        """
        state = self.state(upto)
        entries = self.base(state).select("seq", F.lit("INSERT").alias("kind"), "id", "embedding").unionByName(self.log(state.flushed, upto).select("seq", "kind", "id", "embedding"))
        return oplog.replay(entries)

    def known(self, state: State) -> DataFrame | routing.Centroids:
        """The centroids of a state's snapshot, kept on the driver unless they are too many."""
        if self._known is None or self._known[0] != state.snapshot:
            table = self.centroids(state.snapshot)
            if len(state.temperature) * self.dim * 8 > routing.BROADCAST_BYTES:
                return table
            self._known = state.snapshot, routing.Centroids(table, self.dim)
        return self._known[1]

    def search(self, queries: DataFrame, k: int = 10, target: float | None = None, decay: float | None = None, density: float | None = None, exact: bool = False, two_stage: bool = False) -> DataFrame:
        """(query_id, rank, id, score): the base by routed buckets, the log in full, merged; None means the default.

        Rows of the base that the log replaces or deletes are left out before they are scored. two_stage takes
        candidates by codes first and reads only their vectors. Buckets that are read are touched at the next tick.
        """
        if k < 1:
            raise InvalidInput("k must be 1 or more")
        state = self.state()
        fresh = self.log(state.flushed) if max(self._segments(), default=0) > state.flushed else None
        try:
            asked = search.gathered(queries, self.dim)
            found = None
            if fresh is not None or not state.snapshot:
                delta = oplog.replay((fresh if fresh is not None else self.log(state.flushed)).select("seq", "kind", "id", "embedding"))
                found = search.knn(delta.select("id", "embedding"), asked, k, self.dim, self.metric)
            if state.snapshot:
                base = self.base(state) if self.hot is None else self.hot.over(self.base(state), state.snapshot)
                base = base if fresh is None else search.live(base, fresh)
                routes = None if exact else self._routes(state, target, decay, density)
                if two_stage:
                    coded = self.codes(state) if fresh is None else search.live(self.codes(state), fresh)
                    near = search.two_stage(coded, self.quantizers(state.snapshot), base, asked, k, self.dim, self.metric, routes)
                else:
                    near = search.knn(base, asked, k, self.dim, self.metric, routes)
                found = near if found is None else search.merged(found.unionByName(near), k)
        except ValueError as e:
            raise InvalidInput(str(e)) from None
        self.counters["searches"] += 1
        return found

    def _routes(self, state: State, target: float | None, decay: float | None, density: float | None):
        options = [d if x is None else x for x, d in ((target, routing.TARGET), (decay, routing.DECAY), (density, routing.DENSITY))]

        def routes(queries):
            return routing.select_buckets(queries, self.known(state), self.dim, self.metric, *options)

        def seen(buckets):
            self._touched.update(buckets)
            if self.hot is not None:
                known = self.known(state)
                sizes = dict(zip(known.ids.tolist(), known.n.astype(int).tolist())) if isinstance(known, routing.Centroids) else {}
                self.hot.ask(buckets, self.base(state), sizes)

        routes.seen = seen
        return routes

    def keep_hot(self, buckets: int, rows: int) -> None:
        """From now on, hold up to so many buckets and rows that searches ask for; 0 buckets: none."""
        if self.hot is not None:
            self.hot.over(self.base(), -1)
        self.hot = HotBuckets(buckets, rows) if buckets else None

    def _table(self, name: str, schema, snapshot: int | None) -> DataFrame:
        n = self.state().snapshot if snapshot is None else snapshot
        return self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{n}/{name}") if n else self.spark.createDataFrame([], schema)

    def codes(self, state: State | None = None) -> DataFrame:
        """(id, seq, codes, bucket_id) of the base's rows."""
        state = state or self.state()
        return self._shown(self._parts("codes", CODES, state), state)

    def quantizers(self, snapshot: int | None = None) -> DataFrame:
        """(bucket_id, low, high, step) of a snapshot."""
        return self._table("quantizers", QUANTIZERS, snapshot)

    def locate(self, ids: DataFrame) -> DataFrame:
        """(id, tier, bucket_id) of live rows among ids (id); rows in the log have no bucket yet."""
        state = self.state()
        wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
        fresh = self.log(state.flushed)
        delta = oplog.replay(fresh.select("seq", "kind", "id", "embedding")).select("id", F.lit("delta").alias("tier"), F.lit(None).cast("int").alias("bucket_id"))
        base = search.live(self.base(state).select("id", "bucket_id"), fresh).select("id", F.lit("base").alias("tier"), "bucket_id")
        return wanted.join(delta.unionByName(base), "id")

    def verify(self, on_mismatch: str = "fail", most: int = 0) -> list[str]:
        """Files in force that are missing, or differ in size or checksum from what their commit recorded.

        on_mismatch "fail" raises over more than `most`, "warn" returns them all.
        """
        if on_mismatch not in ("fail", "warn"):
            raise InvalidInput("on_mismatch is fail or warn")
        state, wrong = self.state(), []
        for n in sorted({*state.parts, *state.deletes, state.snapshot} - {0}):
            said = json.loads(self.files.read(f"{self.name}/files/{n}.json"))
            there = self._made(n)
            kinds = [k for k, kept in (("rows/", state.parts), ("codes/", state.parts), ("deletes/", state.deletes), ("snapshots/", (state.snapshot,))) if n in kept]
            wrong += [k for k in said.keys() | there.keys() if k.startswith(tuple(kinds)) and said.get(k) != there.get(k)]
        if len(wrong) > most and on_mismatch == "fail":
            raise OSError(f"{len(wrong)} files of {self.name} differ from its commit: {sorted(wrong)[:3]}")
        return sorted(wrong)

    # --- Maintenance ---

    def _publish(self, rows: DataFrame, state: State, before: State, hidden: DataFrame | None = None) -> None:
        """Append a part of rows (id, seq, embedding, bucket_id) to `state` and put it in force after `before`."""
        n = max(self._last("snapshots"), self._last("numbers")) + 1
        while not self.files.create(f"{self.name}/numbers/{n:020d}"):
            n += 1
        rows.select("id", "seq", "embedding", "bucket_id").hint("rebalance", "bucket_id").write.partitionBy("bucket_id").parquet(f"{self.path}/rows/part={n}")
        written = self._parts("rows", BASE, State(parts=(n,)))
        known = self.quantizers(state.snapshot) if state.parts else self.quantizers(0)
        fresh = sq8.train(written.join(F.broadcast(known.select("bucket_id")), "bucket_id", "left_anti"), self.dim)  # known: a row a bucket
        known.unionByName(fresh).write.parquet(f"{self.path}/snapshots/{n}/quantizers")
        coded = written.join(self.quantizers(n), "bucket_id").select("id", "seq", sq8.encode("embedding", "low", "step").alias("codes"), "bucket_id")
        coded.write.partitionBy("bucket_id").parquet(f"{self.path}/codes/part={n}")
        totals = maintain.sums(written)
        if state.parts:
            kept = self._table("totals", TOTALS, state.snapshot)
            totals = totals.unionByName(kept.where(~F.col("bucket_id").isin(list(state.retired))) if state.retired else kept)
        if hidden is not None:
            hidden.write.parquet(f"{self.path}/deletes/{n}")
            totals = totals.unionByName(self._hidden_sums(self.spark.read.schema("id long, seq long").parquet(f"{self.path}/deletes/{n}"), before))
            state = replace(state, deletes=(*state.deletes, n))
        totals = totals.groupBy("bucket_id", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        totals.write.parquet(f"{self.path}/snapshots/{n}/totals")
        maintain.means(self._table("totals", TOTALS, n)).write.parquet(f"{self.path}/snapshots/{n}/centroids")
        made = self._table("anchors", CENTROIDS, state.snapshot if state.parts else 0)
        found = self._table("centroids", CENTROIDS, n)
        made.unionByName(found.join(made.select("bucket_id"), "bucket_id", "left_anti")).write.parquet(f"{self.path}/snapshots/{n}/anchors")
        state = replace(state, snapshot=n, parts=(*state.parts, n))
        self.files.write(f"{self.name}/files/{n}.json", json.dumps(self._made(n)))
        heat = dict(state.temperature)
        buckets = [r["bucket_id"] for r in self.centroids(n).select("bucket_id").collect()]  # a row a bucket
        self._commit(replace(state, temperature=tuple(sorted((b, heat.get(b, maintain.START)) for b in buckets))), before)

    def _hidden_sums(self, hidden: DataFrame, before: State) -> DataFrame:
        """Sums to take away: those of the base's rows that `hidden` (id, seq) hides from now on, of whose buckets alone vectors are read."""
        gone = hidden.groupBy("id").agg(F.max("seq").alias("__until"))
        affected = [r[0] for r in self.base(before).select("id", "seq", "bucket_id").join(gone, "id").where("seq < __until").select("bucket_id").distinct().collect()]
        if not affected:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.base(before).where(F.col("bucket_id").isin(affected)).join(gone, "id").where("seq < __until")
        return maintain.sums(rows).select("bucket_id", "pos", (-F.col("total")).alias("total"), (-F.col("n")).alias("n"))

    def _made(self, n: int) -> dict:
        """Size and checksum of each file of publication n that can be read, the checksums by Spark's tasks."""
        out = {}
        for folder in (f"rows/part={n}", f"codes/part={n}", f"deletes/{n}", f"snapshots/{n}"):
            sizes = {k: v for k, v in self.files.sizes(f"{self.name}/{folder}").items() if k.endswith(".parquet")}
            if sizes:
                read = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").load(f"{self.path}/{folder}")
                for r in read.select("path", "length", F.crc32("content").alias("crc")).collect():  # a row a file
                    out[f"{folder}/{unquote(r['path']).partition(f'/{self.name}/{folder}/')[2]}"] = [r["length"], r["crc"]]
        return out

    @_retried
    def flush(self, bootstrap: bool = False) -> bool:
        """Move the log into the base as a new part, each row to its nearest bucket. False: nothing to do.

        A first flush puts all rows into one bucket; with bootstrap, into as many as their number needs.
        """
        state = self.state()
        top = self._settled(state)
        if top <= state.flushed:
            return False
        fresh = self.log(state.flushed, top)
        delta = oplog.replay(fresh.select("seq", "kind", "id", "embedding"))
        known = self.known(state) if state.snapshot else self.centroids(0)
        if bootstrap and not state.snapshot and (n := delta.count()) > self.capacity:
            known = self._table_of(cluster.kmeans(delta, math.ceil(n / self.capacity), self.dim, self.metric, batch=self.capacity), 1)
        placed = routing.place(delta, known, self.dim, self.metric).drop("distance")
        hidden = fresh.groupBy("id").agg(F.max("seq").alias("seq")) if state.parts else None
        self._publish(placed, replace(state, flushed=top), state, hidden)
        self.counters["flushes"] += 1
        return True

    @_retried
    def compact(self) -> None:
        """Write the base anew without hidden rows, in as few files as it needs."""
        state = self.state()
        self._publish(self.base(state), State(snapshot=state.snapshot, flushed=state.flushed, temperature=state.temperature), state)

    def stats(self) -> DataFrame:
        """(bucket_id, total, dead, temperature, shift, urgency, action) of the base under the log's writes.

        total and shift come from the snapshot: how far a bucket's mean has moved since it was made. Only if writes
        wait in the log are the base's ids read, for the dead.
        """
        state = self.state()
        heat = self.spark.createDataFrame(list(state.temperature), "bucket_id int, temperature double")
        made = self._table("anchors", CENTROIDS, state.snapshot).select("bucket_id", F.col("centroid").alias("made"))
        gap = F.sqrt(F.aggregate(F.zip_with("centroid", "made", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))
        out = self.centroids(state.snapshot).join(made, "bucket_id").join(heat, "bucket_id").select("bucket_id", F.col("n").alias("total"), "temperature", gap.alias("shift"))
        dead = self.spark.createDataFrame([], "bucket_id int, dead long")
        if self.log_sizes()["segments"]:
            gone = self.log(state.flushed).select("id").distinct()
            dead = self.base(state).select("id", "bucket_id").join(gone, "id").groupBy("bucket_id").agg(F.count("*").alias("dead"))
        out = out.join(dead, "bucket_id", "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))
        return maintain.decide(out, self.capacity)

    def touch(self, buckets: list[int]) -> None:
        """Warm buckets; one that stands twice is warmed twice."""
        self._warm(Counter(buckets))

    def _warm(self, touched: Counter, cool: float = 1.0) -> None:
        while True:
            state = self.state()
            warm = tuple((b, (1 - (1 - t) * (1 - maintain.TOUCH) ** touched[b]) * cool) for b, t in state.temperature)
            after = replace(state, version=state.version + 1, temperature=warm)
            if self.files.create(f"{self.name}/states/{after.version:020d}", json.dumps(asdict(after))):
                return

    def maintain(self) -> str:
        """One tick: warm what searches have read, cool all buckets, then split or dissolve the first that needs it.

        Says what was done.
        """
        touched, self._touched = self._touched, Counter()
        self._warm(touched, maintain.COOL)
        due = self.stats().where("action <> 'none'").orderBy("bucket_id").limit(1).collect()
        if not due:
            return "none"
        return self.split(due[0]["bucket_id"]) if due[0]["action"] == "split" else self.merge(due[0]["bucket_id"])

    @_retried
    def split(self, bucket: int, loopback: float | None = None) -> str:
        """Two buckets for one; rows much nearer to another bucket go there. A bucket's capacity bounds what is gathered.

        With loopback, the other way: fewer rows are enough, and at most that share of them leaves, smallest ids first.
        """
        state = self.state()
        base = search.live(self.base(state), self.log(state.flushed))
        own = base.where(F.col("bucket_id") == bucket)
        n = own.count()
        if n < (cluster.SPLIT_ROWS if loopback is None else cluster.VARIANT_ROWS):
            return "skipped: too small"
        halves = self._halves(own, n)
        if block_scores(self.metric, halves[:1], halves[1:])[0, 0] < cluster.SINGULAR:
            return "skipped: singular"
        known = routing.Centroids(self.centroids(state.snapshot), self.dim)
        moved = cluster.divided(own.drop("bucket_id"), halves, known.points[known.ids != bucket], self.metric)
        if loopback is not None:
            moved = moved.drop("defects").join(cluster.capped(moved.select("id", "half", "defects"), loopback).select("id", "defects"), "id")
        first = int(max([*known.ids, *state.retired])) + 1
        columns = ["id", "seq", "embedding", "bucket_id"]
        stay = moved.where("not defects").withColumn("bucket_id", (F.col("half") + first).cast("int"))
        leave = routing.place(moved.where("defects").select("id", "seq", "embedding"), known, self.dim, self.metric, apart=bucket)
        self._publish(stay.select(*columns).unionByName(leave.select(*columns)), replace(state, retired=(*state.retired, bucket)), state)
        self.counters["splits"] += 1
        return f"split {bucket}"

    def _halves(self, own: DataFrame, n: int) -> np.ndarray:
        if n <= 4 * self.capacity:
            return cluster.two_means(matrix(own.orderBy("id").select("embedding").toArrow().column("embedding"), self.dim), self.metric)
        return cluster.kmeans(own, 2, self.dim, self.metric)

    @_retried
    def merge(self, bucket: int) -> str:
        """Dissolve a bucket: each row goes to its nearest other one."""
        state = self.state()
        base = search.live(self.base(state), self.log(state.flushed))
        own = base.where(F.col("bucket_id") == bucket)
        n = own.count()
        if n > maintain.SCATTER_ROWS:
            return "skipped: too large"
        if n and len(state.temperature) < 2:
            return "skipped: no other bucket"
        moved = routing.place(own.drop("bucket_id"), self.known(state), self.dim, self.metric, apart=bucket).drop("distance")
        self._publish(moved, replace(state, retired=(*state.retired, bucket)), state)
        self.counters["merges"] += 1
        return f"merge {bucket}"

    def vacuum(self, sweep_after: float = 86_400) -> list[str]:
        """Drop parts, deletes, snapshots and states not in force, and log segments that the base includes.

        Writes that began more than sweep_after seconds ago and never came are given up. What can't be deleted now
        stays for the next time.
        """
        state = self.state()
        claims, void = self._claims()
        there = self._segments()
        for seq in claims - void - set(there):
            if seq > state.flushed and self.files.age(f"{self.name}/claims/{seq:020d}") > sweep_after:
                self.files.create(f"{self.name}/claims/{seq:020d}-void")
        used = {"rows": state.parts, "codes": state.parts, "deletes": state.deletes, "snapshots": (state.snapshot,)}
        gone = [f"{kind}/{n}" for kind, kept in used.items() for n in self.files.names(f"{self.name}/{kind}") if int(n.removeprefix("part=")) not in kept and int(n.removeprefix("part=")) <= state.snapshot]
        gone += [f"files/{n}" for n in self.files.names(f"{self.name}/files") if (k := int(n.split(".")[0])) <= state.snapshot and k not in {*state.parts, *state.deletes, state.snapshot}]
        gone += [f"states/{n}" for n in self.files.names(f"{self.name}/states") if n.isdigit() and int(n) < state.version]
        gone += [f"log/{name}" for seq, (name, _) in there.items() if seq <= state.flushed]
        gone += [f"claims/{n}" for n in self.files.names(f"{self.name}/claims") if n.split("-")[0].isdigit() and int(n.split("-")[0]) <= state.flushed]
        gone += [f"pending/{n}" for n in self.files.names(f"{self.name}/pending") if self.files.age(f"{self.name}/pending/{n}") > sweep_after]
        out = []
        for name in gone:
            try:
                self.files.delete(f"{self.name}/{name}")
                out.append(name)
            except Py4JJavaError:
                self.counters["failed_deletes"] += 1
        return out

    def metrics(self) -> dict:
        state = self.state()
        waiting = self.log_sizes()
        rows = self._table("totals", TOTALS, state.snapshot).where("pos = 0").agg(F.sum("n")).first()[0] if state.snapshot else 0
        return {"snapshot": state.snapshot, "version": state.version, "flushed": state.flushed, "log_segments": waiting["segments"], "log_entries": waiting["rows"], "buckets": len(state.temperature), "base_rows": rows or 0, **self.counters}

    def exposition(self) -> str:
        """metrics() in the text format that collectors of metrics read."""
        return "".join(f'vecmesh_{k}{{collection="{self.name}"}} {v}\n' for k, v in sorted(self.metrics().items()))
