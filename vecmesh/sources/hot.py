"""Hot buckets of a collection, kept on the executors: which ones is decided by the queue cache, Spark's storage holds them."""

from __future__ import annotations

from threading import RLock

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.caches import QueueCache


class HotBuckets:
    """Up to `buckets` buckets with `rows` rows together, in memory or on the executors' disks.

    A bucket that was asked for often enough is read once, whoever asks at the same time; one that the cache gives up
    or that a later snapshot replaces is let go. A lost executor's share is read again from the files.
    """

    def __init__(self, buckets: int, rows: int):
        self.cache, self.rows = QueueCache(buckets), rows
        self.held: dict[int, tuple[DataFrame, int]] = {}
        self.snapshot, self.loads, self._lock = 0, 0, RLock()

    def ask(self, asked: list[int], base: DataFrame, sizes: dict[int, int]) -> None:
        """Note that buckets of base (..., bucket_id) are read, and hold those that the cache has. sizes: rows of each."""
        with self._lock:
            for b in asked:
                if not self.cache.get(b):
                    self.cache.put(b)
            kept = [*self.cache.main, *self.cache.small]
            for b in [b for b in self.held if b not in kept]:
                self._drop(b)
            room = self.rows - sum(n for _, n in self.held.values())
            for b in kept:
                n = sizes.get(b, 0)
                if b not in self.held and 0 < n <= room:
                    self.held[b] = base.where(F.col("bucket_id") == b).persist(StorageLevel.MEMORY_AND_DISK), n
                    self.loads, room = self.loads + 1, room - n

    def over(self, base: DataFrame, snapshot: int) -> DataFrame:
        """base, its hot buckets from where they are held."""
        with self._lock:
            if snapshot != self.snapshot:
                for b in list(self.held):
                    self._drop(b)
                self.snapshot = snapshot
            if not self.held:
                return base
            out = base.where(~F.col("bucket_id").isin(list(self.held)))
            for frame, _ in self.held.values():
                out = out.unionByName(frame)
            return out

    def _drop(self, bucket: int) -> None:
        self.held.pop(bucket)[0].unpersist()
