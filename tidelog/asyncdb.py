"""The table's calls as futures: Spark jobs may be submitted from several threads at once."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

from tidelog.batch import WriteBatch
from tidelog.snapshot import Snapshot
from tidelog.store import Database


class AsyncDatabase:
    """Reads run side by side; writes and compactions take turns on lanes of their own, so reads never wait for them."""

    def __init__(self, db: Database, readers: int = 4):
        self.db = db
        self._reads = ThreadPoolExecutor(readers, "tidelog-read")
        self._writes = ThreadPoolExecutor(1, "tidelog-write")
        self._compactions = ThreadPoolExecutor(1, "tidelog-compact")

    @classmethod
    def open_async(cls, spark: SparkSession, path: str, **options) -> Future[AsyncDatabase]:
        pool = ThreadPoolExecutor(1, "tidelog-open")
        made = pool.submit(lambda: cls(Database.open(spark, path, **options)))
        pool.shutdown(wait=False)
        return made

    def put_async(self, key, value) -> Future[int]:
        return self._writes.submit(self.db.put, key, value)

    def delete_async(self, key) -> Future[int]:
        return self._writes.submit(self.db.delete, key)

    def write_async(self, batch: WriteBatch) -> Future[int]:
        return self._writes.submit(self.db.write, batch)

    def get_async(self, key, snapshot: Snapshot | None = None) -> Future:
        return self._reads.submit(self.db.get, key, snapshot)

    def multi_get_async(self, keys, snapshot: Snapshot | None = None) -> Future[list]:
        return self._reads.submit(lambda: self.db.multi_get(keys, snapshot).collect())

    def compact_async(self, **options) -> Future[bool]:
        return self._compactions.submit(lambda: self.db.compact(**options))

    def snapshot(self) -> Snapshot:
        return self.db.snapshot()

    def close(self) -> None:
        """Waits for what has been submitted, then closes the table."""
        for pool in (self._writes, self._compactions, self._reads):
            pool.shutdown(wait=True)
        self.db.close()
