"""A table that grows by batches of events, with a ledger of the events that each batch holds.

Layout: ``<path>/_batch=<n>`` holds the rows of batch n, ``<path>/_ledger/ids/_batch=<n>`` its event ids,
and the empty file ``<path>/_ledger/commits/<n>`` says that both are whole. The commit is written last. A
batch without one is what a failed run left behind; the next run removes it before it begins. So a
run reads one id per event, never the rows, and half a batch never counts as done. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwave.operators import events

BATCH = "_batch"


class Ledger:
    """The batches stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.ids = f"{path}/_ledger/ids"
        self.commits = f"{path}/_ledger/commits"

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return [status.getPath().getName() for status in fs.listStatus(where)] if fs.exists(where) else []

    def _batches(self, path: str) -> set[int]:
        return {int(n.removeprefix(f"{BATCH}=")) for n in self._names(path) if n.startswith(f"{BATCH}=")}

    def committed(self) -> set[int]:
        return {int(n) for n in self._names(self.commits) if n.isdigit()}

    def remove_unfinished(self) -> None:
        """Delete the rows and ids of batches without a commit."""
        done = self.committed()
        for folder in (self.path, self.ids):
            for batch in self._batches(folder) - done:
                where, fs = self._at(f"{folder}/{BATCH}={batch}")
                fs.delete(where, True)

    def adopt(self) -> None:
        """Make a table stored without a ledger batch 0. Ids and commit come first, so an interrupted
        move goes on with the next run.
        """
        loose = [n for n in self._names(self.path) if n[0] not in "_."]
        if not loose:
            return
        if 0 not in self.committed():
            stored = self.spark.read.parquet(self.path).select("event_id").distinct()
            stored.write.mode("overwrite").parquet(f"{self.ids}/{BATCH}=0")
            self.commit(0)
        folder, fs = self._at(f"{self.path}/{BATCH}=0")
        fs.mkdirs(folder)
        for name in loose:
            fs.rename(self._at(f"{self.path}/{name}")[0], self._at(f"{self.path}/{BATCH}=0/{name}")[0])

    def processed(self) -> DataFrame | None:
        """Ids of all events of committed batches, NULL if there is no batch."""
        folders = [f"{self.ids}/{BATCH}={b}" for b in sorted(self.committed())]
        return self.spark.read.parquet(*folders).select("event_id") if folders else None

    def commit(self, batch: int) -> None:
        where, fs = self._at(f"{self.commits}/{batch}")
        fs.create(where, False).close()

    def append(self, found: DataFrame, build: Callable[[DataFrame], DataFrame]) -> int:
        """Run ``build`` on the events of ``found`` that no batch holds, as a batch of their own; how many they were.

        Event ids are written first and read back, so that the rows and the ledger hold the same
        events however often ``found`` is evaluated.
        """
        self.adopt()
        self.remove_unfinished()
        batch = max(self.committed(), default=-1) + 1
        done = self.processed()
        fresh = found if done is None else events.unprocessed(found, done)
        place = f"{self.ids}/{BATCH}={batch}"
        fresh.select("event_id").distinct().write.mode("overwrite").parquet(place)
        ids = self.spark.read.schema(found.select("event_id").schema).parquet(place)
        count = ids.count()
        if count:
            build(found.join(ids, "event_id", "left_semi")).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch}")
            self.commit(batch)
        else:
            self.remove_unfinished()
        return count

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        return self.spark.read.parquet(*[f"{self.path}/{BATCH}={b}" for b in sorted(self.committed())])
