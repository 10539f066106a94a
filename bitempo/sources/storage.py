"""A store on disk: versioned folders of Parquet tables and a pointer to the one that holds.

A commit writes a whole new version and then a numbered state file, under a name of its
own and moved into place; the highest number holds. State files and tables are never
changed, so readers need no lock: they see the old version or the new one. What is not
given is carried over by reference. Erasing is writing a version without the rows and
then dropping the versions before it. Writers take turns by a lock file, for which they
wait a while; one that a crash has left is taken over when it is older than `lease`.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from bitempo.operators.memory import SCHEMAS, Memory


class Snapshots:
    """All file access goes through the file system that Spark uses for the path."""

    def __init__(self, spark: SparkSession, path: str, wait: float = 5.0, lease: float = 3600.0):
        self.spark, self.path, self.wait, self.lease = spark, path.rstrip("/"), wait, lease
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        folder = self._path(f"{self.path}/states")
        if not self.fs.exists(folder):
            return {"version": 0, "tables": {}, "batches": []}
        numbers = [int(s.getPath().getName().removesuffix(".json")) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return {"version": 0, "tables": {}, "batches": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/states/{max(numbers)}.json").collect()))

    def shape(self) -> tuple[int, str] | None:
        """Dimension and metric of the stored vectors."""
        found = self._state().get("shape")
        return (found[0], found[1]) if found else None

    def open(self, dim: int, metric: str) -> Memory:
        """The memory; an empty one where nothing is stored. Another dimension or metric than the stored one is refused here, not at the first search."""
        if self.shape() not in (None, (dim, metric)):
            raise ValueError(f"the store has vectors of another shape: {self.shape()}")
        empty = Memory.empty(self.spark, dim, metric)
        state = self._state()["tables"]
        return replace(empty, **{n: self.spark.read.parquet(state[n]) for n in SCHEMAS if n in state})

    def save(self, memory: Memory, batch: int | None = None) -> int:
        return self.commit(memory.tables, batch, memory.index_shape())

    def _lock(self):
        """The lock file, held: tries again after 1 ms, 2 ms, ... up to 50 ms, for as long as `wait`."""
        lock, pause, until = self._path(f"{self.path}/lock"), 0.001, time.monotonic() + self.wait
        self.fs.mkdirs(self._path(self.path))
        while not self.fs.createNewFile(lock):
            if self.fs.exists(lock) and time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000 > self.lease:
                self.fs.delete(lock, False)
                continue
            if time.monotonic() >= until:
                raise RuntimeError(f"another writer has held the store for more than {self.wait} s; nothing was written")
            time.sleep(pause)
            pause = min(2 * pause, 0.05)
        return lock

    def tables(self) -> list[str]:
        return sorted(self._state()["tables"])

    def batches(self) -> set[int]:
        """Micro-batches that were committed."""
        return set(self._state()["batches"])

    def read(self, name: str) -> DataFrame | None:
        where = self._state()["tables"].get(name)
        return None if where is None else self.spark.read.parquet(where)

    def commit(self, tables: dict[str, DataFrame], batch: int | None = None, shape: tuple[int, str] | None = None) -> int:
        """Write the tables as a new version; a failure leaves the store as it was."""
        lock = self._lock()
        try:
            state = self._state()
            version = state["version"] + 1
            folder = f"v{version}-{uuid.uuid4().hex[:8]}"
            for name, df in tables.items():
                where = f"{self.path}/{folder}/{name}"
                try:
                    df.write.parquet(where)
                except Exception as e:
                    raise RuntimeError(f"{name} was not written") from e
                state["tables"][name] = where
            state["version"] = version
            state["batches"] += [] if batch is None else [batch]
            if shape is not None:
                state["shape"] = list(shape)
            self._point(version, json.dumps(state))
        finally:
            self.fs.delete(lock, False)
        return version

    def _point(self, version: int, text: str) -> None:
        """The state file of a version, whole before it has its name."""
        fresh, pointer = self._path(f"{self.path}/states/{version}.part"), self._path(f"{self.path}/states/{version}.json")
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(pointer) or not self.fs.rename(fresh, pointer):
            raise RuntimeError("the version exists already")

    def drop_old(self) -> None:
        """Delete the versions that nothing points to, so that what was erased is gone."""
        state = self._state()
        held = {w.rsplit("/", 2)[-2] for w in state["tables"].values()}
        for s in self.fs.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name.startswith("v") and name not in held:
                self.fs.delete(s.getPath(), True)
