"""State of ``foreachBatch`` handlers as Parquet files.

A ``BatchTable`` is one snapshot plus the deltas of the batches since, and a
small marker file per batch that names them. A batch writes its files under a
new name and then its marker, which commits them; the state that batch ``n``
builds on is the newest marker below ``n``. So a batch that runs again starts
from the same state and its marker replaces the first one: nothing is counted
twice. After ``every`` deltas the next commit writes a new snapshot, so a
reader opens one snapshot and fewer than ``every`` deltas however many batches
have run. What neither the last two markers name is removed; Spark only ever
repeats the last batch.

A table belongs to the checkpoint of its stream.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERY = 8


class BatchTable:
    """Rows written batch by batch. ``merge`` reduces the rows of several
    batches to the current ones and keeps all columns, ``batch_id`` too;
    ``partition_by`` names columns whose values are folders, for pruned reads."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] = lambda d: d,
                 partition_by: Sequence[str] = (), every: int = EVERY):
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        self.partition_by, self.every = list(partition_by), every

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, start: str) -> list[str]:
        fs, path = self._fs("")
        if not fs.exists(path):
            return []
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith(start))

    def batches(self) -> list[int]:
        """Committed batches whose marker is still there."""
        return [int(n[7:-5]) for n in self._names("commit-")]

    def _marker(self, before: int | None = None) -> dict:
        """The newest marker (of the batches below ``before``)."""
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return {"files": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/commit-{known[-1]:019d}.json").first()[0])

    def files(self, before: int | None = None) -> list[str]:
        """Folders of the newest state (of the batches below ``before``)."""
        return self._marker(before)["files"]

    def _read(self, names: Sequence[str], schema: T.StructType) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{n}") for n in names])

    def rows(self, before: int | None = None) -> DataFrame | None:
        """Rows of the state as they were written, with ``batch_id``; None if
        there is none. Filters on ``partition_by`` columns open only their
        folders."""
        m = self._marker(before)
        return self._read(m["files"], T.StructType.fromJson(m["schema"])) if m["files"] else None

    def current(self) -> DataFrame | None:
        rows = self.rows()
        return None if rows is None else self.merge(rows)

    def _store(self, df: DataFrame, kind: str, batch_id: int) -> str:
        name = f"{kind}-{batch_id:019d}-{uuid.uuid4().hex}"
        if self.partition_by:  # one file per folder, not one per task and folder
            df = df.repartition(*self.partition_by)
        df.write.partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return name

    def commit(self, batch_id: int, delta: DataFrame) -> None:
        """Add the rows of one batch."""
        later = [b for b in self.batches() if b > batch_id]
        if later:
            raise RuntimeError(f"{self.path} holds batch {later[-1]}, the stream is at {batch_id}: it belongs to another checkpoint")
        delta = delta.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        names = self.files(before=batch_id) + [self._store(delta, "delta", batch_id)]
        if len(names) > self.every:
            names = [self._store(self.merge(self._read(names, delta.schema)).select(delta.columns), "snapshot", batch_id)]
        fs, path = self._fs(f"commit-{batch_id:019d}.json")
        _, new = self._fs(f"_new-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"files": names, "schema": delta.schema.jsonValue()}).encode()))
        out.close()
        if fs.exists(path):  # a batch that ran before: its marker is replaced
            fs.delete(path, False)
        if not fs.rename(new, path):
            raise RuntimeError(f"cannot commit batch {batch_id} in {self.path}")
        self._clean(batch_id)

    def _clean(self, batch_id: int) -> None:
        """Remove what neither this marker nor the one before it names."""
        known = [b for b in self.batches() if b <= batch_id]
        needed = {*self.files(), *self.files(before=batch_id)}
        old = [f"commit-{b:019d}.json" for b in known[:-2]]
        for name in old + [n for k in ("delta-", "snapshot-") for n in self._names(k) if n not in needed]:
            fs, path = self._fs(name)
            fs.delete(path, True)
