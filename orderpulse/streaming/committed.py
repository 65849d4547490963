"""Tables that micro-batches write together, made visible by one commit per batch.

A batch writes its rows of each table to a folder of its own and then one small commit file that names the folders.
Readers take the folders from the commits, so before the commit they see nothing of the batch and after it
all of it, in every table; a batch that is replayed after its commit changes nothing, and one replayed before it
overwrites its folders.  The commit file is one file written by one task, which its job moves into place at once.

Compaction merges the committed folders of a table into one (a sum, the latest row of a key, or all rows) and
commits that in the same way.  Readers then start from it; the folders it stands for stay until their
owner removes them (``superseded``), so readers that began earlier still find them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "_batch"
_ENTRY = "kind string, upto long, tables array<struct<name:string,path:string,schema:string>>"


class CommittedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _entries(self) -> list:
        """The commits, in order; a few bytes for each batch."""
        try:
            log = self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").json(f"{self.root}/commits")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(log.collect(), key=lambda r: (r.upto, r.kind))

    def _record(self, name: str, kind: str, upto: int, tables: dict[str, tuple[str, str]]) -> None:
        row = (kind, upto, [(t, path, schema) for t, (path, schema) in sorted(tables.items())])
        self.spark.createDataFrame([row], _ENTRY).coalesce(1).write.mode("overwrite").json(f"{self.root}/commits/{name}")

    def batches(self) -> list[int]:
        return [e.upto for e in self._entries() if e.kind == "batch"]

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> dict[str, tuple[str, str]]:
        """The folders of a batch, not visible yet."""
        done = {}
        for name, df in tables.items():
            path = f"{self.root}/{name}/batch-{batch_id}"
            rows = df.withColumn(BATCH, F.lit(batch_id).cast("long"))
            rows.write.mode("overwrite").parquet(path)
            done[name] = (path, rows.schema.json())
        return done

    def commit(self, batch_id: int, tables: dict[str, DataFrame]) -> bool:
        """Write a batch and make it visible; False if that has been done before."""
        if batch_id in self.batches():
            return False
        self._record(f"batch-{batch_id}", "batch", batch_id, self.write(batch_id, tables))
        return True

    def _folders(self, name: str, before: int | None) -> list[tuple[str, str]]:
        """(path, schema) of what a reader takes: the last compaction, and the batches after it."""
        entries = [(e.kind, e.upto, t) for e in self._entries() for t in e.tables if t.name == name and (before is None or e.upto < before)]
        start = max((u for kind, u, _ in entries if kind == "compact"), default=None)
        return [(t.path, t.schema) for kind, u, t in entries if (kind == "compact" and u == start) or (kind == "batch" and (start is None or u > start))]

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """The committed rows of a table (of batches below ``before``), with their batch in ``_batch``; None if there are none."""
        folders = self._folders(name, before)
        if not folders:
            return None
        return self.spark.read.schema(T.StructType.fromJson(_json(folders[-1][1]))).parquet(*(p for p, _ in folders))

    def compact(self, name: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
        """Merge all committed rows of a table into one folder; ``merge`` keeps the columns.  Gives the last batch
        that it holds, or None when there was nothing to merge."""
        done = self.batches()
        if len(self._folders(name, None)) < 2:
            return None
        rows = merge(self.read(name))
        path = f"{self.root}/{name}/upto-{done[-1]}"
        rows.write.mode("overwrite").parquet(path)
        self._record(f"{name}-upto-{done[-1]}", "compact", done[-1], {name: (path, rows.schema.json())})
        return done[-1]

    def superseded(self, name: str) -> list[str]:
        """Folders that no new reader takes."""
        now = {p for p, _ in self._folders(name, None)}
        return [t.path for e in self._entries() for t in e.tables if t.name == name and t.path not in now]


def _json(text: str) -> dict:
    import json
    return json.loads(text)


def latest(key: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: the row of a key's last batch."""
    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.col(BATCH)).alias("last"))
        return last.select("last.*")
    return merge


def summed(keys: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: numbers added up by ``keys``."""
    def merge(rows: DataFrame) -> DataFrame:
        sums = [F.max(BATCH).alias(BATCH) if c == BATCH else F.sum(c).alias(c) for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(*sums).select(*rows.columns)
    return merge
