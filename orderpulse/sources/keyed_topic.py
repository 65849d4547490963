"""Keyed topics as a data source of PySpark: partitions, offsets and commits over Parquet files.

A topic has a fixed number of partitions; a record's partition is a hash of its key, so records of one key
share a partition in every write.  Each task of a write appends its rows to files of its own, one for each
partition that it has rows of, so a hot key needs no shuffle and no single task.  The driver then writes one commit file, which gives
the files their first offsets: within a write they follow the tasks, after everything committed before.  Readers
see committed files only.  A commit is named by its writer and batch, and a batch that is committed already is not
committed again, so a replayed micro-batch adds nothing.

Reading deals the files between two offsets to tasks, and streams Arrow batches.  A streaming query keeps the offsets
(the next one of each partition) in its checkpoint and goes on from there after a restart.

A topic has one writer at a time.  What reaches the driver is a line for each file of the commits that a read needs.
Paths are local (shared by all nodes) or URIs that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader,
                                    InputPartition, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package

FORMAT = "keyed_topic"
PARTITION, OFFSET = "topic_partition", "topic_offset"
POSITION = [T.StructField(PARTITION, T.IntegerType()), T.StructField(OFFSET, T.LongType())]


def partition_of(key: Column, partitions: int) -> Column:
    """The topic partition of a key (null is a key)."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path.rstrip("/"))
    return pafs.LocalFileSystem(), path.removeprefix("file:").rstrip("/")


class _Log:
    """The commit files of a topic: the end offset of each partition, and the files that the commit added."""

    def __init__(self, path: str):
        self.fs, self.root = _filesystem(path)

    def names(self) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def entry(self, name: str) -> dict:
        with self.fs.open_input_stream(f"{self.root}/commits/{name}") as f:
            return json.loads(f.read())

    def ends(self) -> dict[str, int]:
        names = self.names()
        return self.entry(names[-1])["ends"] if names else {}

    def files(self, start: dict, end: dict) -> list["Piece"]:
        """The parts of files that hold the offsets from ``start`` up to ``end``, newest commits looked at first."""
        out = []
        for name in reversed(self.names()):
            entry = self.entry(name)
            if all(n <= start.get(p, 0) for p, n in entry["ends"].items()):
                break
            for p, file, base, rows in entry["files"]:
                lo, hi = max(base, start.get(str(p), 0)), min(base + rows, end.get(str(p), 0))
                if lo < hi:
                    out.append(Piece(p, f"{self.root}/{file}", base, lo, hi))
        return out

    def commit(self, owner: str, batch: str, added: list["Added"]) -> None:
        names = self.names()
        if any(n.endswith(f"-{owner}-{batch}.json") for n in names):
            return
        ends, files = self.ends(), []
        for a in sorted(added, key=lambda a: a.task):
            for p, file, rows in a.files:
                base = ends.get(str(p), 0)
                files.append([p, file, base, rows])
                ends[str(p)] = base + rows
        number = int(names[-1].split("-")[0]) + 1 if names else 0
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        draft = f"{self.root}/commits/{uuid4().hex}.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps({"ends": ends, "files": files}).encode())
        self.fs.move(draft, f"{self.root}/commits/{number:012d}-{owner}-{batch}.json")


@dataclass
class Piece(InputPartition):
    partition: int
    file: str
    base: int
    lo: int
    hi: int


@dataclass
class Added(WriterCommitMessage):
    task: int
    files: list[tuple[int, str, int]]


class _Reads:
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(self.schema)
        fs, _ = _filesystem(self.path)
        at = piece.base
        with fs.open_input_file(piece.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=[n for n in want.names if n not in (PARTITION, OFFSET)]):
                lo, hi = max(piece.lo - at, 0), min(piece.hi - at, batch.num_rows)
                if lo < hi:
                    part = batch.slice(lo, hi - lo)
                    made = {PARTITION: lambda: pa.array([piece.partition] * len(part), pa.int32()),
                            OFFSET: lambda: pa.array(range(at + lo, at + hi), pa.int64())}
                    yield pa.RecordBatch.from_arrays([made[x.name]() if x.name in made else part.column(x.name).cast(x.type) for x in want], schema=want)
                at += batch.num_rows


class TopicReader(_Reads, DataSourceReader):
    def partitions(self) -> list[Piece]:
        log = _Log(self.path)
        return log.files({}, log.ends()) or [Piece(-1, "", 0, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        return super().read(piece) if piece.file else iter(())


class TopicStreamReader(_Reads, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _Log(self.path).ends()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return _Log(self.path).files(start, end)

    def commit(self, end: dict) -> None:
        """Nothing to do: the query's checkpoint holds its offsets, and records stay for other readers."""


class _Writes:
    def __init__(self, path: str, owner: str):
        self.path, self.owner = path, owner

    def write(self, batches: Iterator[pa.RecordBatch]) -> Added:
        from pyspark import TaskContext

        fs, root = _filesystem(self.path)
        writers: dict[int, pq.ParquetWriter] = {}
        files: dict[int, list] = {}
        try:
            for batch in batches:
                which = batch.column(PARTITION)
                for p in pc.unique(which).to_pylist():
                    rows = batch.filter(pc.equal(which, p)).drop_columns([PARTITION])
                    if p not in writers:
                        file = f"data/{p:05d}/{uuid4().hex}.parquet"
                        fs.create_dir(f"{root}/data/{p:05d}", recursive=True)
                        writers[p] = pq.ParquetWriter(f"{root}/{file}", rows.schema, filesystem=fs)
                        files[p] = [p, file, 0]
                    writers[p].write_batch(rows)
                    files[p][2] += rows.num_rows
        finally:
            for w in writers.values():
                w.close()
        return Added(TaskContext.get().partitionId(), [tuple(x) for x in files.values()])


class TopicWriter(_Writes, DataSourceArrowWriter):
    def commit(self, messages: list[Added | None]) -> None:
        _Log(self.path).commit(self.owner, uuid4().hex, [m for m in messages if m])

    def abort(self, messages: list[Added | None]) -> None:
        """Files without a commit are not seen by readers."""


class TopicStreamWriter(_Writes, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Added | None], batchId: int) -> None:
        _Log(self.path).commit(self.owner, str(batchId), [m for m in messages if m])

    def abort(self, messages: list[Added | None], batchId: int) -> None:
        """Files without a commit are not seen by readers; the batch is run again."""


class KeyedTopic(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TopicReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return TopicStreamReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TopicWriter(self.options["path"], "batch")

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return TopicStreamWriter(self.options["path"], self.options["owner"])


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(KeyedTopic)


def keyed_scan(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """The committed records of a topic with their ``topic_partition`` and ``topic_offset`` (from 0 in each partition);
    a topic that has no commit yet is empty."""
    _register(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format(FORMAT).schema(T.StructType(schema.fields + POSITION)).load(path)


def keyed_write(df: DataFrame, path: str, key: Column, partitions: int = 6, order: list[str] | None = None, checkpoint: str | None = None):
    """Append ``df`` to the topic at ``path``; a stream needs a ``checkpoint``, and its started query is returned.

    Without ``order`` there is no shuffle.  With it (batch only) offsets ascend with those columns within a partition, by a
    range exchange that cuts a partition with a hot key into many tasks."""
    _register(df.sparkSession)
    out = df.withColumn(PARTITION, partition_of(key, partitions))
    if df.isStreaming:
        owner = sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
        return (out.writeStream.format(FORMAT).option("path", path).option("owner", owner).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    if order:
        out = out.repartitionByRange(PARTITION, *order).sortWithinPartitions(PARTITION, *order)
    out.write.format(FORMAT).mode("append").save(path)
    return None
