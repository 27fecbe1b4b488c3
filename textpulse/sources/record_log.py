"""A partitioned record log in a shared folder, as a Spark data source: batch and stream, read and write.

The folder of a topic holds one folder per commit, ``seq=<n>_<writer>_<batch>``, with Parquet
files ``p<partition>-<id>.parquet`` of records (key, value, timestamp). A record's offset is its
place among all records of its partition, in the order of the commits. Readers see whole commits
only: a writer's tasks write aside, and the commit renames one folder into place (on storage
whose renames are atomic). A commit that is repeated for the same stream and batch id is
recognised by the folder's name and changes nothing, so every micro-batch counts once.

Reading gives the envelope of a message bus (key, value, topic, partition, offset, timestamp).
A stream starts at the ``earliest`` or ``latest`` records or where its consumer ``group`` had
``committed`` (without a committed offset: the latest); restarted from its checkpoint it goes on
exactly where it stopped. With the ``availableNow`` trigger a run is one micro-batch (Spark gives
Python sources no more), a repeated one included.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.streaming import StreamingQuery

ENVELOPE = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
#: Records of one partition that one task reads.
TASK_RECORDS = 1_000_000
#: Records, and bytes, that a writing task gathers before it writes them (one batch at least).
STAGE_RECORDS, STAGE_BYTES = 200_000, 32 << 20
_ARROW = pa.schema(
    [("key", pa.string()), ("value", pa.string()), ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC"))]
)
_STORED = pa.schema([_ARROW.field("key"), _ARROW.field("value"), _ARROW.field("timestamp")])


class TopicFolder:
    """The commits of one topic. Sizes of files already seen are remembered (files never change)."""

    def __init__(self, path: str, topic: str):
        self.fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.topic = topic
        self.path = posixpath.join(root, topic)
        self.sizes: dict[str, int] = {}

    def commits(self) -> list[str]:
        """Names of the commits, in order."""
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("seq="))

    def files(self) -> dict[int, list[tuple[str, int]]]:
        """Per partition its files in order, with their numbers of records."""
        out: dict[int, list[tuple[str, int]]] = {}
        for commit in self.commits():
            folder = posixpath.join(self.path, commit)
            for f in sorted(self.fs.get_file_info(pafs.FileSelector(folder)), key=lambda f: f.base_name):
                if f.path not in self.sizes:
                    with self.fs.open_input_file(f.path) as handle:
                        self.sizes[f.path] = pq.read_metadata(handle).num_rows
                out.setdefault(int(f.base_name[1:].split("-")[0]), []).append((f.path, self.sizes[f.path]))
        return out

    def end(self) -> dict[str, int]:
        """The offset behind the last record of every partition."""
        return {str(p): sum(n for _, n in files) for p, files in sorted(self.files().items())}

    def ranges(self, start: dict, end: dict, task_records: int) -> list[LogRange]:
        """Pieces of at most ``task_records`` records that cover [start, end) of every partition."""
        out = []
        for p, files in sorted(self.files().items()):
            lo, hi, base = int(start.get(str(p), 0)), int(end.get(str(p), 0)), 0
            pieces: list[tuple[str, int, int, int]] = []
            for path, n in files:
                at, stop = max(lo, base), min(hi, base + n)
                while at < stop:
                    room = task_records - sum(b - a for _, a, b, _ in pieces)
                    to = min(stop, at + room)
                    pieces.append((path, at - base, to - base, at))
                    at = to
                    if sum(b - a for _, a, b, _ in pieces) >= task_records:
                        out.append(LogRange(p, tuple(pieces)))
                        pieces = []
                base += n
            if pieces:
                out.append(LogRange(p, tuple(pieces)))
        return out

    def read(self, piece: LogRange) -> Iterator[pa.RecordBatch]:
        """The records of one piece, as envelope batches; row groups outside it are not read."""
        for path, lo, hi, offset in piece.pieces:
            with self.fs.open_input_file(path) as handle:
                file = pq.ParquetFile(handle)
                base = 0
                for group in range(file.num_row_groups):
                    rows = file.metadata.row_group(group).num_rows
                    if base < hi and lo < base + rows:
                        at = base
                        for batch in file.iter_batches(row_groups=[group], batch_size=8192):
                            first, last = max(lo - at, 0), min(hi - at, batch.num_rows)
                            if first < last:
                                part = batch.slice(first, last - first)
                                n = part.num_rows
                                numbers = pa.array(range(offset + at + first - lo, offset + at + last - lo), pa.int64())
                                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("value"), pa.array([self.topic] * n), pa.array([piece.partition] * n, pa.int32()), numbers, part.column("timestamp")], schema=_ARROW)
                            at += batch.num_rows
                    base += rows

    def _aside(self, writer: str) -> str:
        return posixpath.join(self.path, "_staging", writer)

    def stage(self, batches: Iterator[pa.RecordBatch], writer: str) -> Staged:
        """Write one task's records aside, one file per partition. Batches are gathered up to a
        bound, because every write is a row group in each partition's file."""
        folder = posixpath.join(self._aside(writer), uuid.uuid4().hex)
        writers: dict[int, pq.ParquetWriter] = {}
        held: list[pa.RecordBatch] = []

        def write() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            dealt = table.column("partition").combine_chunks()
            stored = table.select(_STORED.names).cast(_STORED)
            for p in sorted(pc.unique(dealt).to_pylist()):
                if p not in writers:
                    self.fs.create_dir(folder, recursive=True)
                    writers[p] = pq.ParquetWriter(posixpath.join(folder, f"p{p:05d}-{uuid.uuid4().hex[:12]}.parquet"), _STORED, filesystem=self.fs)
                writers[p].write_table(stored.filter(pc.equal(dealt, p)))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STAGE_RECORDS or sum(b.nbytes for b in held) >= STAGE_BYTES:
                write()
        if held:
            write()
        for file in writers.values():
            file.close()
        return Staged(folder if writers else None)

    def discard(self, writer: str) -> None:
        """Remove what a writer's tasks have left aside (of lost tasks too; nobody reads it)."""
        if self.fs.get_file_info(self._aside(writer)).type == pafs.FileType.Directory:
            self.fs.delete_dir(self._aside(writer))

    def commit(self, staged: list, writer: str, batch: int) -> None:
        """Make the staged files one commit; a batch that this writer has committed changes nothing."""
        name = f"_{writer}_{batch}"
        folders = [s.folder for s in staged if s is not None and s.folder]
        if folders and not any(c.endswith(name) for c in self.commits()):
            whole = posixpath.join(self._aside(writer), f"whole-{uuid.uuid4().hex}")
            self.fs.create_dir(whole, recursive=True)
            for folder in folders:
                for f in self.fs.get_file_info(pafs.FileSelector(folder)):
                    self.fs.move(f.path, posixpath.join(whole, f.base_name))
            self._publish(whole, name)
        self.discard(writer)

    def _publish(self, whole: str, name: str) -> None:
        """Rename a folder to the next commit; if another writer takes that number, to the one after."""
        while True:
            number = max((int(c[4:].split("_")[0]) for c in self.commits()), default=-1) + 1
            try:
                return self.fs.move(whole, posixpath.join(self.path, f"seq={number:012d}{name}"))
            except OSError:
                if not any(c.startswith(f"seq={number:012d}_") for c in self.commits()):
                    raise

    def committed(self, group: str) -> dict[str, int] | None:
        """The offsets that a consumer group has committed."""
        path = posixpath.join(self.path, "_groups", f"{group}.json")
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as handle:
            return json.loads(handle.read())

    def commit_group(self, group: str, offsets: dict) -> None:
        folder = posixpath.join(self.path, "_groups")
        self.fs.create_dir(folder, recursive=True)
        aside = posixpath.join(folder, f"_{uuid.uuid4().hex}")
        with self.fs.open_output_stream(aside) as handle:
            handle.write(json.dumps(offsets).encode())
        self.fs.move(aside, posixpath.join(folder, f"{group}.json"))


@dataclass
class LogRange(InputPartition):
    """Slices (file, first row, end row, offset of the first row) of one partition."""

    partition: int
    pieces: tuple

    def __post_init__(self):
        self.value = None


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task has written; None if it had no rows."""

    folder: str | None


class RecordLog(DataSource):
    """``format("record_log")``: options ``path``, ``topic``; reading: ``start`` (earliest,
    committed, latest), ``group``, ``taskRecords``; writing: ``writer`` (the name of a stream; its
    batch ids count once).

    A micro-batch takes all records that are there, in tasks of at most ``taskRecords``: Spark
    does not tell a Python source from where it resumes, so a bound per batch could step back.
    """

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> str:
        return ENVELOPE

    def _folder(self) -> TopicFolder:
        return TopicFolder(self.options["path"], self.options["topic"])

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self._folder(), int(self.options.get("taskRecords", TASK_RECORDS)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self._folder(), self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a record log can only be appended to")
        return LogWriter(self._folder())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return LogStreamWriter(self._folder(), self.options["writer"])


class LogReader(DataSourceReader):
    """The records that are there when the plan is made."""

    def __init__(self, folder: TopicFolder, task_records: int):
        self.folder, self.task_records = folder, task_records

    def partitions(self):
        return self.folder.ranges({}, self.folder.end(), self.task_records)

    def read(self, partition):
        return self.folder.read(partition) if partition is not None else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, folder: TopicFolder, options):
        self.folder = folder
        self.start = options.get("start", "committed")
        if self.start not in ("earliest", "committed", "latest"):
            raise ValueError(f"start must be committed, earliest or latest, got {self.start!r}")
        self.group = options.get("group")
        self.task_records = int(options.get("taskRecords", TASK_RECORDS))

    def initialOffset(self) -> dict:
        if self.start == "earliest":
            return {}
        found = self.folder.committed(self.group) if self.start == "committed" and self.group else None
        return self.folder.end() if found is None else found

    def latestOffset(self) -> dict:
        return self.folder.end()

    def partitions(self, start: dict, end: dict):
        return self.folder.ranges(start, end, self.task_records)

    def read(self, partition):
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        if self.group:
            self.folder.commit_group(self.group, end)


class LogWriter(DataSourceArrowWriter):
    def __init__(self, folder: TopicFolder):
        self.folder, self.name = folder, uuid.uuid4().hex

    def write(self, iterator):
        return self.folder.stage(iterator, self.name)

    def commit(self, messages) -> None:
        self.folder.commit(messages, self.name, 0)

    def abort(self, messages) -> None:
        self.folder.discard(self.name)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: TopicFolder, name: str):
        self.folder, self.name = folder, name

    def write(self, iterator):
        return self.folder.stage(iterator, self.name)

    def commit(self, messages, batchId: int) -> None:
        self.folder.commit(messages, self.name, batchId)

    def abort(self, messages, batchId: int) -> None:
        self.folder.discard(self.name)


def register_record_log(spark: SparkSession) -> None:
    spark.dataSource.register(RecordLog)


def record_log(spark: SparkSession, path: str, topic: str, stream: bool = True, **options: object) -> DataFrame:
    """The envelope rows of a topic; a batch read takes all records that are there."""
    register_record_log(spark)
    reader = spark.readStream if stream else spark.read
    return reader.format("record_log").options(path=path, topic=topic, **{k: str(v) for k, v in options.items()}).load()


def log_rows(df: DataFrame, key_col: str | None, partitions: int) -> DataFrame:
    """(key, value, partition, timestamp): each row as one JSON object, dealt by its key.

    Rows of one key are in one partition, in order of their commits; rows without a key are
    dealt by their value.
    """
    key = F.col(f"`{key_col}`").cast("string") if key_col else F.lit(None).cast("string")
    rows = df.select(key.alias("key"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value"))
    dealt = F.pmod(F.when(F.col("key").isNull(), F.xxhash64("value")).otherwise(F.xxhash64("key")), F.lit(partitions)).cast("int")
    return rows.select("key", "value", dealt.alias("partition"), F.current_timestamp().alias("timestamp"))


def append_to_log(df: DataFrame, path: str, topic: str, key_col: str | None = None, partitions: int = 8) -> None:
    """Append the rows of a table as one commit: all of them, or none if the write fails."""
    register_record_log(df.sparkSession)
    log_rows(df, key_col, partitions).write.format("record_log").options(path=path, topic=topic).mode("append").save()


def publish_stream(df: DataFrame, path: str, topic: str, writer: str, checkpoint: str, key_col: str | None = None, partitions: int = 8, trigger: dict | None = None) -> StreamingQuery:
    """Publish a stream's rows; every micro-batch is one commit and counts once, also if it is
    repeated after a failure."""
    register_record_log(df.sparkSession)
    rows = log_rows(df, key_col, partitions).writeStream.format("record_log").outputMode("append")
    return rows.options(path=path, topic=topic, writer=writer, checkpointLocation=checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def commit_progress(query: StreamingQuery, path: str, topic: str, group: str) -> None:
    """Commit, for a consumer group, the offsets that a stopped query has reached."""
    done = query.lastProgress
    if done is not None:
        TopicFolder(path, topic).commit_group(group, json.loads(done.json)["sources"][0]["endOffset"])
