"""Messages in and out as Python data sources: a pull whose offsets are per-channel cursors, and a sink that commits a batch once.

``channels`` reads landed messages (Parquet files under channel=<name> folders, column message_id and others).
An offset maps each channel to its last message id, so the stream's checkpoint is the table of cursors: it moves
only when a batch is committed, and a run that is killed goes on where the last committed batch ended. Files
are opened only if their footers say that they hold wanted ids.

``messages`` writes JSON lines, a file a task, and a manifest for each batch. A batch that is run again finds its
manifest and leaves nothing behind; files without a manifest are never read.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery


def filesystem(path: str):
    """The file system of a URI or path, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str]]:
    """(channel, file) of all landed files."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    out = []
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = f.path.rpartition("/")
        channel = folder.rpartition("/")[2]
        if f.type == pafs.FileType.File and name.endswith(".parquet") and channel.startswith("channel="):
            out.append((urllib.parse.unquote(channel.removeprefix("channel=")), f.path))
    return sorted(out)


def _bounds(fs, file: str) -> tuple[int, int] | None:
    """Least and greatest message id by the file's footer."""
    import pyarrow.parquet as pq

    meta = pq.read_metadata(file, filesystem=fs)
    at = meta.schema.to_arrow_schema().get_field_index("message_id")
    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    stats = [s for s in stats if s is not None and s.has_min_max]
    return (min(s.min for s in stats), max(s.max for s in stats)) if stats else None


@dataclass
class Pull(InputPartition):
    channel: str
    files: list[str]
    after: int
    upto: int

    def __init__(self, channel: str, files: list[str], after: int, upto: int):
        super().__init__(channel)
        self.channel, self.files, self.after, self.upto = channel, files, after, upto


class ChannelReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema):
        self.path, self.columns = options["path"], schema.names
        self.known: dict[str, tuple[int, int] | None] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, _ = filesystem(self.path)
        newest: dict[str, int] = {}
        for channel, file in _files(self.path):
            if file not in self.known:
                self.known[file] = _bounds(fs, file)
            if self.known[file]:
                newest[channel] = max(newest.get(channel, 0), self.known[file][1])
        return newest

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        fs, _ = filesystem(self.path)
        files: dict[str, list[str]] = {}
        for channel, file in _files(self.path):
            after, upto = start.get(channel, 0), end.get(channel, 0)
            if file not in self.known:
                self.known[file] = _bounds(fs, file)
            if (b := self.known[file]) and b[1] > after and b[0] <= upto:
                files.setdefault(channel, []).append(file)
        return [Pull(c, f, start.get(c, 0), end[c]) for c, f in sorted(files.items())]

    def read(self, partition: Pull) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        fs, _ = filesystem(self.path)
        wanted = (pc.field("message_id") > partition.after) & (pc.field("message_id") <= partition.upto)
        rest = [c for c in self.columns if c != "channel"]
        for batch in ds.dataset(partition.files, filesystem=fs, format="parquet").to_batches(columns=rest, filter=wanted):
            if batch.num_rows:
                cols = {**dict(zip(rest, batch.columns)), "channel": pa.array([partition.channel] * batch.num_rows)}
                yield pa.record_batch([cols[c] for c in self.columns], self.columns)

    def commit(self, end: dict) -> None:
        pass


class ChannelSource(DataSource):
    """Options: path; schema: message_id, channel and other columns of the files."""

    @classmethod
    def name(cls) -> str:
        return "channels"

    def schema(self) -> str:
        return "channel string, message_id long, text string"

    def streamReader(self, schema) -> ChannelReader:
        return ChannelReader(dict(self.options), schema)


def pulled(spark: SparkSession, path: str, schema: str = "channel string, message_id long, text string") -> DataFrame:
    """A stream of messages above their channels' cursors, each once."""
    spark.dataSource.register(ChannelSource)
    return spark.readStream.format("channels").schema(schema).load(path)


@dataclass
class Sent(WriterCommitMessage):
    file: str | None
    rows: int


class MessageWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator) -> Sent:
        fs, root = filesystem(self.path)
        name, f, n = None, None, 0
        try:
            for row in iterator:
                if f is None:
                    name = f"part-{uuid.uuid4().hex}.jsonl"
                    fs.create_dir(root, recursive=True)
                    f = fs.open_output_stream(f"{root}/{name}")
                f.write((json.dumps(row.asDict(recursive=True), default=str) + "\n").encode())
                n += 1
        finally:
            if f is not None:
                f.close()
        return Sent(name, n)

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        manifest = f"{root}/batch-{batchId:012d}.json"
        if fs.get_file_info(manifest).type != pafs.FileType.NotFound:  # done before: this run's files go
            self.abort(messages, batchId)
            return
        files = [m.file for m in messages if m is not None and m.file]
        draft = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            f.write(json.dumps(files).encode())
        fs.move(draft, manifest)  # whole or not at all

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{root}/{m.file}")


class MessageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "id long, category string, message string"

    def streamWriter(self, schema, overwrite: bool) -> MessageWriter:
        return MessageWriter(dict(self.options))


def send(messages: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """A stream of messages into files under ``path``, each batch once."""
    messages.sparkSession.dataSource.register(MessageSink)
    writer = messages.writeStream.format("messages").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def sent_messages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What committed batches hold."""
    from pyarrow import fs as pafs

    fs, root = filesystem(path)
    files = []
    for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if i.base_name.startswith("batch-"):
            with fs.open_input_stream(i.path) as f:
                files += [f"{path.rstrip('/')}/{name}" for name in json.loads(f.read())]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
