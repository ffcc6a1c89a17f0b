"""A data source of its own for record files: ``spark.read.format("tarnweave")`` and, for pieces of text, its sink.

Reading goes by byte ranges that sync to record borders, so a file of any size is read in parallel and no
range needs another one's result. ``kind`` is ``corpus`` (records that blank lines separate) or ``pairs`` (lines split at
the first tab); ``splitBytes`` is the size of a range, ``labeled`` says whether a record's second line is its category.
Paths are those that pyarrow's file systems open (local and mounted folders, and remote ones by URI).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "tarnweave"
SPLIT_BYTES, BLOCK = 64 << 20, 1 << 16
#: Ranges of all files together; ``splitbytes`` gives way above about so many, since each costs a task.
MAX_SPLITS = 1024
#: Records of a batch sent to the JVM.
BATCH = 1024

#: Where a record stands: its file, the first byte of its range, and its place among the range's records.
PLACE = "file string, split long, place long"
SCHEMAS = {"corpus": f"{PLACE}, title string, category string, text string", "pairs": f"{PLACE}, key string, value string"}


def _opened(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


class _Bytes:
    """A file from some byte on, read further as it is asked for."""

    def __init__(self, stream, at: int):
        self.stream, self.at, self.data, self.ended = stream, at, b"", False
        stream.seek(at)

    def more(self) -> bool:
        block = b"" if self.ended else self.stream.read(BLOCK)
        self.ended = not block
        self.data += block
        return bool(block)

    def find(self, mark: bytes, start: int) -> int:
        """Place in ``data`` of the next mark, reading on until there is one; -1 if the file ends before."""
        while (found := self.data.find(mark, start)) < 0:
            start = max(start, len(self.data) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def blank_line_records(stream, begin: int, end: int) -> Iterator[bytes]:
    """The records whose first byte is in the range; they may end beyond it. Runs of blank lines give no record."""
    b = _Bytes(stream, max(0, begin - 2))
    if begin > 2:  # a record begins behind a blank line
        if (gap := b.find(b"\n\n", 0)) < 0:
            return
        b.drop(gap)
    elif begin:
        b.more()
        if not b.data.startswith(b"\n" * begin):  # the file's first record begins before
            if (gap := b.find(b"\n\n", 0)) < 0:
                return
            b.drop(gap)
    while True:
        while not (body := b.data.lstrip(b"\n")):
            b.drop(len(b.data))
            if not b.more():
                return
        b.drop(len(b.data) - len(body))
        if b.at >= end:
            return
        gap = b.find(b"\n\n", 0)
        yield (b.data if gap < 0 else b.data[:gap]).rstrip(b"\n")
        if gap < 0:
            return
        b.drop(gap)


def lines(stream, begin: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte is in the range."""
    b = _Bytes(stream, max(0, begin - 1))
    if begin:
        if (gap := b.find(b"\n", 0)) < 0:
            return
        b.drop(gap + 1)
    while b.at < end:
        gap = b.find(b"\n", 0)
        if gap < 0:
            if b.data:
                yield b.data
            return
        yield b.data[:gap]
        b.drop(gap + 1)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "corpus")
        self.labeled, self.size = str(options.get("labeled", "true")).lower() == "true", max(1, int(options.get("splitbytes", SPLIT_BYTES)))

    def partitions(self) -> list[ByteRange]:
        from pyarrow import fs

        system, path = _opened(self.path)
        found = system.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        data = sorted((f for f in files if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(("_", "."))), key=lambda f: f.path)
        size = max(self.size, -(-sum(f.size for f in data) // MAX_SPLITS))
        return [ByteRange(f.path, at, min(f.size, at + size)) for f in data for at in range(0, f.size, size)] or [ByteRange("", 0, 0)]

    def _rows(self, part: ByteRange) -> Iterator[tuple]:
        if not part.path:
            return
        with _opened(self.path)[0].open_input_file(part.path) as stream:
            if self.kind == "pairs":
                for place, line in enumerate(lines(stream, part.begin, part.end)):
                    key, _, value = line.decode("utf-8", "replace").partition("\t")
                    yield part.path, part.begin, place, key, value
                return
            for place, record in enumerate(blank_line_records(stream, part.begin, part.end)):
                title, *rest = record.decode("utf-8", "replace").split("\n")
                category = (rest.pop(0) if rest else None) if self.labeled else None
                yield part.path, part.begin, place, title, category, "".join(f"{line}\n" for line in rest)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMAS[self.kind].split(", ")]
        kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in SCHEMAS[self.kind].split(", ")]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for row in self._rows(partition):
            held.append(row)
            if len(held) == BATCH:
                yield batch()
                held = []
        if held:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    beside: str
    name: str


class PieceWriter(DataSourceWriter):
    """Writes one string column as it is, nothing between the rows: a file a task, in the order of the tasks.

    A task writes beside the final names; they are given when all tasks are done, so a repeated or lost task leaves nothing.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        system, path = _opened(self.path)
        context = TaskContext.get()
        beside = f"{path}/_pending-{self.run}/{context.partitionId():05d}-{context.taskAttemptId()}"
        system.create_dir(posixpath.dirname(beside), recursive=True)
        with system.open_output_stream(beside) as out:
            for (piece,) in iterator:
                out.write(piece.encode())
        return Written(beside, f"{path}/part-{context.partitionId():05d}")

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and system.get_file_info(m.beside).size:
                system.move(m.beside, m.name)
        self.abort(messages)
        system.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        system, path = _opened(self.path)
        system.create_dir(f"{path}/_pending-{self.run}", recursive=True)
        system.delete_dir(f"{path}/_pending-{self.run}")


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        kind = self.options.get("kind", "corpus")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {tuple(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)


def read_records(spark: SparkSession, path: str, labeled: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(doc_id, title, category, text), the rows of ``text.read_corpus``; only the counts of the ranges are brought together."""
    register(spark)
    records = spark.read.format(NAME).option("kind", "corpus").option("labeled", str(labeled)).option("splitBytes", split_bytes).load(path)
    counts = records.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.join(counts.select("file", "split", before.alias("before")), ["file", "split"]).select((F.col("before") + F.col("place")).cast("long").alias("doc_id"), "title", "category", "text")


def write_listing_runs(assigned: DataFrame, path: str) -> None:
    """The lines of ``text.write_listing``, of clusters of any size: sorted entries are cut into runs, and each task writes its run.

    An entry brings its own surroundings: the header before a cluster's first, a comma or the line's end behind it. The files,
    one after another, are the listing; a line may go over from one to the next.
    """
    register(assigned.sparkSession)
    category = F.coalesce("category", F.lit(""))
    label = F.when(F.col("title") != "", F.concat("title", F.lit("("), category, F.lit(")"))).otherwise(F.coalesce("title", F.lit("")))
    entries = assigned.select("cluster", F.struct("doc_id", label.alias("label")).alias("entry"))
    numbered = entries.groupBy("cluster", "entry").agg(F.count(F.lit(1)).alias("n"))
    ends = numbered.groupBy(F.col("cluster").alias("of")).agg(F.min("entry").alias("first"), F.max("entry").alias("last"))
    head = F.when(F.col("entry") == F.col("first"), F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit("\n"))).otherwise("")
    body = F.array_join(F.array_repeat("entry.label", F.col("n").cast("int")), ", ")
    tail = F.when(F.col("entry") == F.col("last"), "\n").otherwise(", ")
    marked = numbered.join(ends, F.col("cluster").eqNullSafe(F.col("of"))).select("cluster", "entry", F.concat(head, body, tail).alias("piece"))
    marked.orderBy("cluster", "entry").select("piece").write.format(NAME).mode("overwrite").save(path)
