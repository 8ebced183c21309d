"""Text files by byte ranges, so that neither a file nor a line is one task.

``corpus_ranges``: the tokens that begin in a range, as pieces of text cut between tokens; a token at a range's
end is completed from the bytes after it, and the next range leaves it out. Each piece has its file, range,
line (number of line breaks before it in its range) and number. ``numbered_lines``: the lines that begin in
a range, with their number in the file; asked for some numbers, it reads only the ranges that hold them.
Ranges don't know how many lines were before them: a first pass counts each range's line breaks.
Paths are what pyarrow opens: URIs or absolute local paths, of a file or a folder of files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wordloom.functions.text import MAX_BYTES
from wordloom.sources.binary import _files
from wordloom.sources.tables import written

RANGE_BYTES = 32 << 20
#: read_pieces makes its ranges larger, up to RANGE_BYTES, where a file has more than so many for each core.
CORE_RANGES = 8
PIECE_BYTES = 256 << 10
#: numbered_lines keeps one number a range on the driver: ranges grow with the file so that there are at most so many.
MOST_RANGES = 1 << 16
#: read_pieces sends its ranges' counts to all tasks up to so many bytes, and joins them by shuffling beyond.
SENT_BYTES = 64 << 20
COUNT_BYTES = 32
#: Lines or pieces of one Arrow batch, in bytes.
BATCH_BYTES = 4 << 20
BREAK = re.compile(rb"[ \t\n]")


class _Range(InputPartition):
    def __init__(self, file: int, path: str, number: int, begin: int, end: int, first: int = 0):
        self.file, self.path, self.number, self.begin, self.end, self.first = file, path, number, begin, end, first


def _ranges(path: str, step: int) -> list[_Range]:
    return [_Range(f, p, k, a, min(a + step, size)) for f, (p, size) in enumerate(_files(path)) for k, a in enumerate(range(0, size, step))]


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _with_byte_before(f, begin: int, end: int) -> tuple[bytes, bytes]:
    """The byte before begin (none at a file's start), and the bytes of [begin, end)."""
    f.seek(max(begin - 1, 0))
    data = f.read(end - max(begin - 1, 0))
    return (data[:1], data[1:]) if begin else (b"", data)


def owned_tokens(f, begin: int, end: int) -> bytes:
    """The bytes from the first to the last token that begins in [begin, end), the last one whole.

    Of a token that goes on beyond end, no more is read than the longest token keeps. Line breaks of the
    range stand where they were, so counting them gives the line.
    """
    before, body = _with_byte_before(f, begin, end)
    if before and not BREAK.match(before):
        found = BREAK.search(body)
        if found is None:
            return b""
        body = body[found.start() :]
    if not body or BREAK.match(body[-1:]):
        return body
    tail, need = [], MAX_BYTES + 4
    while need > 0 and (data := f.read(4096)):
        found = BREAK.search(data)
        tail.append(data if found is None else data[: found.start()])
        need = 0 if found else need - len(tail[-1]) + tail[-1].count(b"\r")
    return body + b"".join(tail)


def pieces_of(line: bytes) -> Iterator[bytes]:
    """A line in parts of about PIECE_BYTES, cut before a separator."""
    at = 0
    while len(line) - at > PIECE_BYTES:
        cut = max(line.rfind(b" ", at, at + PIECE_BYTES), line.rfind(b"\t", at, at + PIECE_BYTES))
        if cut <= at:  # one token longer than a piece
            found = BREAK.search(line, at + PIECE_BYTES)
            cut = found.start() if found else len(line)
        yield line[at:cut]
        at = cut
    yield line[at:]


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text]) + 64
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*held, strict=True), strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*held, strict=True), strict=True)], schema=schema)


class _PieceReader(DataSourceReader):
    SCHEMA = pa.schema([("file", pa.int32()), ("range", pa.int32()), ("line", pa.int32()), ("piece", pa.int32()), ("text", pa.string())])

    def __init__(self, path: str, step: int):
        self.path, self.step = path, step

    def partitions(self) -> list[_Range]:
        return _ranges(self.path, self.step) or [_Range(0, "", 0, 0, 0)]

    def rows(self, r: _Range) -> Iterator[tuple]:
        with _open(r.path) as f:
            data = owned_tokens(f, r.begin, r.end)
        n = 0
        for k, line in enumerate(data.split(b"\n")):
            for piece in pieces_of(line) if line.strip(b" \t\r") else ():
                yield r.file, r.number, k, n, piece.decode("utf-8", "replace")
                n += 1

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(self.rows(partition), self.SCHEMA, 4)


class _CountReader(_PieceReader):
    """A row for each range: its line breaks."""

    def read(self, partition: _Range) -> Iterator[tuple]:
        if not partition.path:
            return
        with _open(partition.path) as f:
            f.seek(partition.begin)
            left, n = partition.end - partition.begin, 0
            while left > 0 and (data := f.read(min(left, BATCH_BYTES))):
                left -= len(data)
                n += data.count(b"\n")
        yield partition.file, partition.number, n


class CorpusRanges(DataSource):
    """Options: range_bytes; count, for the line breaks of each range instead of the pieces."""

    @classmethod
    def name(cls) -> str:
        return "corpus_ranges"

    def schema(self) -> str:
        return "file int, range int, breaks long" if self.options.get("count") else "file int, range int, line int, piece int, text string"

    def reader(self, schema) -> DataSourceReader:
        return (_CountReader if self.options.get("count") else _PieceReader)(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


class _LineReader(DataSourceReader):
    SCHEMA = pa.schema([("id", pa.int64()), ("value", pa.string())])

    def __init__(self, path: str, step: int, firsts: list[int]):
        self.path, self.step, self.firsts = path, step, firsts
        self.least, self.most = 1, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on id choose ranges; as a range has other lines too, Spark filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("id",):
                v = getattr(f, "value", None)
                if isinstance(f, EqualTo):
                    self.least, self.most = max(self.least, v), min(self.most, v)
                elif isinstance(f, In) and v:
                    self.least, self.most = max(self.least, min(v)), min(self.most, max(v))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, v)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.most = min(self.most, v)
            yield f

    def partitions(self) -> list[_Range]:
        ranges = _ranges(self.path, self.step)
        for r, first in zip(ranges, self.firsts, strict=True):
            r.first = first
        # A range's lines have numbers from first + 1 to the next one's first + 1.
        after = [*self.firsts[1:], 1 << 62]
        wanted = [r for r, more in zip(ranges, after, strict=bool(ranges)) if r.first < self.most and more + 1 >= self.least]
        return wanted or [_Range(0, "", 0, 0, 0)]

    def rows(self, r: _Range) -> Iterator[tuple]:
        with _open(r.path) as f:
            before, body = _with_byte_before(f, r.begin, r.end)
            at = r.first + 1
            if before and before != b"\n":
                found = body.find(b"\n")
                if found < 0:
                    return
                body, at = body[found + 1 :], at + 1
            if not body:
                return
            if body[-1:] != b"\n":
                tail = []
                while data := f.read(65536):
                    found = data.find(b"\n")
                    tail.append(data if found < 0 else data[:found])
                    if found >= 0:
                        break
                body += b"".join(tail)
            else:
                body = body[:-1]
        for k, line in enumerate(body.split(b"\n"), at):
            yield k, line.decode("utf-8", "replace")

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _batches(self.rows(partition), self.SCHEMA, 1)


class NumberedLines(DataSource):
    """Options: range_bytes and firsts, the number of lines before each range (JSON), as read_lines() gives them."""

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return "id long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options["path"], int(self.options["range_bytes"]), json.loads(self.options["firsts"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusRanges)
    spark.dataSource.register(NumberedLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def grown(least: int, whole: int, cores: int) -> int:
    """The bytes of a range of a corpus: at least so many, RANGE_BYTES at most where least is below, CORE_RANGES ranges a core in between."""
    return max(least, min(RANGE_BYTES, whole // (CORE_RANGES * cores)))


def read_pieces(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row (the file), line (in the file, from 0), block (the piece's place in the file), text: a corpus of lines of any length.

    Two passes over the file: line breaks are counted by ranges first. text has whole tokens only. range_bytes is the
    least size of a range: a task costs more to begin than to read a megabyte, so ranges grow with the corpus.
    """
    register(spark)
    range_bytes = grown(range_bytes, sum(size for _, size in _files(path)), spark.sparkContext.defaultParallelism)
    source = lambda **o: spark.read.format("corpus_ranges").options(range_bytes=range_bytes, **o).load(path)
    counts = written(source(count=True), "line-breaks")
    base = F.sum("breaks").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.select("file", "range", F.coalesce(base, F.lit(0)).alias("base"))  # one row a range
    block = F.shiftleft(F.col("range").cast("long"), 32) + F.col("piece")
    small = counts.count() * COUNT_BYTES <= SENT_BYTES
    return source().join(F.broadcast(based) if small else based, ["file", "range"]).select(F.col("file").cast("long").alias("row"), (F.col("base") + F.col("line")).alias("line"), block.alias("block"), "text")


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """id (line number, from 1; on through the files of a folder, each ending with a line break), value. A filter on id reads only the ranges with those lines."""
    register(spark)
    whole = sum(size for _, size in _files(path))
    step = max(range_bytes, whole // MOST_RANGES + 1)
    counts = spark.read.format("corpus_ranges").options(range_bytes=step, count=True).load(path)
    found = [r.breaks for r in counts.orderBy("file", "range").collect()]  # MOST_RANGES numbers at most
    firsts = [0, *accumulate(found)][: len(found)]
    return spark.read.format("numbered_lines").options(range_bytes=step, firsts=json.dumps(firsts)).load(path)
