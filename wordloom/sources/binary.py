"""Legacy binary files as Spark data sources.

``pair_records``: 16-byte records int32, int32, float64 in the host's byte order, read by byte ranges and
written one file a task. ``parameter_file``: float64, first all word rows, then all context rows, each
with its bias last; needs the option ``size``, the vector size. ``summed_vectors``: such a file's word and
context vectors added up. Paths are URIs that pyarrow opens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from wordloom.sources.onefile import write_one

RECORD = struct.Struct("=iid")
SPLIT = 1 << 26
HALF_BYTES = 8 << 20  # of each half of a file that a task adds up at once


def _files(path: str) -> list[tuple[str, int]]:
    """(URI path, size) of the file, or of the files in the folder, in the order of their names."""
    system, inner = pafs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(pafs.FileSelector(inner))
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


def _read(path: str, begin: int, n: int) -> bytes:
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        f.seek(begin)
        return f.read(n)


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, size: int):
        self.path, self.begin, self.size = path, begin, size


class _PairReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in _files(self.path):
            if size % RECORD.size:
                raise ValueError(f"{path}: not a whole number of records")
            out += [_Range(path, k, min(SPLIT, size - k)) for k in range(0, size, SPLIT)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.size:
            yield from RECORD.iter_unpack(_read(partition.path, partition.begin, partition.size))


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _PairWriter(DataSourceWriter):
    @staticmethod
    def packed(r) -> bytes:
        return RECORD.pack(r[0], r[1], r[2])

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Done:
        from pyspark import TaskContext

        system, inner = pafs.FileSystem.from_uri(self.path)
        system.create_dir(inner, recursive=True)
        context = TaskContext.get()
        name = f"{inner}/.{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}"
        with system.open_output_stream(name) as f:
            held = []
            for r in rows:
                held.append(self.packed(r))
                if len(held) == 65536:
                    f.write(b"".join(held))
                    held = []
            f.write(b"".join(held))
        return _Done(name)

    def commit(self, messages: list) -> None:
        system, inner = pafs.FileSystem.from_uri(self.path)
        if self.overwrite:
            for path, _ in _files(self.path):
                system.delete_file(pafs.FileSystem.from_uri(path)[1])
        for k, m in enumerate(messages):
            if m is not None:
                system.move(m.path, f"{inner}/part-{k:06d}-{self.job[:8]}.bin")

    def abort(self, messages: list) -> None:
        system, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class PairRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pair_records"

    def schema(self) -> str:
        return "word1 int, word2 int, val double"

    def reader(self, schema) -> _PairReader:
        return _PairReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _PairWriter:
        return _PairWriter(self.options["path"], overwrite)


class _Shard(_Range):
    """A range of a file, and where it stands in the whole."""

    def __init__(self, path: str, begin: int, size: int, at: int, half: int):
        super().__init__(path, begin, size)
        self.at, self.half = at, half


class _ParameterReader(DataSourceReader):
    """The file, or the files of a folder in the order of their names, as one sequence of rows."""

    def __init__(self, path: str, size: int):
        self.path, self.row = path, 8 * (size + 1)

    def partitions(self) -> list[_Range]:
        files = _files(self.path)
        whole = sum(size for _, size in files)
        if whole % (2 * self.row) or any(size % self.row for _, size in files):
            raise ValueError(f"{self.path}: not the rows of two sides")
        step, out, at = max(1, SPLIT // self.row) * self.row, [], 0
        for path, size in files:
            out += [_Shard(path, k, min(step, size - k), at + k, whole // 2) for k in range(0, size, step)]
            at += size
        return out or [_Shard("", 0, 0, 0, 0)]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if not partition.size:
            return
        data = _read(partition.path, partition.begin, partition.size)
        for k in range(0, len(data), self.row):
            values = struct.unpack_from(f"={self.row // 8}d", data, k)
            at = partition.at + k
            side, at = ("w", at) if at < partition.half else ("c", at - partition.half)
            yield side, at // self.row + 1, list(values[:-1]), values[-1]


class _ParameterWriter(_PairWriter):
    """Rows (side, id, v, b) come sorted; a task's file has the place of its partition."""

    @staticmethod
    def packed(r) -> bytes:
        return struct.pack(f"={len(r[2]) + 1}d", *r[2], r[3])


class ParameterFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parameter_file"

    def schema(self) -> str:
        return "side string, id int, v array<double>, b double"

    def reader(self, schema) -> _ParameterReader:
        return _ParameterReader(self.options["path"], int(self.options["size"]))

    def writer(self, schema, overwrite: bool) -> _PairWriter:
        return _ParameterWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PairRecords)
    spark.dataSource.register(ParameterFile)
    spark.dataSource.register(SummedVectors)


def write_parameters(params, path: str, columns: tuple[str, str] = ("v", "b")) -> None:
    """A folder of parameter_file parts: all rows, word side first, by id; columns (g, gb) writes the accumulators.

    The parts, in the order of their names, are the format's one file cut at rows; tasks write them, so
    nothing passes through the driver. joined() makes the one file.
    """
    v, b = columns
    rows = params.selectExpr("side", "id", f"{v} as v", f"{b} as b", "if(side = 'w', 0, 1) as s")
    rows.repartitionByRange("s", "id").sortWithinPartitions("s", "id").select("side", "id", "v", "b").write.format("parameter_file").mode("append").save(path)


def _parameter_bytes(batch: pa.RecordBatch) -> bytes:
    v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack([v, batch.column(1).to_numpy(zero_copy_only=False)]).astype(np.float64).tobytes()


def write_parameter_file(params: DataFrame, path: str, columns: tuple[str, str] = ("v", "b")) -> None:
    """The format's one file, written by all tasks: word rows by id, then context rows; columns (g, gb) writes the accumulators."""
    v, b = columns
    write_one(params, [F.when(F.col("side") == "w", 0).otherwise(1), "id"], [F.col(v).alias("v"), F.col(b).alias("b")], _parameter_bytes, path)


PAIR = np.dtype([("word1", "=i4"), ("word2", "=i4"), ("val", "=f8")])


def _pair_bytes(batch: pa.RecordBatch) -> bytes:
    out = np.empty(batch.num_rows, PAIR)
    for k, name in enumerate(PAIR.names):
        out[name] = batch.column(k).to_numpy(zero_copy_only=False)
    return out.tobytes()


def write_pair_file(pairs: DataFrame, path: str, order: list | None = None) -> None:
    """One file of 16-byte records, written by all tasks, by word1 and word2 or in another order that no two pairs share."""
    write_one(pairs, order or ["word1", "word2"], [F.col("word1"), F.col("word2"), F.col("val")], _pair_bytes, path)


class _Halves(InputPartition):
    """Rows first to last of both halves of the file."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _SummedReader(DataSourceReader):
    def __init__(self, path: str, words: int):
        found = _files(path)
        if len(found) != 1:
            raise ValueError(f"{path}: not one file")
        self.path, size = found[0]
        self.words = words
        if words < 1 or size % (16 * words) or size < 32 * words:
            raise ValueError(f"{path}: {size} bytes are not two sides of {words} words")
        self.row = size // (2 * words)

    def partitions(self) -> list[_Halves]:
        step = max(1, HALF_BYTES // self.row)
        return [_Halves(k, min(k + step, self.words)) for k in range(0, self.words, step)]

    def read(self, partition: _Halves) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        halves = [np.frombuffer(_read(self.path, begin + partition.first * self.row, n * self.row)).reshape(n, -1)[:, :-1] for begin in (0, self.words * self.row)]
        total = halves[0] + halves[1]
        for k in range(0, n, 8192):
            part = np.ascontiguousarray(total[k : k + 8192])
            ends = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + k + 1, partition.first + k + 1 + len(part), dtype=np.int32)), pa.ListArray.from_arrays(ends, part.ravel())], names=["id", "v"])


class SummedVectors(DataSource):
    """Options: path of a parameter file, words (the vocabulary's size). The vector size follows from the file's."""

    @classmethod
    def name(cls) -> str:
        return "summed_vectors"

    def schema(self) -> str:
        return "id int, v array<double>"

    def reader(self, schema) -> _SummedReader:
        return _SummedReader(self.options["path"], int(self.options["words"]))


def read_summed(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """id, word, v: word and context vectors of a parameter file added up, biases left out. A task reads the same rows of both halves."""
    register(spark)
    words = vocab.count()
    return spark.read.format("summed_vectors").option("words", words).load(path).join(vocab.select("id", "word"), "id").select("id", "word", "v")


def joined(folder: str, path: str) -> None:
    """The parts of a folder as one file, copied a block at a time."""
    system, inner = pafs.FileSystem.from_uri(path)
    with system.open_output_stream(inner) as out:
        for part, size in _files(folder):
            for k in range(0, size, SPLIT):
                out.write(_read(part, k, min(SPLIT, size - k)))


__all__ = ["PairRecords", "ParameterFile", "SummedVectors", "joined", "read_summed", "register", "write_pair_file", "write_parameter_file", "write_parameters"]
