"""One file of ordered rows, written by all tasks at once.

Rows are dealt by ranges of the order and turned into bytes where they land; how many bytes stand before a
task's is a sum over the tasks before it. Each task then writes its bytes at their place in one file, which
gets its name when all are done. Nothing passes through the driver or one task. A task that runs again writes the
same bytes at the same place. The file system must let several writers write one file at given places: local
disks of one machine and shared mounts do; object stores and HDFS don't, and take a folder of parts in order.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.places import before_tasks, by_range
from wordloom.sources.tables import written

CHUNK_BYTES = 8 << 20


def local_path(path: str) -> str:
    """The path of a file: URI or a plain absolute path; ValueError for stores without writing at places."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path or not path.startswith("/"):
        raise ValueError(f"{path}: one file is written to mounted file systems only; write a folder of parts instead")
    return path


def line_bytes(batch: pa.RecordBatch) -> bytes:
    """The first column's strings, one after another."""
    column = batch.column(0).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[offsets[0] : offsets[-1]].tobytes() if column.buffers()[2] else b""


def write_one(rows: DataFrame, order: list[str | Column], content: list[Column], to_bytes: Callable[[pa.RecordBatch], bytes], path: str) -> int:
    """Writes to_bytes() of the columns ``content``, batch by batch in the order, as the file ``path``; the file's size.

    An existing file is replaced when the new one is whole.
    """
    target = local_path(path)
    dealt = by_range(rows, order).select(*content)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            data = to_bytes(batch)
            for k in range(0, len(data), CHUNK_BYTES):
                part = data[k : k + CHUNK_BYTES]
                yield pa.RecordBatch.from_pydict({"part": [task], "before": [upto], "size": [len(part)], "data": [part]})
                upto += len(part)

    chunks = written(dealt.mapInArrow(pack, "part long, before long, size long, data binary"), "file-chunks")
    base = written(before_tasks(chunks, F.col("part"), F.col("size")), "file-places")  # one row a task
    total = chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    own = f"{os.path.dirname(target)}/.{os.path.basename(target)}-{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(own, "wb") as f:
        f.truncate(total)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, f = 0, os.open(own, os.O_WRONLY)  # made by the driver: a task on a machine without that mount fails here
        try:
            for batch in batches:
                for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    view = memoryview(data.as_buffer())
                    while len(view):
                        k = os.pwrite(f, view, at)
                        view, at, n = view[k:], at + k, n + k
            os.fsync(f)
        finally:
            os.close(f)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    placed = chunks.join(F.broadcast(base), F.col("part") == F.col("task")).select((F.col("base") + F.col("before")).alias("at"), "data")
    wrote = placed.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if wrote != total:
        os.remove(own)
        raise OSError(f"{path}: {wrote} of {total} bytes written")
    os.replace(own, target)
    return total


def write_lines(rows: DataFrame, order: list[str | Column], value: str | Column, path: str) -> int:
    """A text file with a line for each row."""
    value = F.col(value) if isinstance(value, str) else value
    return write_one(rows, order, [F.concat(value, F.lit("\n")).alias("line")], line_bytes, path)
