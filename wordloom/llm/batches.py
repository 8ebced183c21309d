"""Arrow batches of (id, text) rows, for operators whose work is Python's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wordloom.llm.shared import text_of

SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about so many bytes in the column text: what is turned into Python objects at once."""
    if batch.num_rows:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cut = (np.flatnonzero(np.diff(upto // size)) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def by_text(docs: DataFrame, id_col: str | None, text_col: str, work: Callable[[list, list], Iterable[tuple]], ddl: str, binary: bool = False) -> DataFrame:
    """The rows that work(ids, texts) gives for each slice of a batch, under the schema ddl.

    A slice is bounded in bytes, and so is what work returns for it. A null text is empty. With binary, texts are UTF-8 bytes. Only the two columns are read; without
    id_col the ids are null.
    """
    text = text_of(text_col)
    rows = docs.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"), (F.encode(text, "UTF-8") if binary else text).alias("text"))
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in found for part in slices(whole)):
            if out := list(work(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(arrow, zip(*out, strict=True), strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def chosen(key: object, parts: int) -> int:
    """crc32 of an id as text, modulo parts: the same split at every size. A null id is the text ''."""
    import zlib

    return zlib.crc32(b"" if key is None else str(key).encode()) % parts


_HOLDER: list = [None, None]


def take_over(name: str, clear: Callable[[], None]) -> None:
    """Called by an operator before it uses caches that its worker process keeps between tasks.

    Workers are used again for other operators: the caches of the one before are dropped, so that a
    worker's memory is bounded by the largest operator's, not by the sum of all.
    """
    if _HOLDER[0] != name:
        if _HOLDER[1] is not None:
            _HOLDER[1]()
            give_back()
        _HOLDER[:] = [name, clear]


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
