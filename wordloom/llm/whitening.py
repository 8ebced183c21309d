"""Whitening of embeddings: a linear map after which components are uncorrelated, each of variance one.

Entries become whole numbers x = floor(64 c) + 1,000,000, so the first pass's sums S, and with them the means S / n,
are exact. The second pass adds up outer products of (n x - S) / n by matrix multiplication, batch by batch; partial
matrices, whose size depends on the dimension alone, are merged on the executors (treeAggregate). The driver
takes eigenvectors by LAPACK's symmetric solver and sends the projection, dimension x components numbers, to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Beyond this, an entry's whole number stays at it (float32 entries reach 2 ^ 128).
MOST = 1 << 61
#: Bytes of partial matrices that may reach the driver at once.
DRIVER_BYTES = 64 << 20
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n vectors were seen, with exact sums; columns of projection are eigenvectors over the roots of their values."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    projection: np.ndarray
    explained: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.sums)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of double) of the rows whose vector isn't null or empty and has no null, NaN or infinite entry."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(~bad).select(F.col(id_col).alias("id"), v.alias("v"))


def whole_numbers(c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def _matrices(batches: Iterator[pa.RecordBatch], column: int, dims: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, at most ROWS rows of one length of vector each (of dims alone, if given), and their vectors as a matrix."""
    for batch in batches:
        for part in (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS)):
            size = pc.list_value_length(part.column(column)).to_numpy(zero_copy_only=False)
            for d in np.unique(size) if dims is None else [dims]:
                own = part if (size == d).all() else part.filter(pa.array(size == d))
                if own.num_rows:
                    yield own, own.column(column).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, int(d))


def _merged(partials: DataFrame, load: Callable, add: Callable, bytes_each: int):
    """Sum of the rows' contents by treeAggregate, as deep as keeps what reaches the driver below DRIVER_BYTES; None without rows."""
    rows = partials.rdd
    width = max(2, DRIVER_BYTES // max(1, bytes_each))
    depth = max(2, ceil(log(max(2, rows.getNumPartitions())) / log(width)))
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    return rows.treeAggregate(None, lambda a, r: both(a, load(r)), both, depth)


def exact_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of their whole numbers, for the length of vector that most rows have (of equally many, the longer); other lengths can't be part of the same space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for _, c in _matrices(batches, 0):
            x = whole_numbers(c)
            own = found.setdefault(c.shape[1], [0, np.zeros(c.shape[1], np.int64), np.zeros(c.shape[1], np.int64)])
            own[0] += len(x)
            own[1] += (x >> 32).sum(axis=0)  # halves, as sums of whole ones might not fit
            own[2] += (x & 0xFFFFFFFF).sum(axis=0)
        for d, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "n": [n], "high": [high.tobytes()], "low": [low.tobytes()]})

    def load(r) -> dict:
        high, low = (np.frombuffer(x, np.int64).astype(object) for x in (r.high, r.low))
        return {r.d: (r.n, high * (1 << 32) + low)}

    def add(a: dict, b: dict) -> dict:
        return a | {d: (n + a[d][0], s + a[d][1]) if d in a else (n, s) for d, (n, s) in b.items()}

    partials = rows.select("v").mapInArrow(run, "d long, n long, high binary, low binary")
    found = _merged(partials, load, add, 1 << 16) or {}
    if not found:
        return 0, ()
    d = max(found, key=lambda d: (found[d][0], d))
    return found[d][0], tuple(int(s) for s in found[d][1])


def scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, exactly: as 64-bit numbers where they fit, else as Python's."""
    most = max(map(abs, sums), default=0) + n * max(int(x.max(initial=0)), -int(x.min(initial=0)), 0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return scaled(x, n, sums).astype(float) / n


def _outer_products(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Sum of of(c) and of its outer products over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for _, c in _matrices(batches, 0, dims):
            z = of(c)
            total[:-1] += z.T @ z
            total[-1] += z.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    found = _merged(rows.select("v").mapInArrow(run, "total binary"), lambda r: np.frombuffer(r.total).reshape(size + 1, size), np.add, 8 * size * (size + 1))
    return None if found is None else (found[:-1], found[-1])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of usable(); None without rows. Directions without variance (up to rounding) are left out."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    d = len(sums)
    products, _ = _outer_products(rows, d, lambda c: centred(whole_numbers(c), n, sums), d)
    values, directions = np.linalg.eigh(products / n)
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(values.sum())
    real = int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum()) if trace > 0 else 0
    k = min(components, real)
    return Whitening(n, sums, values[:k].copy(), directions[:, :k] / np.sqrt(values[:k]), values[:k] / trace if k else np.zeros(0))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation (sum of (n x - S) ^ 2, exact; null beyond a long), whitened (array of double, a number for each component) of the rows of usable() with the model's dimension."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # dimension x (components + 1) numbers
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = sent.value
        k = m.projection.shape[1]
        for batch, c in _matrices(batches, 1, m.dims):
            far = scaled(whole_numbers(c), m.n, m.sums)
            z = far.astype(float)
            if (z * z).sum(axis=1).max() < 2.0**62:
                deviation = pa.array((far.astype(np.int64) ** 2).sum(axis=1))
            else:
                exact = [sum(int(e) ** 2 for e in row) for row in far]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            w = (z / m.n) @ m.projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * (len(w) + 1), k, dtype=np.int32) if k else np.zeros(len(w) + 1, np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of what transform() gives, less the identity, measured over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    n, k = model.n, model.projection.shape[1]

    def of(c: np.ndarray) -> np.ndarray:
        m: Whitening = sent.value
        return centred(whole_numbers(c), m.n, m.sums) @ m.projection

    products, total = _outer_products(rows, model.dims, of, k)
    # The components' means are 0 but for rounding; what they are is taken off.
    return float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(k)).max(initial=0.0))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold a null or non-finite entry are dropped; so are those of another length than most.
    Repeated rows count each, null ids stay null, other columns are ignored. Equal eigenvalues: the solver's order. No
    rows left, or all of them alike (no variance): no rows. Jobs run while this is called: three passes, then the result's.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    model = fit(rows, components)
    if model is None or not model.projection.shape[1]:
        return vectors.sparkSession.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(rows, model)
    found = transform(rows, model).select(F.col("id").alias(id_col), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(float(e)) for e in model.explained])
    return found.select(id_col, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
