"""Sums of pairs by runs: tasks add up what they meet before anything is shuffled, and shuffle sorted keys as their gaps.

A task pairs its tokens (places shifted against each other by 1 to window), sorts the pairs and adds up equal ones: a
run. It holds its runs as bytes and adds them up too, so that of a pair that a task meets often one sum goes on. Pair keys
are whole numbers; a coding says which, and so to which bucket a pair goes: buckets are ranges of keys. Of a bucket's part
of a task's sums only the gaps between its sorted keys are sent, and a byte for the distance of what was met once. A
bucket's final sums are made by one task; the number of buckets grows with the tokens, so a bucket doesn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of one line that are paired in one group; the last ones before a border stand in the next group too.
PIECE = 1 << 16
TASK_PAIRS = 256_000_000  # of a task, about, where tokens are dealt to tasks
MOST_PAIRS = 8_000_000  # that a task sorts at once
HELD_BYTES = 160 << 20  # of a task's runs; beyond that they are added up, and sent if that leaves more than half
CHUNKS = 64  # in which runs are added up
BUCKET_PAIRS = 8_000_000  # of a bucket, before runs are added up
MERGED = 4_000_000  # sums that are added up at once, beside those of the bucket
TASK_TOKENS = 50_000  # that make a task of their own, for parallel work on small tables
OUT_ROWS = 1 << 17
MIX = 0x9E3779B97F4A7C15
CODEC = pa.Codec("zstd", 1)

PIECES = pa.schema([("row", pa.int64()), ("line", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
BLOBS = pa.schema([("bucket", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
SUMS = pa.schema([("word1", pa.int32()), ("word2", pa.int32()), ("units", pa.int64())])

#: Keys in order, the distance of those met once (else 0), and sums.
Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def squeezed(raw: bytes) -> bytes:
    return CODEC.compress(raw, asbytes=True)


def unsqueezed(data: bytes | pa.Buffer, size: int) -> bytes:
    return CODEC.decompress(data, size, asbytes=True)


def fits(window: int, most_id: int) -> bool:
    """Whether a pair and its distance go into one whole number of 64 bits, and sums of units stay far below that."""
    return window <= 22 and 2 * int(most_id).bit_length() + window.bit_length() <= 64


# --- codings ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Mixed:
    """Keys mixed by an odd factor (which can be undone): their first bits deal them to buckets of like size."""

    bits: int
    bucket_bits: int

    @property
    def key_bits(self) -> int:
        return 2 * self.bits

    def edges(self) -> np.ndarray:
        return np.arange(1 << self.bucket_bits, dtype=np.uint64) << np.uint64(2 * self.bits - self.bucket_bits)

    def prepared(self, ids: np.ndarray) -> np.ndarray:
        return np.stack([(ids << np.uint64(self.bits)) * np.uint64(MIX), ids * np.uint64(MIX)])

    def keys(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return (one[0] + two[1]) & np.uint64((1 << 2 * self.bits) - 1)

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys * np.uint64(pow(MIX, -1, 1 << 2 * self.bits)) & np.uint64((1 << 2 * self.bits) - 1)
        return keys >> np.uint64(self.bits), keys & np.uint64((1 << self.bits) - 1)


@dataclass(frozen=True)
class Ordered:
    """Keys in the order of word1 and word2; begins: the first word1 of each bucket."""

    bits: int
    begins: tuple[int, ...]

    @property
    def key_bits(self) -> int:
        return 2 * self.bits

    def edges(self) -> np.ndarray:
        return np.array(self.begins, np.uint64) << np.uint64(self.bits)

    def prepared(self, ids: np.ndarray) -> np.ndarray:
        return np.stack([ids << np.uint64(self.bits), ids])

    def keys(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return one[0] | two[1]

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> np.uint64(self.bits), keys & np.uint64((1 << self.bits) - 1)


@dataclass(frozen=True)
class Celled:
    """Buckets are cells: the remainders of word1 and word2 by the number of parts. Ids by rank are dealt to parts of like weight.

    sub_bits: a cell is so many bits' worth of buckets, dealt evenly by a sum of both words' hashes.
    """

    parts: int
    most_id: int
    sub_bits: int = 0

    @property
    def width(self) -> int:
        return int(self.most_id) // self.parts + 1

    @property
    def key_bits(self) -> int:
        return max(1, (((self.parts * self.width) ** 2 << self.sub_bits) - 1).bit_length())

    def edges(self) -> np.ndarray:
        return np.arange(self.parts**2 << self.sub_bits, dtype=np.uint64) * np.uint64(self.width**2)

    def prepared(self, ids: np.ndarray) -> np.ndarray:
        within, part = np.divmod(ids, np.uint64(self.parts))
        size = np.uint64(self.width**2 << self.sub_bits)
        kept = [part * np.uint64(self.parts) * size + within * np.uint64(self.width), part * size + within]
        # The first bits of a hash of the word, which are added up for a pair.
        return np.stack([*kept, ids * np.uint64(MIX) >> np.uint64(64 - self.sub_bits)] if self.sub_bits else kept)

    def keys(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one[0] + two[1]
        if self.sub_bits:
            key += (one[2] + two[2] * np.uint64(3) & np.uint64((1 << self.sub_bits) - 1)) * np.uint64(self.width**2)
        return key

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, keys = np.divmod(keys, np.uint64(self.width**2))
        p, q = np.divmod(bucket >> np.uint64(self.sub_bits), np.uint64(self.parts))
        one, two = np.divmod(keys, np.uint64(self.width))
        return one * np.uint64(self.parts) + p, two * np.uint64(self.parts) + q


@dataclass(frozen=True)
class Shuffled:
    """Buckets are ranges of xxhash64 of seed, word1 and word2, in ascending order."""

    bits: int
    bucket_bits: int
    seed: int

    @property
    def key_bits(self) -> int:
        return 2 * self.bits + self.bucket_bits

    def edges(self) -> np.ndarray:
        return np.arange(1 << self.bucket_bits, dtype=np.uint64) << np.uint64(2 * self.bits)

    def prepared(self, ids: np.ndarray) -> np.ndarray:
        return ids[None]

    def keys(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one[0] << np.uint64(self.bits) | two[0]
        if not self.bucket_bits:
            return key
        at = (pair_hash(self.seed, one[0], two[0]).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - self.bucket_bits)
        return key | at << np.uint64(2 * self.bits)

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.uint64((1 << self.bits) - 1)
        return keys >> np.uint64(self.bits) & low, keys & low


Coding = Mixed | Ordered | Celled | Shuffled


def pair_hash(seed: int, word1: np.ndarray, word2: np.ndarray) -> np.ndarray:
    """xxhash64(seed, word1, word2) of ints, as Spark's function of that name gives it."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = np.full(1, 42, np.uint64)
    for x in (np.array([seed & 0xFFFFFFFF], np.uint64), word1.astype(np.uint64), word2.astype(np.uint64)):
        h = (h + p5 + np.uint64(4)) ^ (x * p1)
        h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        h = h ^ h >> np.uint64(32)
    return h.view(np.int64)


# --- pieces ----------------------------------------------------------------------------------------------


def _binary(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each [begin, end), as bytes; the parts follow each other without gaps."""
    at = np.append(begins, ends[-1:]).astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at), pa.py_buffer(ids.astype("<i4"))])


def pieces(ids: DataFrame, window: int) -> DataFrame:
    """row, line, block, first, ids of tokens (row, line, pos, id) in any order: ids at first, first + 1, ... Those from which window reaches into the next block stand there too."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, line, pos, own = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            new = (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | (pos[1:] != pos[:-1] + 1) | (pos[1:] % PIECE == 0)
            begins = np.append(0, np.flatnonzero(new) + 1)
            ends = np.append(begins[1:], len(pos))
            yield pa.RecordBatch.from_arrays([row[begins], line[begins], pos[begins] // PIECE, pos[begins], _binary(own, begins, ends)], schema=PIECES)
            last = np.flatnonzero(pos % PIECE >= PIECE - window)
            if len(last):
                ones = np.arange(len(last))
                yield pa.RecordBatch.from_arrays([row[last], line[last], pos[last] // PIECE + 1, pos[last], _binary(own[last], ones, ones + 1)], schema=PIECES)

    return ids.select("row", "line", "pos", "id").mapInArrow(cut, "row long, line long, block long, first long, ids binary")


# --- runs ------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Number, width and bytes of whole numbers, all first bytes before all second ones."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    values = values.astype(np.uint64)
    planes = [(values >> np.uint64(8 * k)).astype(np.uint8) for k in range(width)]
    return b"".join([np.array([len(values), width], "<i8").tobytes(), *planes])


def _unplanes(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    n, width = (int(x) for x in np.frombuffer(data, "<i8", 2, at))
    values = np.zeros(n, np.uint64)
    for k in range(width):
        values |= np.frombuffer(data, np.uint8, n, at + 16 + k * n).astype(np.uint64) << np.uint64(8 * k)
    return values, at + 16 + n * width


def _packed(sums: Sums, begin: int) -> tuple[int, bytes]:
    """Length and squeezed bytes of sums whose keys are begin at least."""
    keys, single, units = sums
    gaps = np.diff(keys, prepend=np.uint64(begin))
    raw = b"".join([_planes(gaps), single.tobytes(), _planes(units[single == 0])])
    return len(raw), squeezed(raw)


def _unpacked(size: int, data: bytes | pa.Buffer, begin: int, units: np.ndarray) -> Sums:
    raw = memoryview(unsqueezed(data, size))
    gaps, at = _unplanes(raw, 0)
    single = np.frombuffer(raw, np.uint8, len(gaps), at)
    sums = units[single]
    more, _ = _unplanes(raw, at + len(gaps))
    sums[single == 0] = more.astype(np.int64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(begin), single, sums


def added(parts: list[Sums]) -> Sums:
    """Sums of equal keys added up."""
    if len(parts) == 1:
        return parts[0]
    keys, single, units = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, single, units = keys[order], single[order], units[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if len(starts) == len(keys):
        return keys, single, units
    alone = np.diff(np.append(starts, len(keys))) == 1
    return keys[starts], np.where(alone, single[starts], 0).astype(np.uint8), np.add.reduceat(units, starts)


class Runs:
    """What a task has met of pairs, as runs. both: each pair in both directions; unordered: the smaller word first."""

    def __init__(self, coding: Coding, window: int, units: np.ndarray, both: bool = False, unordered: bool = False):
        self.coding, self.window, self.units, self.both, self.unordered = coding, window, units, both, unordered
        self.bucket_edges = coding.edges()
        self.chunk_edges: np.ndarray | None = None
        self.held: list[list[tuple[int, bytes]]] = []
        self.size = 0
        self.tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, ids: np.ndarray, places: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """places ascend, and more than window lies between lines. own: whether a token counts as the right one of a pair. Gives what may be sent."""
        step = max(1, MOST_PAIRS // (self.window * (2 if self.both else 1)))
        for k in range(0, len(ids), step):
            self.tokens.append((ids[k : k + step], places[k : k + step], own[k : k + step]))
            self.n += len(ids[k : k + step])
            if self.n >= step:
                self._hold(self._run())
                if self.size > HELD_BYTES:
                    yield from self._add_up(HELD_BYTES // 2)

    def rest(self) -> Iterator[pa.RecordBatch]:
        found = self._run()
        if not self.held:
            yield from self._sent([found])
        else:
            self._hold(found)
            yield from self._add_up(-1)

    def _run(self) -> Sums:
        """The sums of the tokens so far; the last ones stay as left sides of pairs to come, as they were right ones already."""
        if not self.tokens:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        ids, places, own = (np.concatenate(c) for c in zip(*self.tokens, strict=True))
        w, shift = self.window, np.uint64(self.window.bit_length())
        self.tokens, self.n = [(ids[-w:], places[-w:], np.zeros(len(ids[-w:]), bool))], 0
        given, n = self.coding.prepared(ids), 0
        far = np.empty(w * len(ids) * (2 if self.both else 1), np.uint64)
        for s in range(1, min(w, len(ids) - 1) + 1):
            distance = (places[s:] - places[:-s]).astype(np.uint64)
            met = (distance <= w) & own[s:]
            one, two = given[:, :-s], given[:, s:]
            if self.unordered:
                some = (np.where(ids[:-s] > ids[s:], self.coding.keys(two, one), self.coding.keys(one, two)),)
            else:
                some = (self.coding.keys(one, two), self.coding.keys(two, one)) if self.both else (self.coding.keys(one, two),)
            for key in some:
                key = (key << shift | distance)[met]
                far[n : n + len(key)] = key
                n += len(key)
        keys = far[:n]
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
        keys.sort()
        distance = (keys & np.uint64((1 << int(shift)) - 1)).astype(np.uint8)
        keys >>= shift
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        once = np.diff(np.append(starts, len(keys))) == 1
        return keys[starts], np.where(once, distance[starts], np.uint8(0)), np.add.reduceat(self.units[distance], starts)

    def _hold(self, found: Sums) -> None:
        keys = found[0]
        if not len(keys):
            return
        if self.chunk_edges is None:
            inner = keys[np.linspace(0, len(keys), CHUNKS, endpoint=False).astype(int)[1:]]
            self.chunk_edges = np.append(np.uint64(0), np.unique(inner[inner > 0]))
        at = np.append(np.searchsorted(keys, self.chunk_edges), len(keys))
        self.held.append([_packed(tuple(c[at[k] : at[k + 1]] for c in found), int(e)) for k, e in enumerate(self.chunk_edges)])
        self.size += sum(len(data) for _, data in self.held[-1])

    def _chunks(self) -> Iterator[tuple[int, Sums]]:
        """The runs added up, chunk by chunk; each is let go when it was given."""
        for k, e in enumerate(self.chunk_edges):
            found = added([_unpacked(*run[k], int(e), self.units) for run in self.held])
            for run in self.held:
                run[k] = (0, b"")
            yield int(e), found

    def _add_up(self, most: int) -> Iterator[pa.RecordBatch]:
        """Adds up the held runs, and sends them if more than so many bytes are left."""
        if most < 0:
            yield from self._sent(found for _, found in self._chunks())
            self.held, self.size = [], 0
            return
        whole = [_packed(found, e) for e, found in self._chunks()]
        self.held, self.size = [whole], sum(len(data) for _, data in whole)
        if self.size > most:
            yield from self._add_up(-1)

    def _sent(self, parts) -> Iterator[pa.RecordBatch]:
        """Sums by buckets. A bucket of two parts comes twice."""
        for found in parts:
            keys = found[0]
            edges = np.append(np.searchsorted(keys, self.bucket_edges), len(keys))
            out: tuple[list, list, list] = ([], [], [])
            for b in np.flatnonzero(np.diff(edges)):
                size, data = _packed(tuple(c[edges[b] : edges[b + 1]] for c in found), int(self.bucket_edges[b]))
                for column, x in zip(out, (b, size, data), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, BLOBS.types, strict=True)], schema=BLOBS)


def line_runs(cut: DataFrame, tasks: int, made: Callable[[], Runs]) -> DataFrame:
    """bucket, size, data: sums of the pairs of pieces() that a task met, by buckets."""
    schema = "bucket int, size long, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = made()
        window, base, last, upto = runs.window, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, line, block, first = (c.to_numpy() for c in batch.columns[:4])
            data = batch.column(4)
            sizes = np.diff(np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, 4 * data.offset)) // 4
            start = np.frombuffer(data.buffers()[1], np.int32, 1, 4 * data.offset)[0]
            ids = np.frombuffer(data.buffers()[2], "<i4", int(sizes.sum()), start).astype(np.uint64)
            new = np.append(last != (row[0], line[0], block[0]), (row[1:] != row[:-1]) | (line[1:] != line[:-1]) | (block[1:] != block[:-1]))
            # A group's places follow the ones of the group before, more than window away.
            ends = np.append(upto, first + sizes)[:-1]
            ends[0] = upto
            jump = np.where(new, ends + window + 1 - first, 0)
            shift = base + np.cumsum(jump)
            inner = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            pos = np.repeat(first, sizes) + inner
            yield from runs.add(ids, pos + np.repeat(shift, sizes), pos // PIECE == np.repeat(block, sizes))
            base, last, upto = int(shift[-1]), (row[-1], line[-1], block[-1]), int(first[-1] + sizes[-1])
        yield from runs.rest()

    dealt = cut.repartition(tasks, "row", "line", "block").sortWithinPartitions("row", "line", "block", "first")
    return dealt.mapInArrow(run, schema)


# --- buckets ---------------------------------------------------------------------------------------------


def bucket_total(blobs: Iterator[tuple[int, bytes | pa.Buffer]], begin: int, units: np.ndarray) -> Sums:
    """The sums of a bucket, of its blobs (size, data); begin: its first key."""
    held: list[Sums] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))]
    n = 0
    for size, data in blobs:
        held.append(_unpacked(size, data, begin, units))
        n += len(held[-1][0])
        if n > MERGED:
            held, n = [added(held)], 0
    return added(held)


def blob_rows(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple]:
    """Rows of batches as tuples; the bytes of the last column aren't copied."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns[:-1]), (x.as_buffer() for x in batch.column(batch.num_columns - 1)), strict=True)


def bucket_rows(found: DataFrame, coding: Coding, units: np.ndarray, given: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that given makes of word1, word2 and units of each bucket's sums; a bucket is a partition, in the order of buckets."""
    edges = coding.edges()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[int] = []

        def blobs():
            for b, size, data in blob_rows(batches):
                if not bucket:
                    bucket.append(b)
                yield size, data

        # All blobs of a partition are of one bucket, so that of the first one tells where its keys begin.
        rows = blobs()
        first = next(rows, None)
        if first is None:
            return
        keys, _, sums = bucket_total((x for part in ((first,), rows) for x in part), int(edges[bucket[0]]), units)
        columns = given(*coding.words(keys), sums)
        for k in range(0, len(columns[0]), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + OUT_ROWS]) for c in columns], schema=schema)

    return found.repartitionById(len(edges), "bucket").mapInArrow(add, ddl)


def bucket_count(pairs: int) -> int:
    """So many bits number the buckets of that many pairs."""
    return max(0, ceil(pairs / BUCKET_PAIRS) - 1).bit_length()


def mixed(n: int, most_id: int, window: int) -> Mixed:
    bits = max(1, int(most_id).bit_length())
    return Mixed(bits, min(2 * bits, bucket_count(n * window)))


def task_count(ids: DataFrame, n: int, window: int) -> int:
    cores = ids.sparkSession.sparkContext.defaultParallelism
    return max(1, min(2 * cores, ceil(n / TASK_TOKENS)), ceil(n * window / TASK_PAIRS))


def words_and_units(word1: np.ndarray, word2: np.ndarray, units: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((word2, word1))
    return [word1[order].astype(np.int32), word2[order].astype(np.int32), units[order]]


def summed_pairs(ids: DataFrame, n: int, most_id: int, window: int, symmetric: bool, units: list[int]) -> DataFrame:
    """word1, word2, units of n tokens (row, line, pos, id; a line's places differ), unordered pairs if symmetric. units: what distances 1 to window count."""
    weight, coding = np.array([0, *units], np.int64), mixed(n, most_id, window)
    found = line_runs(pieces(ids, window), task_count(ids, n, window), lambda: Runs(coding, window, weight, unordered=symmetric))
    return bucket_rows(found, coding, weight, words_and_units, SUMS, "word1 int, word2 int, units long")
