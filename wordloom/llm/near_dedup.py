"""Near duplicates by MinHash: banding, signature verification, full sets, connected components.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a signature of HASHES
   universal hash minima. Texts with the same set are one class from here on, kept by a digest of it.
2. Classes that agree in all ROWS minima of a band meet in a bucket. Two classes of similarity s miss
   each other in every band with probability (1 - s^ROWS)^BANDS: 1e-5 at 0.85 and 7e-4 at 0.8.
3. In every bucket all others are paired with its smallest class, so a bucket of n gives n - 1 pairs.
   Pairs whose signatures agree too little go (the bound lies five standard deviations below the
   threshold); the others are verified on the full sets, and links are joined to components.
4. What could still be linked are classes of one bucket in different components. No pairs are made of
   them: such a bucket is dealt into chunks of bounded size, each two chunks that can hold a link go
   to one task, which counts the common shingles of all its texts at once (a product of matrices) and
   returns only links that join components. Chunks of a bucket's main component don't meet one
   another, so a large group of copies costs its size, not its square. What stays quadratic, in time
   but not in rows, are the classes of one bucket that are not linked with its main component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import by_text, take_over
from wordloom.llm.components import components
from wordloom.llm.shared import text_of, written

BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
BLOCK = 500  # pairs of one class that are verified together
SALTS = 256
CHUNK_CLASSES, CHUNK_SHINGLES = 512, 1 << 19  # bounds of a bucket's chunk; a larger text is one by itself
SLICE = 2048  # shingles whose occurrences are multiplied at once
CACHED = 300_000
PIECE = 1 << 15
SENT_IDS = 1_000_000  # so many ids, 16 MB at most, may be broadcast

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


class _Hashes(dict):
    """64-bit hashes by word, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _begin() -> None:
    take_over("near_dedup", _HASHES.clear)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words the whole sequence is one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) low 16 bits of minima of multiply-add-shift hashes; no set is empty."""
    out = np.empty((len(sets), HASHES), np.uint16)
    begin = np.cumsum([0, *map(len, sets)])
    k = 0
    while k < len(sets):  # pieces that stay in the processor's cache
        e = max(k + 1, int(np.searchsorted(begin, begin[k] + PIECE, "right")) - 1)
        x, at = np.concatenate(sets[k:e]), begin[k:e] - begin[k]
        for j in range(HASHES):
            out[k:e, j] = np.minimum.reduceat((x * _MULTIPLY[j] + _ADD[j]) >> np.uint64(24), at) & np.uint64(0xFFFF)
        k = e
    return out


def least_agreement(threshold: float) -> float:
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / HASHES)


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n, digest, signature; digest and signature are null for an empty set."""

    def work(ids, texts):
        _begin()
        for g in range(0, len(ids), 200):
            sets = [shingle_set(x, k) for x in texts[g : g + 200]]
            full = [s for s in sets if len(s)]
            found = iter(signatures(full)) if full else iter(())
            for i, s in zip(ids[g : g + 200], sets, strict=True):
                if not len(s):
                    yield i, 0, None, None
                    continue
                yield i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), next(found).tobytes()

    return by_text(docs, id_col, text_col, work, "id long, n long, digest binary, signature binary", binary=True)


def _salt(col: str, parts=SALTS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


def _by_salt(salted: DataFrame, of_key: DataFrame) -> DataFrame:
    """of_key (key and others) for each salt that a key has: the way back to the rows salted (key, salt), however many a key has."""
    return salted.groupBy("key", "salt").agg(F.lit(1).alias("one")).drop("one").join(of_key, "key")


def _dealt(pairs: DataFrame) -> DataFrame:
    """a, block, b: the b of one a in blocks of about BLOCK. Counts go back by (a, salt), so no join has a hot key."""
    salted = pairs.select("a", "b", _salt("b").alias("salt"))
    part = salted.groupBy("a", "salt").agg(F.count(F.lit(1)).alias("m"))
    blocks = part.groupBy("a").agg(F.ceil(F.sum("m") / BLOCK).alias("blocks"))
    sized = part.select("a", "salt").join(blocks, "a")
    return salted.join(sized, ["a", "salt"]).select("a", F.pmod(F.xxhash64("b", F.lit(1)), F.col("blocks")).cast("int").alias("block"), "b")


def _agreeing(dealt: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, block, b) of similar sizes whose signatures agree enough for the threshold."""
    low = least_agreement(threshold)
    side = lambda c: classes.select(F.col("id").alias(c), F.col("signature").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    heads = dealt.select("a", "block").distinct().join(side("a"), "a")
    both = dealt.join(heads, ["a", "block"]).join(side("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in (3, 4))
                good = pa.array((sa == sb).mean(axis=1) >= low)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in (0, 1, 2)], names=["a", "block", "b"])

    return both.select("a", "block", "b", "sa", "sb").mapInArrow(run, "a long, block int, b long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts (id, text) with one of the ids (id, distinct). Few of them, a counted number, are sent ahead, so that only their texts are shuffled."""
    return texts.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "id", "left_semi")


def _verified(dealt: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b): of dealt pairs those with den * |both| >= num * |either| on full sets.

    A block holds a's text once, before the others', and is read as a stream, so memory is bounded and
    no a, however many pairs it has, fills one task.
    """
    heads = dealt.select("a", "block").distinct().select("a", "block", F.col("a").alias("id"), F.lit(0).alias("side"))
    members = dealt.select("a", "block", F.col("b").alias("id"), F.lit(1).alias("side")).unionByName(heads)
    with_text = members.join(_wanted(texts, written(members.select("id").distinct(), "wanted")), "id")
    grouped = with_text.repartition("a", "block").sortWithinPartitions("a", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        key, heads_ = None, []
        for batch in batches:
            a, b = [], []
            for x, block, i, side, text in _rows(batch):
                own = shingle_set(text, k)
                if side == 0:
                    heads_ = [*heads_, own] if (x, block) == key else [own]  # more than one for a repeated id only
                    key = x, block
                elif any(_linked(head, own, num, den) for head in heads_):
                    a.append(x)
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return grouped.select("a", "block", "id", "side", "text").mapInArrow(run, "a long, b long")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row by row, so that a batch's texts aren't all held twice."""
    for k in range(0, batch.num_rows, 100):
        part = batch.slice(k, 100)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, sets) numbers of common elements: occurrences of shared elements, times their transpose, SLICE elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1, SLICE):
        a, b = np.searchsorted(column, (k, k + SLICE))
        some = np.zeros((len(sets), SLICE), np.float32)
        some[owner[a:b], column[a:b] - k] = 1
        out += some @ some.T
    out[np.diag_indices(len(sets))] = [len(x) for x in sets]
    return out


def joining_links(sets: list[np.ndarray], components: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (places) of sets that are similar enough, as many as it takes to join the components that links join."""
    n = np.array([len(x) for x in sets], np.int64)
    both = common_counts(sets).astype(np.int64)
    near = den * both >= num * (n[:, None] + n - both)
    same = components[:, None] == components
    if not (near & ~same).any():
        return []
    found, left = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        stack = [start] if left[start] else []
        left[start] = False
        while stack:
            x = stack.pop()
            for reached, is_link in ((same[x] & left, False), (near[x] & left, True)):
                fresh = np.flatnonzero(reached & left)
                left[fresh] = False
                stack += fresh.tolist()
                if is_link:
                    found += [(x, int(y)) for y in fresh]
    return found


def _met(placed: DataFrame) -> DataFrame:
    """key, i, j, id, c: the rows (key, id, n, c) of buckets with more than one component c, dealt to pairs of chunks (i, j).

    A bucket's main component has its own chunks, numbered after those of the others.
    """
    per = placed.groupBy("key", "c").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"))
    whole = per.groupBy("key").agg(F.min("c").alias("main"), F.max("c").alias("hi"), F.min_by(F.struct("w", "m"), "c").alias("own"), F.sum("w").alias("w"), F.sum("m").alias("m")).where("main < hi")
    chunks = lambda w, m: F.greatest(F.ceil(w / CHUNK_SHINGLES), F.ceil(m / CHUNK_CLASSES)).cast("int")
    info = whole.select("key", "main", chunks(F.col("own.w"), F.col("own.m")).alias("of_main"), chunks(F.col("w") - F.col("own.w"), F.col("m") - F.col("own.m")).alias("of_rest"))
    salted = placed.withColumn("salt", _salt("id"))
    dealt = salted.join(_by_salt(salted, info), ["key", "salt"]).withColumn("chunk", F.when(F.col("c") == F.col("main"), F.col("of_rest") + _salt("id", F.col("of_main"))).otherwise(_salt("id", F.col("of_rest"))))
    last = F.when(F.col("c") == F.col("main"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_main")) - 1
    others = F.array_remove(F.sequence(F.lit(0), last), F.col("chunk"))
    return dealt.select("key", "id", "c", "chunk", F.explode(others).alias("other")).select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "c")


def _joining(met: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of each group (key, i, j); a task holds one group's sets."""
    with_text = met.join(_wanted(texts, written(met.select("id").distinct(), "wanted")), "id")
    grouped = with_text.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()

        def links() -> pa.RecordBatch:
            found = joining_links(sets, np.array(cs), num, den)
            return pa.RecordBatch.from_arrays([pa.array([ids[p[s]] for p in found], pa.int64()) for s in (0, 1)], names=["a", "b"])

        at, ids, cs, sets = None, [], [], []
        for batch in batches:
            for *key, i, c, text in _rows(batch):
                if key != at:
                    if at is not None:
                        yield links()
                    at, ids, cs, sets = key, [], [], []
                ids.append(i)
                cs.append(c)
                sets.append(shingle_set(text, k))
        if at is not None:
            yield links()

    return grouped.select("key", "i", "j", "id", "c", "text").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept: a row for each row of docs.

    Texts with |A and B| * den >= num * |A or B| are linked; component_id is the smallest id that can be
    reached, kept holds for that row. Null or empty text, or one without words: an empty set, linked
    with nothing. A null id is linked with nothing, its component_id is null and it is kept. Rows with
    the same id count as one node: if their texts differ, what either links is linked. Equal
    texts have no links among themselves but share a class. Empty table: no rows. Other columns are
    ignored. Whole texts are read, of any length.
    """
    threshold = num / den
    signed = written(_signed(docs, id_col, text_col, k), "signed")
    real = signed.where("n > 0 and id is not null").withColumn("salt", _salt("id"))
    # One class for each distinct set, named by its smallest id.
    part = real.groupBy("digest", "salt").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = written(part.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes")
    band = lambda b: F.xxhash64(F.substring(F.col("signature"), b * 2 * ROWS + 1, 2 * ROWS), F.lit(b))
    rows = classes.select("id", "n", F.explode(F.array(*[band(b) for b in range(BANDS)])).alias("key"))
    heads = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").drop("z")
    bucketed = written(rows.join(heads, "key").select("key", "a", "id", "n"), "buckets")
    texts = docs.select(F.col(id_col).alias("id"), F.encode(text_of(text_col), "UTF-8").alias("text")).where("id is not null")
    dealt = written(_dealt(bucketed.where("a < id").select("a", F.col("id").alias("b")).distinct()), "dealt")
    links = written(_verified(written(_agreeing(dealt, classes, threshold), "pairs"), texts, k, num, den), "links")
    found = components(links)
    # What can still be linked: classes of one bucket in different components.
    placed = bucketed.select("key", "id", "n").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    more = written(_joining(written(_met(placed), "met"), texts, k, num, den).distinct(), "joining")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    named = classes.select("id", "digest").join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    # A text that fills a third of the rows is one digest: its component goes back by (digest, salt).
    salted = real.select("digest", "salt").distinct().join(named, "digest")
    with_class = real.select("id", "n", "digest", "salt").join(salted, ["digest", "salt"]).select("id", "n", "component")
    out = with_class.unionByName(signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, whole and with their columns: of each component that of the smallest id.

    Rows are told apart by id and text together: of rows with one id, those with other texts are judged
    by themselves. Null ids come after all others, and are deduplicated too; of equal ids the smallest
    key stays. Rows equal in id and text stay or go together. Texts without words stay.
    """
    key = F.xxhash64(F.col(id_col), text_of(text_col))
    found = near_duplicates(docs.select(key.alias("row_key"), F.col(text_col).alias("text")), k, num, den, "row_key", "text").where("n_shingles > 0")
    who = docs.select(key.alias("row_key"), F.col(id_col).alias("id")).distinct()
    rows = written(found.select("row_key", F.col("component_id").alias("component")).distinct().join(who, "row_key"), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("f"))
    gone = rows.join(first.select(F.col("f.row_key").alias("row_key")), "row_key", "left_anti").select("row_key")
    return docs.join(gone, key == gone["row_key"], "left_anti")
