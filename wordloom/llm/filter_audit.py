"""How quality filters act on one another: what each removes in every order, by part of the corpus.

A document's failures are a mask of one bit a filter. All that any order of the filters does to a part
follows from its cells, the counts of documents by mask: the documents are read once, and what is left are
at most 2 ^ filters cells a part. Orders are visited by plain changes: each differs from the one before by a
swap of two neighbours, so only those two steps are computed anew. A filter's Shapley sum grows along the
walk: what it removes is added, times the number of orders for which that held, when it changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import text_of, written

#: Parts whose walk is held at once.
PARTS = 256
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and \\x09 to \\x0D, case kept."""
    return F.array_remove(F.split(text, r"[ \x09-\x0D]"), "")


#: Letter and failure condition, over the columns text and words; a filter's bit is its place.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.size("words") < 200,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
    "C": lambda: 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"),
    "D": lambda: F.col("text").rlike("[#$%&*|]"),
}
DUPLICATE = "E"  # the last filter: the text is that of a smaller id


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict | None = None) -> DataFrame:
    """id, part, mask of every row. The last bit: the row's text is also that of a row with a smaller id.

    Texts are the same if SHA-256 and length are. A null id is smaller than none, and none is smaller than it. Rows with
    one id and one text don't make each other fail. The way back from a text's smallest id is by (digest, id), which
    spreads a text that a third of the rows have.
    """
    filters = FILTERS if filters is None else filters
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_of(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    bits = [F.when(failing(), 1 << k).otherwise(0) for k, failing in enumerate(filters.values())]
    own = sum(bits, F.lit(0))
    rows = written(texts.select("id", "part", own.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("n")), "audit-rows")
    first = rows.where("id is not null").groupBy("digest", "n").agg(F.min("id").alias("id")).withColumn("first", F.lit(0))
    last = 1 << len(filters)
    known = rows.where("id is not null").join(first, ["digest", "n", "id"], "left")
    marked = known.select("id", "part", (F.col("mask") + F.coalesce("first", F.lit(last))).alias("mask"))
    return marked.unionByName(rows.where("id is null").select("id", "part", "mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled quality 1 and toxic 1. A document counts once, however many labels it has."""
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # Rows of one id, part and mask are one row from here on, so an id that many rows have is one key of few rows.
    rows = masked.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    known = rows.where("id is not null").join(named, "id", "left").unionByName(rows.where("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    sums = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return known.groupBy("part", "mask").agg(F.sum("n").alias("n"), *sums)


def adjacent_swaps(k: int) -> Iterator[int]:
    """Places i whose entries i and i + 1 change, in turn, so that each order of k things comes once (plain changes)."""
    if k > 1:
        down = True
        for inner in (*adjacent_swaps(k - 1), None):
            yield from range(k - 2, -1, -1) if down else range(k - 1)
            if inner is not None:
                yield inner + down
            down = not down


def walk(table: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of k filters, and counts by (part, order, step, COUNTS), of cells by (part, mask, (n, good, toxic))."""
    mask = np.arange(1 << k)
    parts, total = len(table), factorial(k)
    out = np.zeros((parts, total, k, len(COUNTS)), np.int64)
    shapley, since = np.zeros((parts, k), np.int64), [0] * k

    def step(f: int, before: int) -> np.ndarray:
        hit, clear = (mask >> f) & 1 == 1, mask & before == 0
        lost = table[:, hit & clear].sum(axis=1)
        kept = table[:, clear & ~hit, 0].sum(axis=1)
        return np.stack([kept, lost[:, 0], table[:, hit & ~clear, 0].sum(axis=1), table[:, 1 << f, 0], lost[:, 1], lost[:, 2]], axis=1)

    order = list(range(k))
    steps = [step(f, (1 << f) - 1) for f in order]
    orders = [tuple(order)]
    for s in range(k):
        out[:, 0, s, :6] = steps[s]
    for at, i in enumerate(adjacent_swaps(k), 1):
        for s in (i, i + 1):
            f = order[s]
            shapley[:, f] += steps[s][:, 1] * (at - since[f])
            since[f] = at
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        steps[i], steps[i + 1] = step(order[i], before), step(order[i + 1], before | 1 << order[i])
        orders.append(tuple(order))
        for s in range(k):
            out[:, at, s, :6] = steps[s]
    for s, f in enumerate(order):
        shapley[:, f] += steps[s][:, 1] * (total - since[f])
    for at, found in enumerate(orders):
        out[:, at, :, 6] = shapley[:, list(found)]
    return orders, out


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and COUNTS for every part of cells(), all orders of the letters and all steps, zeros included."""
    k = len(letters)
    rows = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ^ k at most
    names = ["part", "filter_order", "step", *COUNTS]
    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, PARTS) for whole in batches for a in range(0, whole.num_rows, PARTS)):
            table = np.zeros((batch.num_rows, 1 << k, 3), np.int64)
            for p, found in enumerate(batch.column(1).to_pylist()):
                for c in found:
                    table[p, c["mask"]] = c["n"], c["good"], c["toxic"]
            orders, out = walk(table, k)
            each = len(orders) * k
            called = np.repeat(["".join(letters[f] for f in o) for o in orders], k)
            for p, part in enumerate(batch.column(0).to_pylist()):
                flat = out[p].reshape(each, len(COUNTS))
                columns = [pa.array([part] * each, pa.string()), pa.array(called, pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(flat[:, c])) for c in range(len(COUNTS))], schema=schema)

    kinds = ["string", "string", "int"] + ["long"] * len(COUNTS)
    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """interactions() of FILTERS and DUPLICATE over all documents.

    Null text: empty (fails A alone, and E from its second id on). Null part: the part ''. Null or unlabelled ids: neither good
    nor toxic. Repeated rows count each; with one id and text they don't fail E by each other. Empty table: no
    parts, so no rows. Columns that aren't named are ignored.
    """
    return interactions(cells(masks(docs, id_col, text_col, part_col), labels, id_col), "".join(FILTERS) + DUPLICATE)
