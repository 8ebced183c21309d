"""Benchmark decontamination by SimHash of item-sized windows, DataFrame operations only.

1. Words are runs of letters and digits in lower case; shingles are SHINGLE consecutive words, hashed.
2. A window of an item's size can only match if it shares enough shingles with it, in any order. A
   window can be moved on to the first shingle that it has in common without losing one, up to the
   document's end; so the last of the best windows begins with a shared shingle or is the document's
   last one. Looked at are all of these that hold enough shared shingles for the threshold; a document
   smaller than the item is one window.
3. Windows and items get 64-bit SimHash fingerprints, weighted by how often a shingle occurs. A
   fingerprint is cut into RADIUS + 1 blocks, so any two within RADIUS bits agree in a block: windows
   meet the items of their size that agree in a block, each pair in the first such block alone, and
   Hamming distances decide.
4. What is within the radius is verified by exact weighted similarity of the shingle multisets:
   the sum of the smaller counts over the sum of the larger ones.

At similarity 0.8 fingerprints differ in 10 of 64 bits on average (standard deviation 2.9); RADIUS
leaves more than three deviations above that, and copies differ in none. With so wide a radius no
complete block index is selective by itself (blocks of 13 bits, each looked up in its ball of 4 bits,
would still let two of three random pairs meet): it is step 2 that keeps windows few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import text_of, written

SHINGLE = 5
THRESHOLD = 80  # per cent
RADIUS = 20
SENT_SHINGLES = 1_000_000  # so many item shingles, 32 MB at most, may be broadcast
SENT_WINDOWS = 500_000
LAST = 2**31 - 1  # begins beyond any text: moved inside, the last window


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in order; none if there are fewer words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    # The hashes are computed once, as the argument of a lambda over a one-element array.
    each = F.transform(F.array(hashes), lambda h: F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(SHINGLE)])))
    return F.get(each, F.lit(0))


def fingerprint(shingles: str) -> Column:
    """64-bit SimHash of an array column: bit b is set if it is set in more than half of the hashes."""
    ones = f"aggregate({shingles}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(if(2 * {ones} > size({shingles}), 1L, 0L), b))")


def blocks(fp: str) -> Column:
    """The RADIUS + 1 blocks of a fingerprint, as an array; the last one takes the bits that are left."""
    width = 64 // (RADIUS + 1)
    mask = (1 << width) - 1
    parts = [f"shiftrightunsigned({fp}, {b * width}) & {mask}L" for b in range(RADIUS)] + [f"shiftrightunsigned({fp}, {RADIUS * width})"]
    return F.expr(f"array({', '.join(parts)})")


def common(x: str, y: str) -> Column:
    """Sum of the smaller counts of two arrays' elements; arrays without repeats need no counting."""
    count = lambda a: f"size(filter({a}, e -> e = d))"
    plain = f"size(array_distinct({x})) = size({x}) and size(array_distinct({y})) = size({y})"
    return F.expr(f"if({plain}, size(array_intersect({x}, {y})), aggregate(array_intersect({x}, {y}), 0, (s, d) -> s + least({count(x)}, {count(y)})))")


def _sent(df: DataFrame, size: int, most: int) -> DataFrame:
    """Broadcast only what has been counted; beyond the bound the join shuffles."""
    return F.broadcast(df) if size <= most else df


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """id, item_id, start, n_words, similarity: for each document and item that it holds, the best of all windows.

    start: its first word, from 0; of equally similar windows the last. Documents and items with
    fewer than SHINGLE words, null or empty texts: match nothing. Null ids match as one another;
    repeated rows give the result once. Empty tables: no rows. Other columns are ignored.
    """
    known = written(
        items.select(F.col(item_col).alias("item"), shingles_of(words_of(text_of(item_text_col))).alias("own"))
        .where(F.size("own") > 0).distinct().select("item", "own", F.size("own").alias("n"), fingerprint("own").alias("fp")),
        "items",
    )
    places = known.select("n", F.explode("own").alias("h")).distinct()
    size = places.count()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    here = texts.select("id", F.posexplode(shingles_of(words_of(F.col("text")))).alias("pos", "h"))
    met = here.join(_sent(places, size, SENT_SHINGLES), "h").groupBy("id", "n").agg(F.sort_array(F.collect_set("pos")).alias("shared"))
    # A window of p <= n shingles with c in common, c >= t * (p + n - c), needs c >= t * n.
    some = met.where(100 * F.size("shared") >= THRESHOLD * F.col("n"))
    starts = written(some.select("id", "n", F.explode(F.concat(_crowded(), F.array(F.lit(LAST)))).alias("begin")), "windows")
    windows = _sent(starts, starts.count(), SENT_WINDOWS).select(F.col("id").alias("wid"), "begin", "n")
    # Only the documents that have windows are cut into words again; a document's windows are made one by one.
    per = texts.join(windows, F.col("id").eqNullSafe(F.col("wid"))).groupBy("id", "text").agg(F.collect_set(F.struct("begin", "n")).alias("ws"))
    cut = per.select("id", F.explode(_windows(shingles_of(words_of(F.col("text"))), F.col("ws"))).alias("w")).select("id", "w.*")
    marked = cut.where(F.size("part") > 0).select("id", "begin", "n", "part", fingerprint("part").alias("wfp"))
    keyed = marked.select("*", F.posexplode(blocks("wfp")).alias("block", "bits"))
    index = known.select("item", "own", "n", "fp", F.posexplode(blocks("fp")).alias("block", "bits"))
    met_first = F.array_position(F.zip_with(blocks("wfp"), blocks("fp"), lambda x, y: x == y), True) == F.col("block") + 1
    near = keyed.join(_sent(index, size, SENT_SHINGLES), ["n", "block", "bits"]).where((F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))) <= RADIUS) & met_first)
    both = near.select("id", "item", F.col("begin").alias("start"), F.size("part").alias("p"), F.size("own").alias("o"), common("part", "own").alias("c"))
    similar = both.where(100 * F.col("c") >= THRESHOLD * (F.col("p") + F.col("o") - F.col("c"))).select(
        "id", "item", "start", (F.col("p") + SHINGLE - 1).alias("words"), (F.col("c") / (F.col("p") + F.col("o") - F.col("c"))).alias("similarity")
    )
    best = similar.groupBy("id", "item").agg(F.max(F.struct("similarity", "start", "words")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.start").cast("long").alias("start"), F.col("b.words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def _crowded() -> Column:
    """Of the sorted places ``shared``, those from which a window of n shingles holds enough of them.

    With c shingles in common, c >= t * (2n - c) asks for c >= 2nt / (1 + t). Shorter texts are one
    window, the last.
    """
    need = f"cast(ceil({2 * THRESHOLD} * n / {100 + THRESHOLD}) as int)"
    return F.expr(f"filter(shared, (p, k) -> get(shared, k + {need} - 1) <= p + n - 1)")


def _windows(shingles: Column, starts: Column) -> Column:
    """array<struct<begin, n, part>>: part is n shingles from begin on, moved inside the text; all of a shorter text."""

    def all_of(h: Column) -> Column:
        inside = F.transform(starts, lambda w: F.struct(F.greatest(F.least(w["begin"], F.size(h) - w["n"]), F.lit(0)).alias("begin"), w["n"].alias("n")))
        return F.transform(F.array_distinct(inside), lambda w: F.struct(w["begin"].alias("begin"), w["n"].alias("n"), F.slice(h, w["begin"] + 1, w["n"]).alias("part")))

    return F.get(F.transform(F.array(shingles), all_of), F.lit(0))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """The rows of docs that hold no item, whole and with their columns.

    Rows are told apart by id and text together, so null and repeated ids lose nothing clean.
    """
    key = F.xxhash64(F.col(id_col), text_of(text_col))
    bare = docs.select(key.alias("row_key"), F.col(text_col).alias("text"))
    bad = contaminated(bare, items, "row_key", "text", item_col, item_text_col).select("row_key").distinct()
    return docs.join(bad, key == bad["row_key"], "left_anti")
