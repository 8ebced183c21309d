"""Weighted co-occurrence of vocabulary words within a line."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, lcm

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.config import CooccurOptions
from wordloom.functions.text import MAX_BYTES, piece_tokens, tokens
from wordloom.operators import pair_runs
from wordloom.operators.places import running
from wordloom.sources.tables import written

#: So many bytes of vocabulary may be broadcast; a larger one is joined by shuffling.
SENT_BYTES = 128 << 20
WORD_BYTES = 40  # that a row takes beside its word
#: Positions of one line that are numbered in one task; a longer line is numbered in blocks.
LONG = 1 << 16
BLOCK_BYTES = 40  # of a block's row, where it is sent to all tasks
#: Text that a task looks up at once; each time costs a pass over the vocabulary.
LOOKUP_BYTES = 16 << 20
SENT_WORD_BYTES = 16  # of a word in an Arrow table, beside its letters
#: Positions of one line that are joined in one group; neighbours across the border meet in the next one.
BLOCK = 512


def may_be_sent(known: DataFrame) -> bool:
    """Whether the bytes of a written vocabulary (word, id) allow sending it to all tasks."""
    size = known.agg(F.sum(F.octet_length("word").cast("long") + WORD_BYTES)).first()[0] or 0
    return size <= SENT_BYTES


def sendable(known: DataFrame) -> DataFrame:
    """A vocabulary (word, id), written, and marked for broadcast if its bytes allow it."""
    known = written(known, "vocabulary")
    return F.broadcast(known) if may_be_sent(known) else known


def before_blocks(sizes: DataFrame) -> DataFrame:
    """row, line, block, base: what stands in a line before a block, of sizes (row, line, block, size); marked for broadcast if small."""
    upto = running(sizes, ["row", "line", "block"], "size", "upto")
    firsts = upto.groupBy("row", "line").agg(F.min("upto").alias("first"))
    base = written(upto.join(firsts, ["row", "line"]).select("row", "line", "block", (F.col("upto") - F.col("first")).alias("base")), "blocks")
    return F.broadcast(base) if base.count() * BLOCK_BYTES <= SENT_BYTES else base


def compacted(kept: DataFrame) -> DataFrame:
    """The rows of kept (row, line, block, pos, id, long and others) with pos counted anew within the line, from 0.

    Positions are numbered within a block of the line, so no line is one task, and written. What stands before a
    block is a sum over the counts of the line's blocks: for lines of several blocks (long) only, by prefix sums
    over all tasks.
    """
    within = F.row_number().over(Window.partitionBy("row", "line", "block").orderBy("pos")).cast("long") - 1
    table = written(kept.withColumn("pos", within), "ids")
    columns = [c for c in kept.columns if c not in ("block", "long")]
    if table.where("long").isEmpty():
        return table.select(*columns)
    sizes = table.where("long").groupBy("row", "line", "block").agg(F.count(F.lit(1)).alias("size"))
    found = table.join(before_blocks(sizes), ["row", "line", "block"], "left")
    return found.withColumn("pos", F.col("pos") + F.coalesce("base", F.lit(0))).select(*columns)


def encoded(corpus: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, line, pos, id. Words out of the vocabulary go first, so pos counts those that are left.

    Lines are those of a corpus row (row, see tokens), whatever its doc_id: repeated and null ids give
    each row's lines by themselves. Jobs run while this is called: the vocabulary and the ids are computed
    once, into tables.
    """
    found = tokens(corpus, id_col, text_col, LONG).join(sendable(vocab.select("word", "id")), "word")
    return compacted(found.select("doc_id", "row", "line", F.floor(F.col("pos") / LONG).alias("block"), "pos", "id", "long"))


def encoded_pieces(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """row, line, pos, id of the pieces of sources.ranges.read_pieces, whatever the length of their lines.

    A piece goes on as one row with its ids (see piece_ids), written once, so no token is shuffled. A vocabulary too
    large to be sent is joined by shuffling, a row a token.
    """
    known = written(vocab.select("word", "id"), "vocabulary")
    if not may_be_sent(known):
        found = piece_tokens(pieces).join(known, "word")
        return compacted(found.select("row", "line", "block", "pos", "id", F.lit(True).alias("long")))
    table = written(piece_ids(pieces, known), "piece-ids")
    base = before_blocks(table.select("row", "line", "block", "size"))
    placed = table.join(base, ["row", "line", "block"]).select("row", "line", "base", F.posexplode("ids").alias("at", "id"))
    return placed.select("row", "line", (F.col("base") + F.col("at")).alias("pos"), "id")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many bytes, but for the last."""
    held, upto = [], 0
    for batch in batches:
        held.append(batch)
        upto += batch.nbytes
        if upto >= size:
            yield pa.concat_batches(held)
            held, upto = [], 0
    if held:
        yield pa.concat_batches(held)


def _shortened(words: pa.Array) -> pa.Array:
    """functions.text.truncated, of an array."""
    over = pc.greater(pc.binary_length(words), MAX_BYTES)
    if not pc.any(over).as_py():
        return words
    cut = [w.encode()[:MAX_BYTES].decode("utf-8", "ignore") for w in words.filter(over).to_pylist()]
    return pc.replace_with_mask(words, over, pa.array(cut, words.type))


def piece_ids(pieces: DataFrame, known: DataFrame) -> DataFrame:
    """row, line, block, size, ids: the ids of a piece's words in their order, without words out of known (word, id), which is sent to all tasks."""
    sent = known.sparkSession.sparkContext.broadcast(known.where(F.col("word") != "").toArrow().combine_chunks())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in _gathered(batches, LOOKUP_BYTES):
            text = pc.replace_substring(pc.replace_substring(batch.column("text"), "\r", ""), "\t", " ")
            cut = pc.split_pattern(text, " ")
            at = pc.index_in(_shortened(cut.flatten()), value_set=vocabulary.column("word"))
            # A piece's ids end where its words do, less the words without an id.
            upto = np.append(0, np.cumsum(at.is_valid().to_numpy(zero_copy_only=False)))
            ends = upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            ids = vocabulary.column("id").combine_chunks().take(at.drop_null())
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "line", "block")), pa.array(np.diff(ends), pa.int64()), found], names=["row", "line", "block", "size", "ids"])

    return pieces.select("row", "line", "block", "text").mapInArrow(encode, f"row long, line long, block long, size long, ids array<{known.schema['id'].dataType.simpleString()}>")


def unit_for(window: int) -> int:
    """A whole number that every distance up to window divides."""
    return lcm(*range(1, window + 1))


def pair_sums(ids: DataFrame, options: CooccurOptions) -> DataFrame:
    """word1, word2, units: sums of whole numbers, so the order of addition can't matter.

    Symmetric: each unordered pair once, mirrored after the aggregation. Pairs are added up in tasks by runs and
    shuffled as such (see pair_runs); windows for which that doesn't fit into 64 bits go by a join. Both read
    a line in blocks, so neither work nor a task grows with the square of a line's length. ids: row, line, pos,
    id; a count and the largest id run while this is called, so they should be a table, as encoded() gives it.
    """
    ids = ids.select("row", "line", "pos", "id")
    n, most = ids.agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(0))).first()
    w = options.window_size
    if not pair_runs.fits(w, most):
        return joined_sums(ids, options)
    return pair_runs.summed_pairs(ids, n, most, w, options.symmetric, unit_weights(options)[0])


def joined_sums(ids: DataFrame, options: CooccurOptions) -> DataFrame:
    """pair_sums() for windows of any size: a row a pair, from a join in blocks of BLOCK positions."""
    w = options.window_size
    block = max(BLOCK, w)
    left = ids.select("row", "line", F.col("pos").alias("p1"), F.col("id").alias("i1"), F.explode(F.array_distinct(F.array(F.floor(F.col("pos") / block), F.floor((F.col("pos") + w) / block)))).alias("block"))
    right = ids.select(F.col("row").alias("r2"), F.col("line").alias("l2"), F.col("pos").alias("p2"), F.col("id").alias("i2"), F.floor(F.col("pos") / block).alias("b2"))
    near = (F.col("p2") > F.col("p1")) & (F.col("p2") - F.col("p1") <= w)
    same = (F.col("row") == F.col("r2")) & (F.col("line") == F.col("l2")) & (F.col("block") == F.col("b2"))
    pairs = left.join(right, same & near)
    unit = unit_for(w) if options.distance_weighting else 1
    units = F.expr(f"cast({unit}L div (p2 - p1) as decimal(38,0))" if w > 30 else f"{unit}L div (p2 - p1)") if options.distance_weighting else F.lit(1).cast("long")
    key = [F.least("i1", "i2"), F.greatest("i1", "i2")] if options.symmetric else [F.col("i1"), F.col("i2")]
    return pairs.select(key[0].alias("word1"), key[1].alias("word2"), units.alias("u")).groupBy("word1", "word2").agg(F.sum("u").alias("units"))


def unit_weights(options: CooccurOptions) -> tuple[list[int], int]:
    """What distances 1 to window count, and the whole that they are parts of."""
    unit = unit_for(options.window_size) if options.distance_weighting else 1
    return [unit // d if options.distance_weighting else 1 for d in range(1, options.window_size + 1)], unit


def cooccurrence(ids: DataFrame, options: CooccurOptions = CooccurOptions()) -> DataFrame:
    """word1, word2, val. Asymmetric: word1 is the left word. A word beside itself counts twice if symmetric."""
    sums = pair_sums(ids, options)
    if options.symmetric:
        one = F.struct(F.col("word1").alias("a"), F.col("word2").alias("b"))
        two = F.struct(F.col("word2").alias("a"), F.col("word1").alias("b"))
        alike = F.col("word1") == F.col("word2")
        sides = sums.select(F.explode(F.when(alike, F.array(one)).otherwise(F.array(one, two))).alias("s"), F.when(alike, F.col("units") * 2).otherwise(F.col("units")).alias("units"))
        sums = sides.select(F.col("s.a").alias("word1"), F.col("s.b").alias("word2"), "units")
    unit = unit_weights(options)[1]
    return sums.select("word1", "word2", (F.col("units").cast("double") / F.lit(float(unit))).alias("val"))


PAIRS = pa.schema([("word1", pa.int32()), ("word2", pa.int32()), ("val", pa.float64())])


def _mirrored(word1: np.ndarray, word2: np.ndarray, units: np.ndarray) -> list[np.ndarray]:
    """Both directions of unordered pairs; a word beside itself counts twice."""
    apart = np.flatnonzero(word1 != word2)
    units = np.where(word1 == word2, 2 * units, units)
    return [np.append(word1, word2[apart]), np.append(word2, word1[apart]), np.append(units, units[apart])]


@dataclass(frozen=True)
class CorpusPairs:
    """The pairs of a corpus (column text), added up where they are used, so that no token and no pair is shuffled as a row.

    vocab: word, id and n (the word's count, by which buckets are planned), a table that every task may get. A task cuts
    its texts into words, finds their ids and pairs them at once (see pair_runs); what it sends are sums by buckets, dealt
    as the use asks for: evenly, in the pairs' order, shuffled, or by cells of word and context parts.
    """

    corpus: DataFrame
    vocab: DataFrame
    options: CooccurOptions

    @cached_property
    def sizes(self) -> tuple[int, int]:
        """Tokens and the largest id."""
        return tuple(self.vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first())

    @cached_property
    def bits(self) -> int:
        return max(1, int(self.sizes[1]).bit_length())

    @property
    def met(self) -> int:
        """Pairs before equal ones are added up, each in one direction."""
        return self.sizes[0] * self.options.window_size

    def fits(self, coding: pair_runs.Coding) -> bool:
        """Whether a key of the coding and a distance go into one whole number of 64 bits."""
        return coding.key_bits + self.options.window_size.bit_length() <= 64

    def runs(self, coding: pair_runs.Coding, both: bool = False) -> DataFrame:
        """bucket, size, data (see pair_runs). both: each pair in both directions; else the smaller word stands first if pairs are symmetric."""
        weights, window = np.array([0, *unit_weights(self.options)[0]], np.int64), self.options.window_size
        unordered = self.options.symmetric and not both
        words = self.vocab.where(F.col("word") != "").select("word", "id").toArrow().combine_chunks()
        sent = self.vocab.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            runs, base = pair_runs.Runs(coding, window, weights, both, unordered), 0
            for ids, lines in _line_ids(batches, sent.value):
                places = base + np.arange(len(ids)) + lines * (window + 1)
                yield from runs.add(ids, places, np.ones(len(ids), bool))
                base = int(places[-1]) + window + 1 if len(ids) else base
            yield from runs.rest()

        return self.corpus.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, "bucket int, size long, data binary")

    def rows(self, coding: pair_runs.Coding, both: bool, order: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        """word1, word2, val by buckets, each in an order of its own."""
        weights, unit = unit_weights(self.options)
        mirror = self.options.symmetric and not both

        def given(word1: np.ndarray, word2: np.ndarray, units: np.ndarray) -> list[np.ndarray]:
            if mirror:
                word1, word2, units = _mirrored(word1, word2, units)
            at = order(word1, word2)
            return [word1[at].astype(np.int32), word2[at].astype(np.int32), units[at] / float(unit)]

        return pair_runs.bucket_rows(self.runs(coding, both), coding, np.array([0, *weights], np.int64), given, PAIRS, "word1 int, word2 int, val double")

    def table(self) -> DataFrame:
        """word1, word2, val, as cooccurrence() gives them."""
        return self.rows(pair_runs.mixed(*self.sizes, self.options.window_size), False, _by_words)

    def ordered(self) -> DataFrame:
        """The same by word1 and word2: buckets are ranges of word1, of like size by the words' counts."""
        buckets = 1 << pair_runs.bucket_count(self.met * (2 if self.options.symmetric else 1))
        return self.rows(pair_runs.Ordered(self.bits, self._begins(buckets)), self.options.symmetric, _by_words)

    def _begins(self, buckets: int) -> tuple[int, ...]:
        """The first word1 of each bucket. The words' counts come to the driver as sums over ranges of ids that widen with the ids."""
        most = self.sizes[1]
        width = F.greatest(F.lit(1), F.floor(F.col("id") / 1024)).cast("long")
        step = F.when(F.col("id") < 1024, F.lit(1)).otherwise(F.pow(F.lit(2), F.floor(F.log2(width.cast("double"))))).cast("long")
        bins = self.vocab.groupBy((F.col("id") - F.col("id") % step).alias("first")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy("first").collect()
        # A word of n tokens has at most 2 n window contexts, and no more than there are words.
        load = np.array([min(r.n * self.options.window_size * 2, most * max(1.0, r.n / r.most)) for r in bins])
        upto = np.cumsum(load) - load
        first = np.array([r["first"] for r in bins], np.int64)
        at = np.searchsorted(upto, np.linspace(0, load.sum(), buckets, endpoint=False)) if len(load) else np.zeros(0, int)
        return (0, *np.unique(first[np.minimum(at, len(first) - 1)][1:]).tolist())

    def shuffled(self, seed: int = 0) -> DataFrame:
        """The same in the order of shuffled(): buckets are ranges of its hash."""
        wanted = pair_runs.bucket_count(self.met * (2 if self.options.symmetric else 1))
        return self.rows(pair_runs.Shuffled(self.bits, wanted, seed), self.options.symmetric, lambda a, b: np.lexsort((b, a, pair_runs.pair_hash(seed, a, b))))


def _by_words(word1: np.ndarray, word2: np.ndarray) -> np.ndarray:
    return np.argsort(word1 << np.uint64(32) | word2)


def _line_ids(batches: Iterator[pa.RecordBatch], vocabulary: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids of texts' words in their order, without words out of the vocabulary, and the numbers of their lines; a line ends with its text."""
    words, known = vocabulary.column("word").combine_chunks(), vocabulary.column("id").to_numpy().astype(np.uint64)
    # A line break is looked up as a word, which none is.
    wanted = pa.concat_arrays([words, pa.array(["\n"], words.type)])
    for texts in _cut_batches(_gathered(batches, LOOKUP_BYTES), LOOKUP_BYTES):
        text = pc.replace_substring(pc.replace_substring(texts, "\r", ""), "\t", " ")
        cut = pc.split_pattern(pc.replace_substring(text, "\n", " \n "), " ")
        at = pc.index_in(_shortened(cut.flatten()), value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = at == len(words)
        begins = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        breaks = ends.astype(np.int64)
        np.add.at(breaks, begins[begins < len(at)], 1)
        kept = np.flatnonzero((at >= 0) & ~ends)
        yield known[at[kept]], np.cumsum(breaks)[kept]


def _cut_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Array]:
    """Texts of about so many bytes at a time, of batches of any size."""
    for batch in batches:
        texts = batch.column("text")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.searchsorted(upto, np.arange(0, int(upto[-1]) if len(upto) else 0, size), side="right") if len(upto) else np.zeros(0, int)
        at = np.unique(np.append(at, 0))
        for a, b in zip(at, np.append(at[1:], len(texts)), strict=True):
            if b > a:
                yield texts.slice(int(a), int(b - a))


def corpus_pairs(corpus: DataFrame, vocab: DataFrame, options: CooccurOptions = CooccurOptions(), id_col: str = "doc_id") -> CorpusPairs | DataFrame:
    """The pairs of a corpus (id_col, text) by a vocabulary (id, word, n): CorpusPairs, or their table, where the vocabulary is too large to be sent, or windows are. Jobs run while this is called."""
    known = written(vocab.select("word", "id", "n"), "vocabulary")
    size, most = known.agg(F.coalesce(F.sum(F.octet_length("word").cast("long") + SENT_WORD_BYTES), F.lit(0)), F.coalesce(F.max("id"), F.lit(0))).first()
    if size <= SENT_BYTES and pair_runs.fits(options.window_size, most):
        return CorpusPairs(corpus, known, options)
    return cooccurrence(encoded(corpus, known, id_col), options)


def as_table(pairs: CorpusPairs | DataFrame) -> DataFrame:
    return pairs.table() if isinstance(pairs, CorpusPairs) else pairs


def ordered(pairs: CorpusPairs | DataFrame) -> DataFrame:
    return pairs.ordered() if isinstance(pairs, CorpusPairs) else pairs.orderBy("word1", "word2")


def shuffled(pairs: CorpusPairs | DataFrame, seed: int = 0) -> DataFrame:
    """A permutation fixed by the seed and the pairs, whatever their partitions."""
    if isinstance(pairs, CorpusPairs):
        if pairs.fits(pair_runs.Shuffled(pairs.bits, pair_runs.bucket_count(2 * pairs.met), seed)):
            return pairs.shuffled(seed)
        pairs = pairs.table()
    return pairs.orderBy(F.xxhash64(F.lit(seed), "word1", "word2"), "word1", "word2")
