"""Packing documents into sequences of a fixed length by concatenating and cutting.

All documents' ids, each document's with an end id after them, count as one long run, cut every ``window``
ids. Two passes: in the first, tasks encode their documents into a table that keeps, beside each document,
how many ids its task had before it; a prefix sum over the tasks' totals gives each task's place in the run.
In the second, a document's place is its task's place plus its own, and follows from the row alone, so
rows are cut into pieces where they are, without a shuffle. A piece is the boundary record of a sequence: which
ids of which document lie at which offset. sequences() puts pieces together.

Only the last sequence can be short. It is padded to the window, unless its length is a power of two.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.batches import slices
from wordloom.llm.shared import shared_dir, text_of
from wordloom.llm.token_files import loaded

WINDOW = 2048
#: Tasks whose places may be broadcast, at some 16 bytes each; the places of more are joined by shuffling.
SENT_TASKS = 1_000_000


def encoded(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, a table in the shared folder: part (the task), before (ids of the part before the document), n, id, ids (little-endian uint32).

    Every row of docs is one row. Null and empty texts have the end id alone.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, upto = loaded(definition), TaskContext.get().partitionId(), 0
        for batch in (some for whole in batches for some in slices(whole)):
            ids = [found + end for found in encoder.encode_batch(batch.column(1).to_pylist())]
            n = [len(x) // 4 for x in ids]
            before = []
            for k in n:
                before.append(upto)
                upto += k
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), batch.column(0), pa.array(ids, pa.binary())], names=["part", "before", "n", "id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"part long, before long, n long, id {kind}, ids binary")
    path = f"{shared_dir(docs.sparkSession)}/packing-{uuid.uuid4().hex}"
    # Ids are no repeated values, so a dictionary of them only costs.
    found.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}).parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def places(parts: DataFrame) -> DataFrame:
    """part, base: the number of ids in all parts before it. One row for each task of the first pass, so one task sums them."""
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def cut(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Second pass, a row for each piece: doc_id, start (its document's ids before it), length, ids, doc_tokens, sequence_id, offset."""
    base = places(parts)
    few = parts.select("part").distinct().count() <= SENT_TASKS
    placed = parts.join(F.broadcast(base) if few else base, "part").withColumn("at", F.col("base") + F.col("before"))

    def piece(k):
        begin = F.greatest(k * window - F.col("at"), F.lit(0))
        length = F.least((k + 1) * window - F.col("at"), F.col("n")) - begin
        return F.struct(
            begin.alias("start"), length.alias("length"), F.substring("ids", (4 * begin + 1).cast("int"), (4 * length).cast("int")).alias("ids"), k.alias("sequence_id"), (F.col("at") + begin - k * window).alias("offset")
        )

    # Slices are cut inside the row, so a long document isn't copied once for each of its pieces.
    touched = F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window))
    pieces = placed.select(F.col("id").alias("doc_id"), F.col("n").alias("doc_tokens"), F.explode(F.transform(touched, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def pack(docs: DataFrame, definition: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Null or empty text: one piece with the end id. Null ids and repeated rows: each row is a document of its
    own. Empty table: no pieces. Other columns are ignored. Documents follow one another in the order in
    which tasks read them; which document comes first isn't part of the contract, and every id lies in one piece.
    """
    return cut(encoded(docs, definition, end_id, id_col, text_col), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (window of them, padded at the end; no padding at a power of two), n_tokens, documents (doc_id, start, offset, length in order).

    A sequence has window pieces at most, so its group is bounded.
    """
    own = F.struct("offset", "doc_id", "start", "length", F.hex("ids").alias("hex"))
    grouped = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(own)).alias("p"), F.sum("length").alias("n_tokens"))
    n = F.col("n_tokens")
    free = F.when(F.bit_count(n) == 1, 0).otherwise(window - n).cast("int")
    digits = F.concat(F.array_join(F.col("p.hex"), ""), F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), free))
    listed = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return grouped.select("sequence_id", F.unhex(digits).alias("ids"), "n_tokens", listed.alias("documents"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
