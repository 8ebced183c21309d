"""The steps from text to vectors to accuracy with files between them, and all of them in one call.

Corpora may have lines of any length (sources.ranges). Files are written by all tasks (sources.onefile), so outputs
are on file systems that all executors have mounted; inputs may be anywhere that Spark and pyarrow read.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.config import CooccurOptions, SaveOptions, TrainOptions, VocabOptions
from wordloom.operators import cooccur as co
from wordloom.operators import vectors as wv
from wordloom.operators import vocab as vo
from wordloom.plans import training as tr
from wordloom.sources import binary
from wordloom.sources import text as st
from wordloom.sources.ranges import read_pieces
from wordloom.sources.tables import shared_dir, written


def count_words(spark: SparkSession, corpus: str, vocab_file: str, options: VocabOptions = VocabOptions()) -> None:
    """Vocabulary of a corpus file or folder. Raises UnknownInCorpus before anything is written."""
    st.write_vocab(vo.vocabulary(read_pieces(spark, corpus), options), vocab_file)


def count_pairs(spark: SparkSession, corpus: str, vocab_file: str, pair_file: str, options: CooccurOptions = CooccurOptions()) -> None:
    """Pair records of a corpus by word1 and word2."""
    ids = co.encoded_pieces(read_pieces(spark, corpus), st.read_vocab(spark, vocab_file))
    binary.write_pair_file(co.cooccurrence(ids, options), pair_file)


def shuffle_pairs(spark: SparkSession, pair_file: str, shuffled_file: str, seed: int = 0) -> None:
    """The records in an order fixed by the seed and the pairs."""
    binary.register(spark)
    pairs = spark.read.format("pair_records").load(pair_file)
    binary.write_pair_file(pairs, shuffled_file, [F.xxhash64(F.lit(seed), "word1", "word2"), "word1", "word2"])


def save_vectors(params: DataFrame, vocab: DataFrame, path: str, save: SaveOptions = SaveOptions()) -> None:
    """path.txt (binary 0), path.bin (1) or both (2); accumulators beside them as path.gradsq.txt or .bin, if asked for."""
    if save.binary in (1, 2):
        binary.write_parameter_file(params, f"{path}.bin")
        if save.gradsq:
            binary.write_parameter_file(params, f"{path}.gradsq.bin", ("g", "gb"))
    if save.binary in (0, 2):
        v = wv.exported(params, vocab, save.model)
        st.write_vectors(st.vector_lines(v, wv.unknown_vector(v), header=save.header), f"{path}.txt")
        if save.gradsq:
            st.write_vectors(st.accumulator_lines(params, vocab), f"{path}.gradsq.txt")


def given_start(spark: SparkSession, size: int, params_file: str | None, gradsq_file: str | None = None) -> DataFrame | None:
    """Parameters, and accumulators, of parameter files, to start training with."""
    if params_file is None:
        return None
    binary.register(spark)
    read = lambda path: spark.read.format("parameter_file").option("size", size).load(path)
    start = read(params_file)
    if gradsq_file is not None:
        start = start.join(read(gradsq_file).select("side", "id", F.col("v").alias("g"), F.col("b").alias("gb")), ["side", "id"])
    return start


def fit(spark: SparkSession, pair_file: str, vocab_file: str, path: str, options: TrainOptions = TrainOptions(), save: SaveOptions = SaveOptions(), folder: str | None = None, resume: bool = False, start: DataFrame | None = None) -> DataFrame:
    """Vectors from pair records, saved as path; iteration, cost of the run.

    Kept iterations are Parquet tables in folder (a new one of the shared folder by default); with save.initial and
    checkpoint_every, the initial parameters and kept iterations are also saved as path.000, path.NNN in binary form.
    """
    binary.register(spark)
    folder = folder or f"{shared_dir(spark)}/train-{uuid.uuid4().hex}"
    vocab = written(st.read_vocab(spark, vocab_file), "vocabulary")
    params = tr.train(spark.read.format("pair_records").load(pair_file), vocab.select("id"), options, folder, resume, start)
    save_vectors(params, vocab, path, save)
    kept = tr.Checkpoints(spark, folder)
    for k in kept.list():
        if (k == 0 and save.initial) or (k and options.checkpoint_every and k % options.checkpoint_every == 0):
            save_vectors(kept.load(k), vocab, f"{path}.{k:03d}", replace(save, binary=1 if save.binary == 0 else save.binary))
    return tr.costs(spark, folder)


def grammatical(category: Column) -> Column:
    """Categories of the common question files that ask for a form of a word, not for its meaning."""
    return category.startswith("gram")


def evaluate(spark: SparkSession, vocab_file: str, vectors_file: str, questions: str) -> DataFrame:
    """Accuracy of saved vectors, text or binary (by the name's end), on question files (a folder or a pattern)."""
    vocab = written(st.read_vocab(spark, vocab_file), "vocabulary")
    vectors = binary.read_summed(spark, vectors_file, vocab) if vectors_file.endswith(".bin") else st.read_vectors(spark, vectors_file, vocab)
    return wv.evaluated(written(vectors, "vectors"), st.read_questions(spark, questions), ~grammatical(F.col("category")))


def text_to_vectors(spark: SparkSession, corpus: str, path: str, vocab: VocabOptions = VocabOptions(min_count=5), cooccur: CooccurOptions = CooccurOptions(), train: TrainOptions = TrainOptions(), save: SaveOptions = SaveOptions()) -> DataFrame:
    """All steps: path.vocab.txt, path.pairs.bin and the vectors of a corpus; iteration, cost of the run. The trainer takes records in an order of its own, so no shuffled file is made."""
    count_words(spark, corpus, f"{path}.vocab.txt", vocab)
    count_pairs(spark, corpus, f"{path}.vocab.txt", f"{path}.pairs.bin", cooccur)
    return fit(spark, f"{path}.pairs.bin", f"{path}.vocab.txt", path, train, save)
