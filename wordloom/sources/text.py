"""Legacy text files: corpora, vocabularies, vectors and analogy questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import UNKNOWN
from wordloom.sources.onefile import write_lines
from wordloom.sources.ranges import read_lines


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: each line of the files is a row; lines are contexts of their own anyway."""
    return spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def _fields(line: Column) -> Column:
    return F.split(F.rtrim(line), " ")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """id (line number, from 1), word, n of a file of `word count` lines, read by ranges; ValueError if a word stands in it twice."""
    f = _fields(F.col("value"))
    rows = read_lines(spark, path).where("value <> ''").select(F.col("id").cast("int").alias("id"), f[0].alias("word"), f[1].cast("long").alias("n"))
    return refuse_repeated(rows)


def refuse_repeated(vocab: DataFrame) -> DataFrame:
    """The vocabulary, or ValueError if a word stands in it twice: its ids couldn't be told apart."""
    again = vocab.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("word").first()
    if again is not None:
        raise ValueError(f"the vocabulary has {again.word!r} more than once")
    return vocab


def vocab_lines(vocab: DataFrame) -> DataFrame:
    return vocab.orderBy("id").select(F.concat_ws(" ", "word", F.col("n").cast("string")).alias("value"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One file, written by all tasks (see sources.onefile)."""
    write_lines(vocab, ["id"], F.concat_ws(" ", "word", F.col("n").cast("string")), path)


def read_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """word, v (and id, with a vocabulary) of `word f1 .. fD` lines, a header and the unknown vector left out."""
    f = _fields(F.col("value"))
    rows = spark.read.text(path).where(F.size(f) > 2).select(f[0].alias("word"), F.transform(F.slice(f, F.lit(2), F.size(f) - 1), lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("word") != UNKNOWN)
    return rows if vocab is None else vocab.select("id", "word").join(rows, "word").select("id", "word", "v")


def _line(word: Column, v: Column) -> Column:
    return F.concat_ws(" ", word, F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x)), " "))


def vector_lines(vectors: DataFrame, unknown: DataFrame | None = None, header: bool = False) -> DataFrame:
    """line_no, value: the lines in order; the header counts words without the unknown one. A word <unk> of its own fails the job."""
    own = F.when(F.col("word") == UNKNOWN, F.raise_error(F.lit(f"remove {UNKNOWN} from the vocabulary and try again"))).otherwise(F.col("word"))
    vectors = vectors.withColumn("word", own)
    lines = vectors.select(F.col("id").cast("long").alias("line_no"), _line(F.col("word"), F.col("v")).alias("value"))
    if unknown is not None:
        lines = lines.unionByName(unknown.select(F.lit(2**62).alias("line_no"), _line(F.lit(UNKNOWN), F.col("v")).alias("value")))
    if header:
        top = vectors.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("v")).alias("d"))
        lines = lines.unionByName(top.select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", F.col("n").cast("string"), F.col("d").cast("string")).alias("value")))
    return lines


def accumulator_lines(params: DataFrame, vocab: DataFrame) -> DataFrame:
    """line_no, value: of each word its word accumulators and their bias's, then its context accumulators and their bias's."""
    side = lambda s: params.where(F.col("side") == s).select("id", F.concat("g", F.array("gb")).alias(s))
    both = side("w").join(side("c"), "id").join(vocab.select("id", "word"), "id")
    return both.select(F.col("id").cast("long").alias("line_no"), _line(F.col("word"), F.concat("w", "c")).alias("value"))


def write_vectors(lines: DataFrame, path: str) -> None:
    """One file of the lines (line_no, value), written by all tasks."""
    write_lines(lines, ["line_no"], "value", path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """category (the file's name), seq, a, b, c, d of lines of four words."""
    f = _fields(F.col("value"))
    rows = spark.read.text(path).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "").alias("category"), F.monotonically_increasing_id().alias("seq"), f.alias("f"))
    return rows.where(F.size("f") == 4).select("category", "seq", *[F.col("f")[k].alias(c) for k, c in enumerate("abcd")])
