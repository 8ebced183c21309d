"""Vocabulary: word counts, ranks, cuts and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.config import VocabOptions
from wordloom.functions.text import UNKNOWN, words
from wordloom.operators.places import numbered


class UnknownInCorpus(ValueError):
    """The corpus contains the reserved word <unk>."""


def word_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: partial sums per task, one shuffle of distinct words."""
    return words(corpus, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_tokens, n_words."""
    return word_counts(corpus, text_col).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"), F.count(F.lit(1)).alias("n_words"))


def unknown_words(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_unk, whether the corpus may be used."""
    n = words(corpus, text_col).where(F.col("word") == UNKNOWN).agg(F.count(F.lit(1)).alias("n_unk"))
    return n.select("n_unk", (F.col("n_unk") == 0).alias("usable"))


def refuse_unknown(corpus: DataFrame, text_col: str = "text") -> None:
    """Raises before any output; scans only texts that contain the string."""
    some = corpus.where(F.contains(F.replace(F.col(text_col), F.lit("\r"), F.lit("")), F.lit(UNKNOWN)))
    if not words(some, text_col).where(F.col("word") == UNKNOWN).isEmpty():
        raise UnknownInCorpus(f"remove {UNKNOWN} from the corpus and try again")


def tie(word: Column) -> Column:
    """Order among equal counts where a limit cuts: even over the alphabet."""
    return F.md5(word)


def limited(counts: DataFrame, options: VocabOptions) -> DataFrame:
    """The max_vocab most frequent words, and of those the ones seen min_count times. With max_vocab, a job runs while this is called."""
    if options.max_vocab > 0:
        placed = numbered(counts.select("word", "n"), [F.desc("n"), tie(F.col("word")), "word"], "at")
        counts = placed.where(F.col("at") <= options.max_vocab).select("word", "n")
    return counts.where(F.col("n") >= options.min_count)


def ranked(counts: DataFrame) -> DataFrame:
    """id (1-based rank by count, ties by word), word, n. A job runs while this is called (see places)."""
    return numbered(counts.select("word", "n"), [F.desc("n"), "word"], "at").select(F.col("at").cast("int").alias("id"), "word", "n")


def vocabulary(corpus: DataFrame, options: VocabOptions = VocabOptions(), text_col: str = "text") -> DataFrame:
    """id, word, n. Raises UnknownInCorpus."""
    refuse_unknown(corpus, text_col)
    return ranked(limited(word_counts(corpus, text_col), options))


def report(counts: DataFrame, options: VocabOptions) -> DataFrame:
    """One row: size, least_count, cut_by ('size', 'count' or 'none')."""
    kept = limited(counts, options)
    total = counts.agg(F.count(F.lit(1)).alias("all"))
    found = kept.agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least_count"))
    top = F.least(F.col("all"), F.lit(options.max_vocab)) if options.max_vocab > 0 else F.col("all")
    cut = F.when(F.col("size") < top, "count").when(F.col("size") < F.col("all"), "size").otherwise("none")
    return found.join(F.broadcast(total)).select("size", "least_count", cut.alias("cut_by"))
