"""Token rules: only space, tab and newline separate; carriage returns vanish, even inside a word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 999
UNKNOWN = "<unk>"


def lines_of(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")


def words_of(line: Column) -> Column:
    return F.transform(F.array_remove(F.split(line, "[ \t]+"), ""), truncated)


def truncated(word: Column) -> Column:
    """The longest prefix of whole characters of at most MAX_BYTES bytes."""
    data = F.encode(word, "UTF-8")

    def starts(n: int) -> Column:
        after = F.hex(F.substring(data, n + 1, 1))
        return ~after.between("80", "BF")

    cut = F.coalesce(*[F.when(starts(n), F.decode(F.substring(data, 1, n), "UTF-8")) for n in range(MAX_BYTES, MAX_BYTES - 4, -1)])
    return F.when(F.octet_length(word) <= MAX_BYTES, word).otherwise(cut)


def tokens(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", long: int | None = None) -> DataFrame:
    """doc_id, row, line, pos, word. A null text has no tokens; a line break is a context boundary.

    row is the corpus row's own number, so rows with the same or no doc_id keep their lines apart. With
    long, a column of that name tells the lines of more tokens than that.
    """
    lines = corpus.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.posexplode(lines_of(F.col(text_col))).alias("line", "t"))
    if long is None:
        return lines.select("doc_id", "row", "line", F.posexplode(words_of(F.col("t"))).alias("pos", "word"))
    cut = lines.select("doc_id", "row", "line", words_of(F.col("t")).alias("ws"))
    return cut.select("doc_id", "row", "line", (F.size("ws") > long).alias("long"), F.posexplode("ws").alias("pos", "word"))


def piece_tokens(pieces: DataFrame) -> DataFrame:
    """row, line, block, pos (in the piece), word of the pieces of sources.ranges.read_pieces."""
    text = F.replace(F.col("text"), F.lit("\r"), F.lit(""))
    return pieces.select("row", "line", "block", F.posexplode(words_of(text)).alias("pos", "word"))


def words(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """One column, word: what counting needs, without lines and positions."""
    text = F.replace(F.col(text_col), F.lit("\r"), F.lit(""))
    line = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    # One plain character to split at, and no lambda over the words: less time for each word.
    found = corpus.select(F.explode(F.split(line, " ")).alias("word")).where(F.col("word") != "")
    return found.select(truncated(F.col("word")).alias("word"))
