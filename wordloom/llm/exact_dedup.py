"""Exact dedup by skew-safe combining of content groups, DataFrame operations only.

Texts are equal when identical after deleting ASCII white space (space, \\t to \\r).
Every stage groups by digest *and* full normalised content, so a digest collision never merges texts:

1. within each input partition (the partial side of the first aggregate),
2. within each (digest, salt), the salt spreading the copies of one text over ``SALTS`` groups,
3. over the winners of the salts, of which a text has ``SALTS`` at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.shared import text_of

SALTS = 32
_SPACE = r"[\x20\x09-\x0D]+"


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def _salt(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")


def _order(id_: Column, n: Column, *ties: Column) -> Column:
    """The smallest wins: most code points, then smallest id, a null id last."""
    return F.struct((-n).alias("less"), id_.isNull().alias("none"), id_.alias("id"), *ties)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points before normalising stays, then the smallest id.
    Nulls: a null text is the empty text; a null id stays only when no other row of its text has as
    many code points. Repeated rows (same id, same text) count one by one in group_size and all get
    the same answer. Empty table: no rows. Other columns are ignored. Texts have no length limit.
    On the way back a row finds its group by SHA-256 together with length and a second hash.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n"), _normal(text).alias("norm")).select(
        "id", "n", "norm", F.sha2("norm", 256).alias("digest"), _salt("id").alias("salt")
    )
    best = _order(F.col("id"), F.col("n"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    groups = (
        salted.groupBy("digest", "norm")
        .agg(F.min("best").alias("best"), F.sum("size").alias("group_size"), F.collect_set("salt").alias("salts"))
        .select("digest", F.length("norm").alias("len"), F.xxhash64("norm").alias("second"), "best", "group_size", F.explode("salts").alias("salt"))
    )
    members = rows.select("id", "n", "digest", F.length("norm").alias("len"), F.xxhash64("norm").alias("second"), "salt")
    # A group goes back once for each of its salts, so a text that fills a third of the rows is no hot join key.
    return members.join(groups, ["digest", "len", "second", "salt"]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.less"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, whole and with their columns, one of each group of equal texts.

    The same rule as duplicate_groups; the row itself travels with the winner, so of fully repeated
    rows exactly one stays, and null ids need no join. Extra columns of any name are kept; of rows equal
    in id and text that differ only in them, any one stays.
    """
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "row",
        _normal(F.col("text")).alias("norm"),
        _order(F.col("id"), F.length("text"), F.xxhash64("text")).alias("rank"),
        _salt("id").alias("salt"),
    )
    best = [F.min_by("row", "rank").alias("row"), F.min("rank").alias("rank")]
    salted = rows.withColumn("digest", F.sha2("norm", 256)).groupBy("digest", "salt", "norm").agg(*best)
    kept = salted.groupBy("digest", "norm").agg(*best)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
