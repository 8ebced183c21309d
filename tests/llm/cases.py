"""Rows that every operator must stand: nulls, empty and long texts, repeated rows, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, id long, digest string, n long, row_key string"


def frame(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", 7, "x", 9, "k") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "alone here"), (None, None), (4, "one"), (5, "Two  words"), (5, "Two  words"), (6, "x" * 50_000), (7, "é ß 日本 🎉 \x00 \x85"), (8, "w " * 30_000)]
