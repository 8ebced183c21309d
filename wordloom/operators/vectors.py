"""Word vectors: export forms, the unknown vector, neighbours and analogies.

Vectors are id, word, v (array of double). Queries and vectors are dealt to blocks of counted bytes, and a
block of queries meets a block of vectors as one matrix product; of it only the best k of each query go on,
so the scores of all words for all queries never exist as rows, and no side is held whole anywhere.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import vectors as vec
from wordloom.sources.tables import written

MODELS = ("word_and_bias", "word", "sum", "concat")  # export models 0 to 3
RARE = 100  # so many last ranks make the unknown vector
QUERY_BYTES = 4 << 20  # of a block of queries
UNIT_BYTES = 8 << 20  # of a block of vectors
LEAST_UNITS = 2000  # vectors that make a block of their own, for parallel work on small tables
MOST_PARTS = 10_000
SCORED = 2_000_000  # scores that a task holds at once
DIGITS = 12


class UnknownTerm(ValueError):
    """A query's word has no vector."""


def exported(params: DataFrame, vocab: DataFrame, model: int = 2) -> DataFrame:
    """id, word, v. Model 0: both vectors with their biases; 1: word vector; 2: sum of both; 3: both without biases."""
    side = lambda s: params.where(F.col("side") == s).select("id", F.col("v").alias(f"{s}v"), F.col("b").alias(f"{s}b"))
    both = side("w").join(side("c"), "id")
    form = {
        0: F.concat("wv", F.array("wb"), "cv", F.array("cb")),
        1: F.col("wv"),
        2: vec.add(F.col("wv"), F.col("cv")),
        3: F.concat("wv", "cv"),
    }[model]
    return both.select("id", form.alias("v")).join(vocab.select("id", "word"), "id").select("id", "word", "v")


def unknown_vector(vectors: DataFrame) -> DataFrame:
    """One row, v: the mean of the RARE last ranks (all, if there are fewer)."""
    last = vectors.agg(F.max("id").alias("top"))
    rare = vectors.join(F.broadcast(last), F.col("id") > F.col("top") - RARE)
    dims = rare.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))
    return dims.agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d")).select(F.col("d.x").alias("v"))


def normalized(vectors: DataFrame) -> DataFrame:
    """Unit vectors; a zero vector's is null."""
    return vectors.withColumn("v", vec.unit(F.col("v")))


def _top(asked: np.ndarray, skip: list[np.ndarray], ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's row, vector's row and similarity of each query's k best vectors, SCORED scores at a time. skip: query rows and ids that don't count for them."""
    # Ties are told by id, so what products differ by in the last digits must not decide: similarities are rounded. Whatever may
    # round to a query's k-th best so far, or more, is rounded and taken along; all others can't be among its best.
    q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    found, waiting = [], 0
    least, margin = np.full(len(asked), -np.inf), 2 * 10.0**-DIGITS
    step = max(1, SCORED // max(1, len(asked)))
    hidden_q, hidden_id = skip
    for a in range(0, len(ids), step):
        own = ids[a : a + step]
        scores = asked @ vectors[a : a + step].T
        order = np.argsort(own, kind="stable")
        at = np.minimum(np.searchsorted(own[order], hidden_id), len(own) - 1)
        met = own[order][at] == hidden_id
        scores[hidden_q[met], order[at[met]]] = -np.inf
        if a == 0 and len(own) > k:
            least = np.partition(scores, -k, axis=1)[:, -k] - margin
        at = np.flatnonzero(scores >= np.maximum(least, np.finfo(float).min)[:, None])
        rows, columns = np.divmod(at, len(own))
        found.append((rows, a + columns, np.round(scores.ravel()[at], DIGITS)))
        waiting += len(at)
        if a > 0 and a + step < len(ids) and waiting < len(asked) * k // 4:
            continue
        q, i, s = (np.concatenate(c) for c in zip((q, i, s), *found, strict=True))
        found, waiting = [], 0
        order = np.lexsort((ids[i], -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        number = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = number < k
        last = number == k - 1
        least[q[last]] = np.maximum(least[q[last]], s[last] - margin)
        q, i, s = q[kept], i[kept], s[kept]
    return q, i, s


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def best(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, rank, id, word, similarity for queries (query, qv, skip): the k best of all units, but for ids in skip.

    Similarities are rounded to DIGITS decimals; ties go by id. Queries are written once, and both sides counted,
    while this is called. Each cell of a block of queries and one of units gives its best k a query; the final k are
    taken by query.
    """
    spark, units = units.sparkSession, units.where("v is not null").select("id", "word", "v")
    asked = written(queries.select("query", "qv", "skip"), "queries")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("qv"))).first()
    m, row = units.count(), 8 * (width or 1)
    q_blocks = max(1, ceil(n * row / QUERY_BYTES))
    u_blocks = max(1, ceil(m * row / UNIT_BYTES), min(spark.sparkContext.defaultParallelism, m // LEAST_UNITS))
    each = lambda name, blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    cells, cell = q_blocks * u_blocks, (F.col("qb") * u_blocks + F.col("ub")).alias("cell")
    left = asked.select("query", "qv", "skip", block("query", q_blocks).alias("qb"), each("ub", u_blocks)).select(cell, "query", "qv", "skip")
    right = units.select("id", "word", "v", block("id", u_blocks).alias("ub"), each("qb", q_blocks)).select(cell, F.col("id").cast("long").alias("id"), "word", "v")
    schema = asked.select("query").withColumns({"id": F.lit(0).cast("long"), "word": F.lit(""), "similarity": F.lit(0.0)}).schema

    def meet(questions: pa.Table, vectors: pa.Table) -> pa.Table:
        if not questions.num_rows or not vectors.num_rows:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            skip = questions.column("skip").combine_chunks()
            hidden = [np.repeat(np.arange(len(skip)), np.diff(skip.offsets.to_numpy())), skip.flatten().to_numpy(zero_copy_only=False)]
            q, i, s = _top(_matrix(questions.column("qv")), hidden, vectors.column("id").to_numpy(), _matrix(vectors.column("v")), k)
        return pa.Table.from_arrays([questions.column("query").take(pa.array(q)), vectors.column("id").take(pa.array(i)), vectors.column("word").take(pa.array(i)), pa.array(s)], names=["query", "id", "word", "similarity"])

    parts = min(2 * cells, MOST_PARTS)  # twice as many, as cells meet in partitions by hash
    found = left.repartition(parts, "cell").groupBy("cell").cogroup(right.repartition(parts, "cell").groupBy("cell")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", F.col("id").cast(units.schema["id"].dataType).alias("id"), "word", "similarity")


def neighbors(units: DataFrame, query_ids: DataFrame, k: int = 100) -> DataFrame:
    """The k most similar words for each id of query_ids (query)."""
    q = units.join(query_ids, units["id"] == query_ids["query"]).select("query", F.col("v").alias("qv"), F.array("id").alias("skip")).where("qv is not null")
    return best(units, q, k)


def phrase_queries(units: DataFrame, terms: DataFrame) -> DataFrame:
    """query, qv, skip of terms (query, id): the sum of the terms' unit vectors, brought to length one."""
    parts = terms.join(units.select("id", "v"), "id")
    dims = parts.select("query", "id", F.posexplode("v").alias("dim", "x")).groupBy("query", "dim").agg(F.sum("x").alias("x"))
    sums = dims.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d")).select("query", F.col("d.x").alias("s"))
    skip = terms.groupBy("query").agg(F.collect_set("id").alias("skip"))
    return sums.join(skip, "query").select("query", vec.unit(F.col("s")).alias("qv"), "skip")


def neighbors_of(units: DataFrame, words: list[str], k: int = 100) -> DataFrame:
    """rank, word, similarity for a word or phrase; raises UnknownTerm."""
    ids = _ids(units, words)
    spark = units.sparkSession
    return best(units, phrase_queries(units, spark.createDataFrame([(0, i) for i in ids], "query int, id int")), k).select("rank", "word", "similarity")


def analogy_of(units: DataFrame, words: list[str], k: int = 100) -> DataFrame:
    """rank, word, similarity for 'a is to b as c is to ?'; needs three known words."""
    if len(words) < 3:
        raise ValueError("an analogy needs three words")
    a, b, c = _ids(units, words[:3])
    spark = units.sparkSession
    q = analogy_queries(units, spark.createDataFrame([(0, a, b, c)], "query int, a int, b int, c int"), length_one=True)
    return best(units, q, k).select("rank", "word", "similarity")


def _ids(units: DataFrame, words: list[str]) -> list[int]:
    found = {r.word: r.id for r in units.where(F.col("word").isin(words)).select("word", "id").collect()}
    for w in words:
        if w not in found:
            raise UnknownTerm(f"word out of vocabulary: {w}")
    return [found[w] for w in words]


def analogy_queries(units: DataFrame, questions: DataFrame, length_one: bool = False) -> DataFrame:
    """query, qv, skip of questions (query, a, b, c as ids): b - a + c of unit vectors, brought to length one or not."""
    side = lambda c: units.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    full = questions.join(side("a"), "a").join(side("b"), "b").join(side("c"), "c")
    v = vec.add(vec.subtract(F.col("vb"), F.col("va")), F.col("vc"))
    return full.select("query", (vec.unit(v) if length_one else v).alias("qv"), F.array("a", "b", "c").alias("skip")).where("qv is not null")


def known_questions(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """Questions (category, seq, a, b, c, d as words) all of whose words are known, with their ids: qa, qb, qc, qd."""
    out = questions
    for c in "abcd":
        out = out.join(vocab.select(F.col("word").alias(c), F.col("id").alias(f"q{c}")), c)
    return out.select("category", "seq", "qa", "qb", "qc", "qd")


def predicted(units: DataFrame, known: DataFrame) -> DataFrame:
    """category, seq, expected, predicted, correct for known_questions."""
    q = known.withColumn("query", F.struct("category", "seq"))
    top = best(units, analogy_queries(units, q.select("query", F.col("qa").alias("a"), F.col("qb").alias("b"), F.col("qc").alias("c"))), 1)
    out = q.join(top.select("query", F.col("id").alias("predicted")), "query", "left")
    return out.select("category", "seq", F.col("qd").alias("expected"), "predicted", F.coalesce(F.col("qd") == F.col("predicted"), F.lit(False)).alias("correct"))


def coverage(questions: DataFrame, known: DataFrame) -> DataFrame:
    """category, total, seen."""
    seen = known.groupBy("category").agg(F.count(F.lit(1)).alias("seen"))
    return questions.groupBy("category").agg(F.count(F.lit(1)).alias("total")).join(seen, "category", "left").select("category", "total", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


def accuracy(answers: DataFrame, semantic: Column) -> DataFrame:
    """level (category, kind, all), name, seen, correct, accuracy in per cent; semantic: which categories are."""
    kind = F.when(semantic, "semantic").otherwise("syntactic")
    rows = answers.withColumn("kind", kind).groupingSets([["category"], ["kind"], []], "category", "kind").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if("correct").alias("correct"), F.grouping("category").alias("gc"), F.grouping("kind").alias("gk")
    )
    level = F.when(F.col("gc") == 0, "category").when(F.col("gk") == 0, "kind").otherwise("all")
    name = F.coalesce("category", "kind", F.lit("all"))
    return rows.select(level.alias("level"), name.alias("name"), "seen", "correct", F.try_divide(100.0 * F.col("correct"), F.col("seen")).alias("accuracy"))


def running_accuracy(answers: DataFrame) -> DataFrame:
    """category, seen, correct, seen_so_far, correct_so_far, in the order of categories."""
    per = answers.groupBy("category").agg(F.count(F.lit(1)).alias("seen"), F.count_if("correct").alias("correct"))
    w = Window.orderBy("category").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("category", "seen", "correct", F.sum("seen").over(w).alias("seen_so_far"), F.sum("correct").over(w).alias("correct_so_far"))


def looked_up(vectors: DataFrame, asked: DataFrame, unknown: DataFrame) -> DataFrame:
    """The rows of asked (word and others) with v: the word's vector, or unknown's (one row, v) where it has none. A null word is unknown."""
    known = asked.join(vectors.select("word", F.col("v").alias("own")), "word", "left")
    return known.join(F.broadcast(unknown.select(F.col("v").alias("other")))).select(*asked.columns, F.coalesce("own", "other").alias("v"))


def evaluated(vectors: DataFrame, questions: DataFrame, semantic: Column) -> DataFrame:
    """accuracy of vectors (id, word, v), of any source, on questions (category, seq, a, b, c, d)."""
    return accuracy(predicted(normalized(vectors), known_questions(questions, vectors)), semantic)
