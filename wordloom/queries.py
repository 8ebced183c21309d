"""Named queries over the test tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.config import CooccurOptions, TrainOptions, VocabOptions
from wordloom.functions import text as tx
from wordloom.functions import vectors as vec
from wordloom.operators import cooccur as co
from wordloom.operators import vectors as wv
from wordloom.operators import vocab as vo
from wordloom.plans import training as tr
from wordloom.sources import binary
from wordloom.sources import text as st
from wordloom.sources.onefile import line_bytes, write_one
from wordloom.sources.ranges import read_pieces
from wordloom.sources.tables import shared_dir, spread, written
from wordloom.streaming.vocab import Counts, count_to_table, latest

MIN_COUNT = 5
SIZE = 50  # of vectors
TRAIN = TrainOptions(vector_size=SIZE, iterations=2, x_max=10.0, blocks=2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def counts(spark, sf_dir):
    return vo.word_counts(docs(spark, sf_dir))


def vocab(spark, sf_dir, least=MIN_COUNT):
    return vo.ranked(vo.limited(counts(spark, sf_dir), VocabOptions(min_count=least)))


def ids(spark, sf_dir, least=MIN_COUNT):
    return co.encoded(docs(spark, sf_dir), vocab(spark, sf_dir, least))


def source(spark, sf_dir, least=MIN_COUNT, **options):
    """The pairs, to be added up by what uses them."""
    return _source(spark, sf_dir, vocab(spark, sf_dir, least), **options)


def _source(spark, sf_dir, v, **options):
    return co.corpus_pairs(docs(spark, sf_dir), v, CooccurOptions(**options))


def _words(spark, sf_dir, least=20):
    """The vocabulary, written: pairs and parameters take it."""
    return written(vocab(spark, sf_dir, least), "vocabulary")


def pairs(spark, sf_dir, least=MIN_COUNT, **options):
    return co.as_table(source(spark, sf_dir, least, **options))


def tokenize(spark, sf_dir):
    return tx.tokens(docs(spark, sf_dir)).select("doc_id", "line", "pos", "word")


def corpus_stats(spark, sf_dir):
    return vo.corpus_stats(docs(spark, sf_dir))


def vocab_count(spark, sf_dir):
    return counts(spark, sf_dir)


def vocab_min_count(spark, sf_dir):
    return vo.limited(counts(spark, sf_dir), VocabOptions(min_count=MIN_COUNT))


def vocab_max(spark, sf_dir):
    return vo.limited(counts(spark, sf_dir), VocabOptions(max_vocab=1000))


def vocab_max_min(spark, sf_dir):
    return vo.limited(counts(spark, sf_dir), VocabOptions(max_vocab=2000, min_count=30))


def vocab_report(spark, sf_dir):
    return vo.report(counts(spark, sf_dir), VocabOptions(max_vocab=2000, min_count=30))


def vocab_rank(spark, sf_dir):
    return vocab(spark, sf_dir)


def unk_guard(spark, sf_dir):
    return vo.unknown_words(docs(spark, sf_dir))


def vocab_lines(spark, sf_dir):
    return st.vocab_lines(vocab(spark, sf_dir))


def encode_corpus(spark, sf_dir):
    return ids(spark, sf_dir).select("doc_id", "line", F.col("pos").cast("int").alias("pos"), "id")


def cooccur_weighted_corpus(spark, sf_dir):
    """Pairs of a corpus in which each document stands twice, for weight, with ids repeated: their lines stay apart."""
    d = docs(spark, sf_dir)
    twice = d.unionByName(d)
    return co.as_table(co.corpus_pairs(twice, vo.ranked(vo.limited(vo.word_counts(twice), VocabOptions(min_count=40))), CooccurOptions(window_size=5)))


def corpus_weighting(spark, sf_dir):
    d, c = docs(spark, sf_dir).select("text"), table(spark, sf_dir, "conversations").select("text")
    return vo.word_counts(d.unionByName(d).unionByName(c))


def cooccur_sym(spark, sf_dir):
    return pairs(spark, sf_dir)


def cooccur_asym(spark, sf_dir):
    return pairs(spark, sf_dir, symmetric=False)


def cooccur_unweighted(spark, sf_dir):
    return pairs(spark, sf_dir, window_size=10, distance_weighting=False)


def cooccur_w5(spark, sf_dir):
    return pairs(spark, sf_dir, window_size=5)


def cooccur_w10(spark, sf_dir):
    return co.ordered(source(spark, sf_dir, window_size=10))


def cooccur_partial_final(spark, sf_dir):
    """Row sums of the pair table."""
    p = pairs(spark, sf_dir, window_size=10)
    return p.groupBy("word1").agg(F.count(F.lit(1)).alias("n_contexts"), F.round(F.sum("val"), 6).alias("total"))


def shuffle_content(spark, sf_dir):
    return co.shuffled(source(spark, sf_dir, least=20, window_size=5), seed=7)


def pair_weights(spark, sf_dir):
    p = pairs(spark, sf_dir, least=20, window_size=5)
    return p.select("word1", "word2", F.round(vec.pair_weight(F.col("val"), 10.0, 0.75), 6).alias("weight"), F.round(F.ln("val"), 6).alias("target"))


def _start(spark, sf_dir, least=20):
    return tr.initial(vocab(spark, sf_dir, least).select("id"), TRAIN)


def init_params(spark, sf_dir):
    p = _start(spark, sf_dir)
    flat = p.select("side", "id", F.posexplode(F.concat(F.array("b"), "v")).alias("dim", "val"))
    return flat.select("side", "id", "dim", F.round("val", 9).alias("val"))


def _started(spark, sf_dir):
    """The pairs and the initial parameters."""
    v = _words(spark, sf_dir)
    return _source(spark, sf_dir, v, window_size=5), tr.initial(v.select("id"), TRAIN)


def train_cost(spark, sf_dir):
    return tr.cost(*_started(spark, sf_dir), TRAIN).select(F.round("cost", 6).alias("cost"))


def adagrad_step(spark, sf_dir):
    return _flat(tr.fullbatch_step(*_started(spark, sf_dir), TRAIN))


def _flat(p):
    flat = p.select("side", "id", F.posexplode(F.arrays_zip(F.concat(F.array("b"), "v").alias("val"), F.concat(F.array("gb"), "g").alias("acc"))).alias("dim", "x"))
    return flat.select("side", "id", "dim", F.round("x.val", 5).alias("val"), F.round("x.acc", 5).alias("acc"))


def _export(model):
    def query(spark, sf_dir):
        v = wv.exported(_start(spark, sf_dir), vocab(spark, sf_dir, 20), model)
        return v.select("id", "word", F.posexplode("v").alias("dim", "val")).select("id", "word", "dim", F.round("val", 9).alias("val"))

    return query


def unk_vector(spark, sf_dir):
    v = wv.exported(_start(spark, sf_dir), vocab(spark, sf_dir, 20), 0)
    return wv.unknown_vector(v).select(F.posexplode("v").alias("dim", "val")).select("dim", F.round("val", 9).alias("val"))


def vector_export_text(spark, sf_dir):
    v = wv.exported(_start(spark, sf_dir), vocab(spark, sf_dir, 20), 2)
    return st.vector_lines(v, header=True)


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), vec.doubles(F.col("embedding")).alias("v"))


def _units(spark, sf_dir):
    return wv.normalized(_vectors(spark, sf_dir))


def normalize_vectors(spark, sf_dir):
    return _units(spark, sf_dir).select("id", F.posexplode("v").alias("dim", "val")).select("id", "dim", F.round("val", 6).alias("val"))


def _questions(spark, sf_dir):
    """For every fifth vector: it, the next two and the one after; beyond the last, words are unknown."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 = 0")
    word = lambda k: F.concat(F.lit("v"), (F.col("vec_id") + k).cast("string"))
    return e.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("category"), F.col("vec_id").alias("seq"), *[word(3 * k).alias(c) for k, c in enumerate("abcd")])


def _known(spark, sf_dir):
    return wv.known_questions(_questions(spark, sf_dir), _vectors(spark, sf_dir))


def _asked(spark, sf_dir):
    q = _known(spark, sf_dir)
    return q.select(F.col("seq").alias("query"), F.col("qa").alias("a"), F.col("qb").alias("b"), F.col("qc").alias("c"))


def vector_arithmetic(spark, sf_dir):
    q = wv.analogy_queries(_units(spark, sf_dir), _asked(spark, sf_dir))
    return q.select("query", F.posexplode("qv").alias("dim", "val")).select("query", "dim", F.round("val", 6).alias("val"))


def neighbors(spark, sf_dir):
    u = _units(spark, sf_dir)
    return wv.neighbors(u, u.where("id % 20 = 0").select(F.col("id").alias("query")), 10).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


def neighbors_phrase(spark, sf_dir):
    u = _units(spark, sf_dir)
    heads = u.where("id % 20 = 0").select(F.col("id").alias("query"))
    terms = heads.select("query", F.explode(F.array(F.col("query"), F.col("query") + 1, F.col("query") + 2)).alias("id"))
    return wv.best(u, wv.phrase_queries(u, terms), 10).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


def analogy_topn(spark, sf_dir):
    u = _units(spark, sf_dir)
    return wv.best(u, wv.analogy_queries(u, _asked(spark, sf_dir), length_one=True), 10).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


def _predicted(spark, sf_dir):
    return wv.predicted(_units(spark, sf_dir), _known(spark, sf_dir))


def analogy_predict(spark, sf_dir):
    return _predicted(spark, sf_dir)


def analogy_coverage(spark, sf_dir):
    return wv.coverage(_questions(spark, sf_dir), _known(spark, sf_dir))


def _semantic():
    return F.col("category") < "label5"


def analogy_accuracy(spark, sf_dir):
    return wv.accuracy(_predicted(spark, sf_dir), _semantic())


def analogy_running_accuracy(spark, sf_dir):
    return wv.running_accuracy(_predicted(spark, sf_dir))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/train-{uuid.uuid4().hex}"


#: Two steps of full batches: what SQL can follow. Other modes are tested in tests/test_training.py.
FULL = replace(TRAIN, mode="fullbatch")


def _trained(spark, sf_dir):
    v, folder = _words(spark, sf_dir), _folder(spark)
    return v, tr.train(_source(spark, sf_dir, v, window_size=5), v.select("id"), FULL, folder), folder


def train_vectors(spark, sf_dir):
    """Word and context vectors after two iterations, by word and dimension."""
    v, params, _ = _trained(spark, sf_dir)
    flat = wv.exported(params, v, 3).select("id", "word", F.posexplode("v").alias("dim", "val"))
    return flat.select("id", "word", "dim", F.round("val", 4).alias("val"))


def train_costs(spark, sf_dir):
    """Mean cost of each iteration, before its step."""
    return tr.costs(spark, _trained(spark, sf_dir)[2]).select("iteration", F.round("cost", 4).alias("cost"))


def checkpoint_list(spark, sf_dir):
    """Iterations in the folder after a run that keeps each one."""
    v, folder = _words(spark, sf_dir), _folder(spark)
    tr.train(_source(spark, sf_dir, v, window_size=5), v.select("id"), replace(TRAIN, checkpoint_every=1), folder)
    return spark.createDataFrame([(k,) for k in tr.Checkpoints(spark, folder).list()], "iteration int")


def resume_equivalence(spark, sf_dir):
    """Largest difference of parameters between two unbroken iterations and one resumed after the first."""
    v, folder = _words(spark, sf_dir), _folder(spark)
    p = _source(spark, sf_dir, v, window_size=5)
    whole = tr.train(p, v.select("id"), TRAIN, f"{folder}-a")
    tr.train(p, v.select("id"), replace(TRAIN, iterations=1), f"{folder}-b")
    again = tr.train(p, v.select("id"), TRAIN, f"{folder}-b", resume=True)
    both = whole.join(again.select("side", "id", F.col("v").alias("v2"), F.col("g").alias("g2")), ["side", "id"])
    gap = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return both.agg(F.max(gap("v", "v2")).alias("vector_gap"), F.max(gap("g", "g2")).alias("accumulator_gap"), F.count(F.lit(1)).alias("rows"))


def stream_vocab_count(spark, sf_dir):
    """The batch query's rows by a stream over the documents table."""
    # As a pattern, the path may be one file or a folder of files.
    single = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parque[t]")
    folder = _folder(spark)
    count_to_table(single, folder, f"{folder}-checkpoint").awaitTermination()
    return latest(spark, folder)


def stream_vocab_changes(spark, sf_dir):
    """The same by three micro-batches of a third of the documents each, with a compaction and a restart after the second."""
    d, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), _folder(spark)
    third = lambda k: d.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k).write.parquet(f"{folder}-in/part={k}")
    kept = Counts(spark, folder)
    for parts in ((0, 1), (2,)):
        for k in parts:
            third(k)
            new = spark.readStream.schema(d.schema).parquet(f"{folder}-in/part=*")
            count_to_table(new, folder, f"{folder}-checkpoint").awaitTermination()
        kept.compact()
    return kept.latest()


def _one_line(spark, sf_dir):
    """All documents in one file of one line, in ascending doc_id order, read back by ranges."""
    path = f"{_folder(spark)}-corpus/one-line.txt"
    text = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" "))
    write_one(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], [text.alias("text")], line_bytes, path)
    return read_pieces(spark, path, range_bytes=1 << 20)


def encode_one_line(spark, sf_dir):
    """Ids of the whole corpus as one line, by place in it."""
    pieces = _one_line(spark, sf_dir)
    found = co.encoded_pieces(pieces, vo.ranked(vo.limited(vo.word_counts(pieces), VocabOptions(min_count=MIN_COUNT))))
    return found.select("line", "pos", "id")


def cooccur_one_line(spark, sf_dir):
    """Pairs of the whole corpus as one line."""
    pieces = _one_line(spark, sf_dir)
    found = co.encoded_pieces(pieces, vo.ranked(vo.limited(vo.word_counts(pieces), VocabOptions(min_count=MIN_COUNT))))
    return co.cooccurrence(found, CooccurOptions(window_size=5))


def vocab_file(spark, sf_dir):
    """The vocabulary written as one file and read back with its line numbers."""
    path = f"{_folder(spark)}-vocab/vocab.txt"
    st.write_vocab(vocab(spark, sf_dir), path)
    return st.read_vocab(spark, path)


def neighbors_all(spark, sf_dir):
    """Three nearest of every vector, against all vectors."""
    u = written(_units(spark, sf_dir), "units")
    return wv.neighbors(u, u.select(F.col("id").alias("query")), 3).select("query", "rank", "id", F.round("similarity", 6).alias("similarity"))


def evaluate_binary(spark, sf_dir):
    """Accuracy of vectors read from a binary parameter file: the embeddings as word vectors, reversed as context vectors."""
    v = _vectors(spark, sf_dir).withColumn("id", F.col("id") + 1)
    sides = [v.select(F.lit(s).alias("side"), "id", (F.reverse("v") if s == "c" else F.col("v")).alias("v"), F.col("id").cast("double").alias("b")) for s in "wc"]
    path = f"{_folder(spark)}-params/vectors.bin"
    binary.write_parameter_file(sides[0].unionByName(sides[1]), path)
    read = written(binary.read_summed(spark, path, v.select("id", "word")), "vectors")
    return wv.evaluated(read, _questions(spark, sf_dir), _semantic())


def _started_default(spark, sf_dir):
    v = _words(spark, sf_dir, MIN_COUNT)
    return _source(spark, sf_dir, v), tr.initial(v.select("id"), TRAIN)


def train_cost_default(spark, sf_dir):
    """train_cost with the usual cuts: words seen five times, windows of 15."""
    return tr.cost(*_started_default(spark, sf_dir), TRAIN).select(F.round("cost", 6).alias("cost"))


def adagrad_step_default(spark, sf_dir):
    """adagrad_step with the usual cuts."""
    return _flat(tr.fullbatch_step(*_started_default(spark, sf_dir), TRAIN))


def train_fit(spark, sf_dir):
    """Five epochs of stratified training on all pairs (words seen five times, windows of 15): whether each epoch's mean cost is below the one before, the first below that of the initial parameters."""
    v, folder = _words(spark, sf_dir, MIN_COUNT), _folder(spark)
    p = _source(spark, sf_dir, v)
    options = replace(TRAIN, iterations=5, blocks=0)
    tr.train(p, v.select("id"), options, folder)
    first = tr.measured(p, tr.initial(v.select("id"), options), options).first()
    before = F.lag("cost").over(Window.orderBy("iteration"))  # six rows
    costs = spark.createDataFrame([(0, first.cost)], "iteration int, cost double").unionByName(tr.costs(spark, folder))
    return costs.select("iteration", F.lit(first.pairs).cast("long").alias("pairs"), (F.col("cost") < before).alias("falls")).where("iteration > 0")


def vector_lookup(spark, sf_dir):
    """Vectors of every word of the corpus: words out of the vocabulary get the unknown vector."""
    v = wv.exported(_start(spark, sf_dir), vocab(spark, sf_dir, 20), 1)
    found = wv.looked_up(v, counts(spark, sf_dir).select("word"), wv.unknown_vector(v))
    return found.select("word", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[SIZE - 1], 9).alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, corpus_stats, vocab_count, vocab_min_count, vocab_max, vocab_max_min, vocab_report, vocab_rank, unk_guard, vocab_lines, encode_corpus, corpus_weighting,
        cooccur_sym, cooccur_asym, cooccur_unweighted, cooccur_w5, cooccur_w10, cooccur_partial_final, shuffle_content, pair_weights, init_params, train_cost, adagrad_step,
        unk_vector, vector_export_text, normalize_vectors, vector_arithmetic, neighbors, neighbors_phrase, analogy_topn, analogy_predict, analogy_coverage, analogy_accuracy,
        analogy_running_accuracy, train_vectors, train_costs, checkpoint_list, resume_equivalence, stream_vocab_count, vector_lookup, cooccur_weighted_corpus,
        stream_vocab_changes, encode_one_line, cooccur_one_line, vocab_file, neighbors_all, evaluate_binary, train_cost_default, adagrad_step_default, train_fit,
    )
} | {f"export_model{m}": _export(m) for m in range(4)}

# --- SQL -------------------------------------------------------------------------------------------------

_LINES = "(SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS ls FROM documents)))"
_TOKENS = f"""lw AS (SELECT doc_id, line, list_filter(string_split_regex(t, '[ \\t]+'), lambda w: w <> '') AS ws FROM {_LINES}),
tokens AS (SELECT doc_id, line, i - 1 AS pos, ws[i] AS word FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws) + 1)) AS i FROM lw))"""
_COUNTS = f"{_TOKENS}, counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word)"
_MAX = "(SELECT * FROM counts ORDER BY n DESC, md5(word), word LIMIT {})"


def _vocab_sql(least):
    return f"{_COUNTS}, vocab AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS id, word, n FROM counts WHERE n >= {least})"


def _ids_sql(least):
    return f"{_vocab_sql(least)}, ids AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) - 1 AS pos, id FROM tokens JOIN vocab USING (word))"


def _pairs_sql(least=MIN_COUNT, window_size=15, symmetric=True, distance_weighting=True):
    unit = co.unit_for(window_size) if distance_weighting else 1
    u = f"{unit} // (b.pos - a.pos)" if distance_weighting else "1"
    cells = "SELECT i1 AS word1, i2 AS word2, u FROM near" + (" UNION ALL SELECT i2, i1, u FROM near" if symmetric else "")
    return f"""{_ids_sql(least)},
near AS (SELECT a.id AS i1, b.id AS i2, sum({u}) AS u FROM ids a JOIN ids b ON a.doc_id = b.doc_id AND a.line = b.line AND b.pos > a.pos AND b.pos - a.pos <= {window_size} GROUP BY ALL),
pairs AS (SELECT word1, word2, CAST(sum(u) AS DOUBLE) / {float(unit)} AS val FROM ({cells}) GROUP BY ALL)"""


def _params_sql(least=20):
    value = f"(((id * 7919 + dim * 104729 + sd * 1299709) % 1000003) / 1000003.0 - 0.5) / {float(SIZE)}"
    return f"params AS (SELECT side, id, dim, CAST({value} AS DOUBLE) AS val FROM (SELECT CAST(id AS BIGINT) AS id, word FROM vocab), (VALUES ('w', 0), ('c', 1)) s(side, sd), (SELECT CAST(unnest(range(0, {SIZE + 1})) AS INTEGER) AS dim))"


def _lists_sql(name: str) -> str:
    """The initial parameters as lists: side, id, b, v, gb, g."""
    value = lambda dim: f"CAST((((id * 7919 + {dim} * 104729 + sd * 1299709) % 1000003) / 1000003.0 - 0.5) / {float(SIZE)} AS DOUBLE)"
    return f"{name} AS MATERIALIZED (SELECT side, id, {value(0)} AS b, list_transform(range(1, {SIZE + 1}), lambda k: {value('k')}) AS v, 1.0::DOUBLE AS gb, list_transform(range(1, {SIZE + 1}), lambda k: 1.0::DOUBLE) AS g FROM (SELECT CAST(id AS BIGINT) AS id FROM vocab), (VALUES ('w', 0), ('c', 1)) s(side, sd))"


def _errors_sql(old: str, errors: str) -> str:
    return f"""{errors} AS MATERIALIZED (SELECT word1, word2, diff, CASE WHEN x > 10 THEN 1.0 ELSE pow(x / 10, 0.75) END * diff AS fd FROM (
  SELECT word1, word2, p.val AS x, list_dot_product(w.v, c.v) + w.b + c.b - ln(p.val) AS diff FROM pairs p JOIN {old} w ON w.side = 'w' AND w.id = word1 JOIN {old} c ON c.side = 'c' AND c.id = word2))"""


def _step_sql(old: str, errors: str, grads: str, new: str) -> str:
    """Errors at the parameters ``old`` (side, id, b, v, gb, g), summed gradients, and the parameters ``new`` after the step."""
    sums = ", ".join(f"sum(greatest(least(fd * o.v[{k}], 100), -100) * {TRAIN.eta})" for k in range(1, SIZE + 1))
    return f"""{_errors_sql(old, errors)},
{grads} AS MATERIALIZED (SELECT 'w' AS side, word1 AS id, sum(fd) AS f, [{sums}] AS t FROM {errors} JOIN {old} o ON o.side = 'c' AND o.id = word2 GROUP BY word1
  UNION ALL SELECT 'c', word2, sum(fd), [{sums}] FROM {errors} JOIN {old} o ON o.side = 'w' AND o.id = word1 GROUP BY word2),
{new} AS MATERIALIZED (SELECT side, id, b - coalesce(f, 0) / sqrt(gb) AS b, CASE WHEN t IS NULL THEN v ELSE list_transform(range(1, {SIZE + 1}), lambda k: v[k] - t[k] / sqrt(g[k])) END AS v,
  gb + coalesce(f * f, 0) AS gb, CASE WHEN t IS NULL THEN g ELSE list_transform(range(1, {SIZE + 1}), lambda k: g[k] + t[k] * t[k]) END AS g FROM {old} LEFT JOIN {grads} USING (side, id))"""


def _first_sql(least, window):
    return f"{_pairs_sql(least, window)}, {_lists_sql('p0')}, {_errors_sql('p0', 'e0')}"


def _stepped_sql(least, window):
    return f"{_pairs_sql(least, window)}, {_lists_sql('p0')}, {_step_sql('p0', 'e0', 'g0', 'p1')}"


_COST = "round(sum(0.5 * fd * diff) / (SELECT count(*) FROM pairs), {})"
#: Dimension 0 is the bias.
_FLAT = f"(SELECT side, id, unnest(range(0, {SIZE + 1})) AS dim, unnest(list_concat([b], v)) AS val, unnest(list_concat([gb], g)) AS acc FROM {{}})"
_FLAT_STEP = f"SELECT side, CAST(id AS INTEGER) AS id, CAST(dim AS INTEGER) AS dim, round(val, 5) + 0.0 AS val, round(acc, 5) AS acc FROM {_FLAT.format('p1')}"


def _export_sql(model):
    last = SIZE
    w, c = "side = 'w' AND dim > 0", "side = 'c' AND dim > 0"
    rows = {
        0: f"SELECT id, CASE WHEN side = 'w' THEN 0 ELSE {last + 1} END + CASE WHEN dim = 0 THEN {last} ELSE dim - 1 END AS dim, val FROM params",
        1: f"SELECT id, dim - 1 AS dim, val FROM params WHERE {w}",
        2: "SELECT id, dim - 1 AS dim, sum(val) AS val FROM params WHERE dim > 0 GROUP BY id, dim",
        3: f"SELECT id, dim - 1 AS dim, val FROM params WHERE {w} UNION ALL SELECT id, dim - 1 + {last}, val FROM params WHERE {c}",
    }[model]
    return f"{_vocab_sql(20)}, {_params_sql()}, x AS ({rows})"


_UNITS = """ev AS (SELECT CAST(vec_id AS INTEGER) AS id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
u AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM ev)"""
_QUESTIONS = """q AS (SELECT 'label' || label AS category, vec_id AS seq, vec_id AS a, vec_id + 3 AS b, vec_id + 6 AS c, vec_id + 9 AS d FROM embeddings WHERE vec_id % 5 = 0),
k AS (SELECT * FROM q WHERE d <= (SELECT max(vec_id) FROM embeddings))"""
_SUMMED = """ev AS (SELECT CAST(vec_id AS INTEGER) AS id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) + CAST(embedding[len(embedding) + 1 - i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
u AS (SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM ev)"""


def _analogy_sql(units):
    return f"""{units}, {_QUESTIONS},
qv AS (SELECT seq, dim, sum(CASE WHEN u.id = a THEN -x ELSE x END) AS x FROM k JOIN u ON u.id IN (a, b, c) GROUP BY seq, dim),
sc AS (SELECT qv.seq, u.id, sum(qv.x * u.x) AS s FROM qv JOIN u USING (dim) GROUP BY ALL),
qn AS (SELECT seq, sqrt(sum(x * x)) AS norm FROM qv GROUP BY seq),
rk AS (SELECT sc.seq, sc.id, s, row_number() OVER (PARTITION BY sc.seq ORDER BY round(s, 12) DESC, sc.id) AS rank FROM sc JOIN k USING (seq) WHERE sc.id NOT IN (a, b, c)),
pr AS (SELECT category, k.seq, CAST(d AS INTEGER) AS expected, rk.id AS predicted, d = rk.id AS correct FROM k JOIN rk ON rk.seq = k.seq AND rank = 1)"""


_ANALOGY = _analogy_sql(_UNITS)
_PER = "SELECT category, count(*) AS seen, count(*) FILTER (correct) AS correct FROM pr GROUP BY category"
_REPORT = """SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(kind) = 0 THEN 'kind' ELSE 'all' END AS level, coalesce(category, kind, 'all') AS name,
count(*) AS seen, count(*) FILTER (correct) AS correct, 100.0 * count(*) FILTER (correct) / CAST(count(*) AS DOUBLE) AS accuracy
FROM (SELECT *, CASE WHEN category < 'label5' THEN 'semantic' ELSE 'syntactic' END AS kind FROM pr) GROUP BY GROUPING SETS ((category), (kind), ())"""

ORACLE_SQL = {
    "tokenize": f"WITH {_TOKENS} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, word FROM tokens",
    "corpus_stats": f"WITH {_COUNTS} SELECT CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_words FROM counts",
    "vocab_count": f"WITH {_COUNTS} SELECT word, n FROM counts",
    "stream_vocab_count": f"WITH {_COUNTS} SELECT word, n FROM counts",
    "vocab_min_count": f"WITH {_COUNTS} SELECT word, n FROM counts WHERE n >= {MIN_COUNT}",
    "vocab_max": f"WITH {_COUNTS} SELECT word, n FROM {_MAX.format(1000)}",
    "vocab_max_min": f"WITH {_COUNTS} SELECT word, n FROM {_MAX.format(2000)} WHERE n >= 30",
    "vocab_report": f"""WITH {_COUNTS}, m AS (SELECT * FROM {_MAX.format(2000)} WHERE n >= 30), z AS (SELECT count(*) AS size, min(n) AS least_count FROM m), al AS (SELECT count(*) AS c FROM counts)
SELECT size, least_count, CASE WHEN size < least(c, 2000) THEN 'count' WHEN size < c THEN 'size' ELSE 'none' END AS cut_by FROM z, al""",
    "vocab_rank": f"WITH {_vocab_sql(MIN_COUNT)} SELECT id, word, n FROM vocab",
    "vocab_lines": f"WITH {_vocab_sql(MIN_COUNT)} SELECT word || ' ' || n AS value FROM vocab",
    "unk_guard": f"WITH {_TOKENS} SELECT count(*) AS n_unk, count(*) = 0 AS usable FROM tokens WHERE word = '<unk>'",
    "encode_corpus": f"WITH {_ids_sql(MIN_COUNT)} SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(pos AS INTEGER) AS pos, id FROM ids",
    "corpus_weighting": f"""WITH {_COUNTS}, cw AS (SELECT unnest(string_split_regex(replace(text, chr(13), ''), '[ \\t\\n]+')) AS word FROM conversations),
al AS (SELECT word, 2 * n AS n FROM counts UNION ALL SELECT word, count(*) FROM cw WHERE word <> '' GROUP BY word) SELECT word, CAST(sum(n) AS BIGINT) AS n FROM al GROUP BY word""",
    "cooccur_sym": f"WITH {_pairs_sql()} SELECT * FROM pairs",
    "cooccur_asym": f"WITH {_pairs_sql(symmetric=False)} SELECT * FROM pairs",
    "cooccur_unweighted": f"WITH {_pairs_sql(window_size=10, distance_weighting=False)} SELECT * FROM pairs",
    "cooccur_w5": f"WITH {_pairs_sql(window_size=5)} SELECT * FROM pairs",
    "cooccur_w10": f"WITH {_pairs_sql(window_size=10)} SELECT * FROM pairs",
    "cooccur_partial_final": f"WITH {_pairs_sql(window_size=10)} SELECT word1, count(*) AS n_contexts, round(sum(val), 6) AS total FROM pairs GROUP BY word1",
    "shuffle_content": f"WITH {_pairs_sql(20, 5)} SELECT * FROM pairs",
    "pair_weights": f"WITH {_pairs_sql(20, 5)} SELECT word1, word2, round(CASE WHEN val > 10 THEN 1.0 ELSE pow(val / 10, 0.75) END, 6) AS weight, round(ln(val), 6) AS target FROM pairs",
    "init_params": f"WITH {_vocab_sql(20)}, {_params_sql()} SELECT side, CAST(id AS INTEGER) AS id, dim, round(val, 9) AS val FROM params",
    "train_cost": f"WITH {_first_sql(20, 5)} SELECT {_COST.format(6)} AS cost FROM e0",
    "train_cost_default": f"WITH {_first_sql(MIN_COUNT, 15)} SELECT {_COST.format(6)} AS cost FROM e0",
    "adagrad_step": f"WITH {_stepped_sql(20, 5)} {_FLAT_STEP}",
    "adagrad_step_default": f"WITH {_stepped_sql(MIN_COUNT, 15)} {_FLAT_STEP}",
    "train_vectors": f"""WITH {_stepped_sql(20, 5)}, {_step_sql('p1', 'e1', 'g1', 'p2')} SELECT CAST(id AS INTEGER) AS id, word, CAST(CASE WHEN side = 'w' THEN dim - 1 ELSE dim - 1 + {SIZE} END AS INTEGER) AS dim, round(val, 4) + 0.0 AS val
FROM {_FLAT.format('p2')} JOIN vocab USING (id) WHERE dim > 0""",
    "train_costs": f"""WITH {_stepped_sql(20, 5)}, {_errors_sql('p1', 'e1')} SELECT 1 AS iteration, {_COST.format(4)} AS cost FROM e0
UNION ALL SELECT 2, {_COST.format(4)} FROM e1""",
    "train_fit": f"WITH {_pairs_sql()} SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS iteration, count(*) AS pairs, true AS falls FROM pairs",
    "stream_vocab_changes": f"WITH {_COUNTS} SELECT word, n FROM counts",
    "vocab_file": f"WITH {_vocab_sql(MIN_COUNT)} SELECT id, word, n FROM vocab",
    "encode_one_line": f"WITH {_vocab_sql(MIN_COUNT)} SELECT CAST(0 AS BIGINT) AS line, row_number() OVER (ORDER BY doc_id, line, pos) - 1 AS pos, id FROM tokens JOIN vocab USING (word)",
    "cooccur_one_line": f"""WITH {_vocab_sql(MIN_COUNT)}, ids AS (SELECT row_number() OVER (ORDER BY doc_id, line, pos) AS pos, id FROM tokens JOIN vocab USING (word)),
near AS (SELECT a.id AS i1, b.id AS i2, sum(60 // d) AS u FROM (SELECT id, pos, unnest([1, 2, 3, 4, 5]) AS d FROM ids) a JOIN ids b ON b.pos = a.pos + a.d GROUP BY ALL)
SELECT word1, word2, CAST(sum(u) AS DOUBLE) / 60 AS val FROM (SELECT i1 AS word1, i2 AS word2, u FROM near UNION ALL SELECT i2, i1, u FROM near) GROUP BY ALL""",
    "checkpoint_list": "SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS iteration",
    "resume_equivalence": f"WITH {_vocab_sql(20)} SELECT 0.0::DOUBLE AS vector_gap, 0.0::DOUBLE AS accumulator_gap, 2 * count(*) AS rows FROM vocab",
    "vector_lookup": f"""WITH {_vocab_sql(20)}, {_params_sql()}, x AS (SELECT id, dim, val FROM params WHERE side = 'w' AND dim IN (1, {SIZE})),
un AS (SELECT dim, avg(val) AS val FROM x WHERE id > (SELECT max(id) FROM x) - 100 GROUP BY dim), al AS (SELECT word, dim, coalesce(x.val, un.val) AS val FROM counts CROSS JOIN un LEFT JOIN vocab USING (word) LEFT JOIN x USING (id, dim))
SELECT word, round(max(val) FILTER (dim = 1), 9) AS first, round(max(val) FILTER (dim = {SIZE}), 9) AS last FROM al GROUP BY word""",
    "cooccur_weighted_corpus": f"WITH {_pairs_sql(20, 5)} SELECT word1, word2, 2 * val AS val FROM pairs",
    "unk_vector": f"WITH {_export_sql(0)} SELECT CAST(dim AS INTEGER) AS dim, round(avg(val), 9) AS val FROM x WHERE id > (SELECT max(id) FROM x) - 100 GROUP BY dim",
    "vector_export_text": f"""WITH {_export_sql(2)}, ls AS (SELECT id, string_agg(printf('%.6f', val), ' ' ORDER BY dim) AS f FROM x GROUP BY id)
SELECT CAST(id AS BIGINT) AS line_no, word || ' ' || f AS value FROM ls JOIN vocab USING (id) UNION ALL SELECT 0, (SELECT count(*) FROM vocab) || ' {SIZE}'""",
    "normalize_vectors": f"WITH {_UNITS} SELECT id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS val FROM u",
    "vector_arithmetic": f"WITH {_ANALOGY} SELECT seq AS query, CAST(dim AS INTEGER) AS dim, round(x, 6) AS val FROM qv",
    "neighbors": f"""WITH {_UNITS}, sc AS (SELECT a.id AS query, b.id, sum(a.x * b.x) AS s FROM u a JOIN u b USING (dim) WHERE a.id % 20 = 0 AND a.id <> b.id GROUP BY ALL)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS similarity FROM sc QUALIFY rank <= 10""",
    "neighbors_all": f"""WITH {_UNITS}, sc AS (SELECT a.id AS query, b.id, sum(a.x * b.x) AS s FROM u a JOIN u b USING (dim) WHERE a.id <> b.id GROUP BY ALL)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS similarity FROM sc QUALIFY rank <= 3""",
    "neighbors_phrase": f"""WITH {_UNITS}, p AS (SELECT a.id AS query, u.dim, sum(u.x) AS x FROM (SELECT DISTINCT id FROM u WHERE id % 20 = 0) a JOIN u ON u.id BETWEEN a.id AND a.id + 2 GROUP BY ALL),
p1 AS (SELECT query, dim, x / sqrt(sum(x * x) OVER (PARTITION BY query)) AS x FROM p),
sc AS (SELECT query, b.id, sum(p1.x * b.x) AS s FROM p1 JOIN u b USING (dim) WHERE b.id NOT BETWEEN query AND query + 2 GROUP BY ALL)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(s, 12) DESC, id) AS INTEGER) AS rank, id, round(s, 6) AS similarity FROM sc QUALIFY rank <= 10""",
    "analogy_topn": f"WITH {_ANALOGY} SELECT seq AS query, CAST(rank AS INTEGER) AS rank, id, round(s / norm, 6) AS similarity FROM rk JOIN qn USING (seq) WHERE rank <= 10",
    "analogy_predict": f"WITH {_ANALOGY} SELECT * FROM pr",
    "analogy_coverage": f"WITH {_QUESTIONS} SELECT category, count(*) AS total, count(*) FILTER (d <= (SELECT max(vec_id) FROM embeddings)) AS seen FROM q GROUP BY category",
    "analogy_accuracy": f"WITH {_ANALOGY} {_REPORT}",
    "evaluate_binary": f"WITH {_analogy_sql(_SUMMED)} {_REPORT}",
    "analogy_running_accuracy": f"""WITH {_ANALOGY}, c AS ({_PER}) SELECT category, seen, correct,
CAST(sum(seen) OVER (ORDER BY category) AS BIGINT) AS seen_so_far, CAST(sum(correct) OVER (ORDER BY category) AS BIGINT) AS correct_so_far FROM c""",
} | {f"export_model{m}": f"WITH {_export_sql(m)} SELECT CAST(id AS INTEGER) AS id, word, CAST(dim AS INTEGER) AS dim, round(val, 9) AS val FROM x JOIN vocab USING (id)" for m in range(4)}
