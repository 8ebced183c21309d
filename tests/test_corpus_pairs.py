"""Pairs of a corpus that are added up where they are used, against the table of encoded tokens, and what is shuffled for them."""

from dataclasses import replace
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.config import CooccurOptions, TrainOptions
from wordloom.operators import cooccur, pair_runs, vocab
from wordloom.plans import cells, training


def corpus(spark):
    rng = Random(8)
    some = ["a", "b", "c", "é", "日本", "a\rb", "\r", "a　b", "y" * 999, "y" * 1005, *[f"w{k}" for k in range(40)]]
    text = lambda n: "".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\t", "\n", " \n\n"]) for _ in range(n))
    rows = [(k % 5 or None, text(rng.choice([0, 1, 5, 60, 400]))) for k in range(40)] + [(7, None), (7, "\n"), (8, "a")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def known(docs, least=3):
    return vocab.ranked(vocab.limited(vocab.word_counts(docs), vocab.VocabOptions(min_count=least)))


def small(monkeypatch):
    for name, value in (("MOST_PAIRS", 2000), ("HELD_BYTES", 12_000), ("CHUNKS", 5), ("BUCKET_PAIRS", 4000), ("MERGED", 500)):
        monkeypatch.setattr(pair_runs, name, value)
    monkeypatch.setattr(cooccur, "LOOKUP_BYTES", 1500)


OPTIONS = [CooccurOptions(15), CooccurOptions(5), CooccurOptions(4, symmetric=False), CooccurOptions(6, distance_weighting=False)]


@pytest.mark.parametrize("options", OPTIONS)
def test_all_uses_give_the_pairs_of_encoded_tokens(spark, monkeypatch, options):
    small(monkeypatch)
    docs = corpus(spark)
    v = known(docs)
    expected = sorted(map(tuple, cooccur.cooccurrence(cooccur.encoded(docs, v), options).collect()))
    pairs = cooccur.corpus_pairs(docs, v, options)
    assert isinstance(pairs, cooccur.CorpusPairs) and pairs.met > 4000
    assert sorted(map(tuple, pairs.table().collect())) == expected
    assert list(map(tuple, cooccur.ordered(pairs).collect())) == expected
    table = spark.createDataFrame(expected, "word1 int, word2 int, val double")
    assert list(map(tuple, cooccur.shuffled(pairs, 7).collect())) == list(map(tuple, cooccur.shuffled(table, 7).collect()))


def test_a_vocabulary_too_large_to_be_sent_goes_by_the_table(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "SENT_BYTES", -1)
    docs = corpus(spark)
    v = known(docs)
    pairs = cooccur.corpus_pairs(docs, v, CooccurOptions(3))
    assert not isinstance(pairs, cooccur.CorpusPairs)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, cooccur.cooccurrence(cooccur.encoded(docs, v), CooccurOptions(3)).collect()))


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    pairs = cooccur.corpus_pairs(docs, known(docs, 5), CooccurOptions(3))
    assert pairs.table().collect() == cooccur.ordered(pairs).collect() == cooccur.shuffled(pairs, 1).collect() == []


def test_the_hash_is_spark_s(spark):
    rng = np.random.default_rng(2)
    one, two = rng.integers(1, 2**31, 200), rng.integers(1, 2**31, 200)
    rows = spark.createDataFrame(zip(range(200), one.tolist(), two.tolist()), "at int, a int, b int")
    for seed in (0, 7, -3):
        found = rows.select("at", F.xxhash64(F.lit(seed), "a", "b").alias("h")).orderBy("at").collect()
        assert pair_runs.pair_hash(seed, one, two).tolist() == [r.h for r in found]


def shuffled_rows(spark, action):
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: [s for k in [store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())] for s in (k.apply(i) for i in range(k.size()))]
    before = {s.stageId() for s in stages()}
    action()
    return sum(s.shuffleWriteRecords() for s in stages() if s.stageId() not in before)


def big(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * p * p + p) % 90}" for p in range(700))) for k in range(20)], "doc_id long, text string").coalesce(4)
    return docs, known(docs, 1)


@pytest.mark.parametrize("use", [cooccur.as_table, cooccur.ordered, cooccur.shuffled])
def test_neither_tokens_nor_pairs_are_shuffled_as_rows(spark, use):
    docs, v = big(spark)
    pairs = cooccur.corpus_pairs(docs, v, CooccurOptions(10))
    found = use(pairs)
    assert shuffled_rows(spark, found.collect) < 100 < found.count()


TRAIN = TrainOptions(vector_size=4, x_max=10.0, iterations=2, blocks=3)


def values(params):
    return {(r.side, r.id): [*r.v, r.b, *r.g, r.gb] for r in params.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_steps_and_costs_of_a_corpus_equal_those_of_its_table(spark, monkeypatch):
    small(monkeypatch)
    docs = corpus(spark)
    v = known(docs)
    pairs = cooccur.corpus_pairs(docs, v, CooccurOptions(5))
    table, params = pairs.table().cache(), training.initial(v.select("id"), TRAIN)
    for settings in ({}, {"SUM_RECORDS": 3000, "READ": 7}, {"PART_BYTES": 400}):
        for name, value in settings.items():
            monkeypatch.setattr(cells, name, value)
        assert close(values(training.fullbatch_step(pairs, params, TRAIN)), values(training.fullbatch_step(table, params, TRAIN)))
        one, two = (training.measured(p, params, TRAIN).first() for p in (pairs, table))
        assert one.cost == pytest.approx(two.cost) and one.pairs == two.pairs == table.count()


def test_a_step_shuffles_neither_records_nor_gradients_as_rows(spark):
    docs, v = big(spark)
    pairs, params = cooccur.corpus_pairs(docs, v, CooccurOptions(10)), training.initial(v.select("id"), TRAIN)
    step = training.fullbatch_step(pairs, params, TRAIN)
    assert shuffled_rows(spark, step.collect) < 300 < pairs.table().count()
    plan = step._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_cells_of_a_corpus_hold_each_pair_once_in_several_files(spark, monkeypatch, tmp_path):
    small(monkeypatch)
    monkeypatch.setattr(pair_runs, "BUCKET_PAIRS", 600)
    docs = corpus(spark)
    v = known(docs)
    pairs = cooccur.corpus_pairs(docs, v, CooccurOptions(5))
    expected = sorted(map(tuple, pairs.table().collect()))
    assert cells.laid_cells(pairs, 3, 0, f"file://{tmp_path}/laid") == len(expected)
    found = spark.read.parquet(f"{tmp_path}/laid")
    assert sorted((r.word1, r.word2, r.val) for r in found.collect()) == expected
    assert found.where("pmod(word1, 3) != p or pmod(word2 - word1, 3) != s").count() == 0
    assert all(len(list(cell.glob("0*.parquet"))) > 1 for cell in tmp_path.glob("laid/s=*/p=*"))


def test_stratified_training_of_a_corpus_and_its_scratch(spark, monkeypatch, tmp_path):
    options = replace(TRAIN, batch=4, iterations=1)
    monkeypatch.setattr(training, "CELL_RECORDS", 10)
    docs = corpus(spark)
    v = known(docs)
    pairs, parts, tables = cooccur.corpus_pairs(docs, v, CooccurOptions(5)), [], []
    whole, path = training.sub_epoch, training.Checkpoints.scratch_path
    monkeypatch.setattr(training, "sub_epoch", lambda *a: (parts.append(a[4]), whole(*a))[1])
    monkeypatch.setattr(training.Checkpoints, "scratch_path", lambda self, *a: (tables.append(len(self.waste)), path(self, *a))[1])
    one = training.train(pairs, v.select("id"), options, f"{tmp_path}/a")
    assert set(parts) == {8}  # as many as cores, or 8: an epoch writes all parameters once a part
    assert max(tables) == 1  # tables of earlier sub-epochs are gone
    costs = [training.cost(pairs, params, options).first().cost for params in (training.initial(v.select("id"), options), one)]
    assert costs[0] > costs[1] > 0
