"""Pairs added up by runs, against pairs counted one by one."""

from collections import Counter
from random import Random

import pytest

from wordloom.config import CooccurOptions
from wordloom.operators import cooccur, pair_runs


def lines_of(seed, least=1):
    rng = Random(seed)
    return {(r, k): [rng.randint(least, 40) for _ in range(rng.choice([1, 2, 7, 60, 500]))] for r in range(6) for k in range(3)}


def table(spark, lines, dealt=True):
    rows = [(r, k, p, i) for (r, k), ids in lines.items() for p, i in enumerate(ids)]
    if dealt:
        Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "row long, line int, pos long, id int")


def one_by_one(lines, options):
    unit, sums = cooccur.unit_for(options.window_size) if options.distance_weighting else 1, Counter()
    for ids in lines.values():
        for p, a in enumerate(ids):
            for d, b in enumerate(ids[p + 1 : p + 1 + options.window_size], 1):
                sums[(min(a, b), max(a, b)) if options.symmetric else (a, b)] += unit // d if options.distance_weighting else 1
    return sums


@pytest.mark.parametrize("options", [CooccurOptions(15), CooccurOptions(4, symmetric=False), CooccurOptions(7, distance_weighting=False), CooccurOptions(1), CooccurOptions(25)])
def test_runs_pieces_and_buckets_equal_pairs_counted_one_by_one(spark, monkeypatch, options):
    for name, value in (("PIECE", 50), ("MOST_PAIRS", 900), ("BUCKET_PAIRS", 700), ("TASK_TOKENS", 500)):
        monkeypatch.setattr(pair_runs, name, value)
    lines = lines_of(1)
    found = {(r.word1, r.word2): r.units for r in cooccur.pair_sums(table(spark, lines), options).collect()}
    assert found == dict(one_by_one(lines, options))


def test_no_tokens_and_one_word(spark):
    assert cooccur.pair_sums(table(spark, {(0, 0): []}), CooccurOptions()).collect() == []
    assert [tuple(r) for r in cooccur.pair_sums(table(spark, {(0, 0): [1] * 3}), CooccurOptions(2, distance_weighting=False)).collect()] == [(1, 1, 3)]


def test_ids_too_large_for_a_key_go_by_the_join(spark):
    big = 2**31 - 1
    assert not pair_runs.fits(15, big) and pair_runs.fits(15, 2**29)
    assert [tuple(r) for r in cooccur.pair_sums(table(spark, {(0, 0): [big, 5]}), CooccurOptions(15)).collect()] == [(5, big, cooccur.unit_for(15))]


def test_no_row_a_pair_is_shuffled(spark):
    lines = {(r, 0): [1 + (p * p + r) % 50 for p in range(3000)] for r in range(4)}
    found = cooccur.pair_sums(table(spark, lines, dealt=False), CooccurOptions(15))
    assert "Join" not in found._jdf.queryExecution().toString()
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    found.collect()
    new = [s for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() not in before]
    assert sum(s.shuffleWriteRecords() for s in new) < 4 * 3000 < sum(one_by_one(lines, CooccurOptions(15, distance_weighting=False)).values())
