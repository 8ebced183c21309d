import math
import struct
from dataclasses import replace

import pytest

from wordloom.config import TrainOptions
from wordloom.functions import vectors as vec
from wordloom.operators import vectors as wv
from wordloom.plans import training
from wordloom.plans.checkpoint import Checkpoints
from wordloom.sources import binary, text

OPTIONS = TrainOptions(vector_size=3, iterations=3, x_max=10.0, blocks=2, batch=4)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, j, float(1 + (i * j) % 7)) for i in range(1, 13) for j in range(1, 13) if (i + j) % 3]
    return spark.createDataFrame(rows, "word1 int, word2 int, val double")


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(1, 13).select("id")


def values(params):
    return sorted((r.side, r.id, tuple(r.v), r.b, tuple(r.g), r.gb) for r in params.collect())


def test_one_update(spark):
    params = spark.createDataFrame([("w", 1, [0.1], 0.0, [1.0], 1.0), ("c", 1, [0.2], 0.0, [1.0], 1.0)], training.PARAMS)
    pair = spark.createDataFrame([(1, 1, 10.0)], "word1 int, word2 int, val double")
    options = TrainOptions(vector_size=1, x_max=10.0)
    assert training.cost(pair, params, options).first().cost == pytest.approx(2.605097, abs=1e-6)
    for step in (training.fullbatch_step, training.exact_epoch):
        got = {r.side: r for r in step(pair, params, options).collect()}
        assert got["w"].v[0] == pytest.approx(0.1228259, abs=1e-6)
        assert got["c"].v[0] == pytest.approx(0.2114129, abs=1e-6)
        assert got["w"].g[0] == pytest.approx(1.00052102, abs=1e-7)
        assert got["w"].b == pytest.approx(2.282585, abs=1e-6)
        assert got["c"].gb == pytest.approx(1 + 5.210195, abs=1e-5)


@pytest.mark.parametrize("mode", ["exact", "stratified", "fullbatch"])
def test_cost_falls_resume_and_seed(spark, pairs, ids, tmp_path, mode):
    options = replace(OPTIONS, mode=mode)
    whole = training.train(pairs, ids, options, f"{tmp_path}/a")
    before = training.cost(pairs, training.initial(ids, options), options).first().cost
    if mode != "fullbatch":  # its first summed bias steps, which eta doesn't scale, overshoot
        assert training.cost(pairs, whole, options).first().cost < before
    costs = [tuple(r) for r in training.costs(spark, f"{tmp_path}/a").collect()]
    assert [k for k, _ in costs] == [1, 2, 3] and (mode == "fullbatch" or costs[0][1] > costs[-1][1] > 0)
    training.train(pairs, ids, replace(options, iterations=1), f"{tmp_path}/b")
    again = training.train(pairs, ids, options, f"{tmp_path}/b", resume=True)
    if mode == "fullbatch":  # sums of doubles, whose order is Spark's
        flat = lambda p: [x for _, _, v, b, g, gb in values(p) for x in (*v, b, *g, gb)]
        assert flat(again) == pytest.approx(flat(whole), rel=1e-9)
    else:
        assert values(again) == values(whole)
    assert values(training.train(pairs, ids, replace(options, seed=5), f"{tmp_path}/c")) != values(whole)


def test_start_from_given_parameters(spark, pairs, ids, tmp_path):
    options = replace(OPTIONS, mode="exact")
    two = training.train(pairs, ids, replace(options, iterations=2), f"{tmp_path}/a")
    training.train(pairs, ids, replace(options, iterations=1), f"{tmp_path}/b")
    one = Checkpoints(spark, f"{tmp_path}/b").load(1)
    assert values(training.train(pairs, ids, replace(options, iterations=1), f"{tmp_path}/c", start=one)) == values(two)
    bare = training.started(ids, options, one.select("side", "id", "v", "b"))
    assert {tuple(r.g) for r in bare.collect()} == {(1.0, 1.0, 1.0)} and {r.gb for r in bare.collect()} == {1.0}
    left = sorted(p.name for p in (tmp_path / "a").iterdir())
    assert left == ["costs", "iter=000", "iter=002"]


def test_the_pair_plan_runs_once(spark, pairs, ids, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counting = pairs.mapInArrow(count, pairs.schema)
    training.train(counting, ids, replace(OPTIONS, blocks=3), f"{tmp_path}/a")
    assert seen.value == pairs.count()


def test_checkpoints_kept(spark, pairs, ids, tmp_path):
    training.train(pairs, ids, replace(OPTIONS, mode="fullbatch", iterations=5, checkpoint_every=2), f"{tmp_path}/a")
    assert Checkpoints(spark, f"{tmp_path}/a").list() == [0, 2, 4, 5]


def test_pair_weight(spark):
    row = spark.range(1).select(*[vec.pair_weight(vec.F.lit(x), 10.0, 0.75) for x in (10.0, 20.0, 1.0)]).first()
    assert list(row) == [1.0, 1.0, pytest.approx(0.177828, abs=1e-6)]


def vectors(spark, rows):
    return spark.createDataFrame([(k + 1, w, v) for k, (w, v) in enumerate(rows)], "id int, word string, v array<double>")


def test_neighbors_and_analogy(spark):
    units = wv.normalized(vectors(spark, [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])]))
    assert [r.word for r in wv.neighbors_of(units, ["a"]).orderBy("rank").collect()] == ["b", "c"]
    with pytest.raises(wv.UnknownTerm):
        wv.neighbors_of(units, ["nope"])
    units = wv.normalized(vectors(spark, [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [2.0, 0.0]), ("d", [2.0, 1.0]), ("e", [-1.0, 0.0])]))
    assert wv.analogy_of(units, ["a", "b", "c"], 1).first().word == "d"
    with pytest.raises(ValueError):
        wv.analogy_of(units, ["a", "b"])


def test_best_by_blocks_equals_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    m = rng.integers(-2, 3, (90, 5)).astype(float)
    units = wv.normalized(vectors(spark, [(f"w{k}", v.tolist()) for k, v in enumerate(m)])).repartition(3)
    monkeypatch.setattr(wv, "SCORED", 200)
    monkeypatch.setattr(wv, "QUERY_BYTES", 200)
    monkeypatch.setattr(wv, "UNIT_BYTES", 900)
    got = {}
    for r in wv.neighbors(units, spark.range(1, 91, 4).select(vec.F.col("id").cast("int").alias("query")), 7).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.word))
    norm = np.linalg.norm(m, axis=1)
    for q in range(1, 91, 4):
        if norm[q - 1]:
            s = [(-round(float(m[q - 1] @ m[i] / norm[q - 1] / norm[i]), 12), i + 1) for i in range(90) if i != q - 1 and norm[i]]
            assert sorted(got[q]) == [(n + 1, i, f"w{i - 1}") for n, (_, i) in enumerate(sorted(s)[:7])]
    empty = wv.best(units, units.where("id < 0").select(vec.F.col("id").alias("query"), vec.F.col("v").alias("qv"), vec.F.array("id").alias("skip")), 3)
    assert empty.count() == 0


def test_lookup_falls_back_to_the_unknown_vector(spark):
    v = vectors(spark, [("a", [1.0]), ("b", [2.0])])
    asked = spark.createDataFrame([("a", 1), ("zz", 2), (None, 3)], "word string, n int")
    assert sorted((r.n, r.v) for r in wv.looked_up(v, asked, wv.unknown_vector(v)).collect()) == [(1, [1.0]), (2, [1.5]), (3, [1.5])]


def test_unknown_vector(spark):
    assert wv.unknown_vector(vectors(spark, [("a", [1.0]), ("b", [2.0]), ("c", [6.0])])).first().v == [3.0]
    many = vectors(spark, [(str(k), [float(k)]) for k in range(150)])
    assert wv.unknown_vector(many).first().v == [pytest.approx(sum(range(50, 150)) / 100)]


def test_questions_seen_and_total(spark):
    v = vectors(spark, [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [2.0, 0.0]), ("d", [2.0, 1.0])])
    q = spark.createDataFrame([("x", 0, "a", "b", "c", "d"), ("x", 1, "a", "b", "c", "nope"), ("y", 2, "n", "b", "c", "d")], "category string, seq long, a string, b string, c string, d string")
    known = wv.known_questions(q, v)
    assert {r.category: (r.total, r.seen) for r in wv.coverage(q, known).collect()} == {"x": (2, 1), "y": (1, 0)}
    answers = wv.predicted(wv.normalized(v), known)
    assert [r.correct for r in answers.collect()] == [True]
    assert {(r.level, r.name): r.accuracy for r in wv.accuracy(answers, answers["category"] == "x").collect()}["all", "all"] == 100.0


def test_binary_files(spark, pairs, ids, tmp_path):
    binary.register(spark)
    pairs.write.format("pair_records").mode("append").save(f"file://{tmp_path}/p")
    back = spark.read.format("pair_records").load(f"file://{tmp_path}/p")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.collect()))
    params = training.initial(ids, OPTIONS)
    binary.write_parameters(params.repartition(3), f"file://{tmp_path}/parts")
    parts = spark.read.format("parameter_file").option("size", 3).load(f"file://{tmp_path}/parts")
    assert sorted((r.side, r.id, tuple(r.v), r.b) for r in parts.collect()) == [x[:4] for x in values(params)]
    binary.joined(f"file://{tmp_path}/parts", f"file://{tmp_path}/params.bin")
    data = (tmp_path / "params.bin").read_bytes()
    assert len(data) == 8 * 2 * 12 * 4
    read = spark.read.format("parameter_file").option("size", 3).load(f"file://{tmp_path}/params.bin")
    assert sorted((r.side, r.id, tuple(r.v), r.b) for r in read.collect()) == [x[:4] for x in values(params)]
    first = params.where("side = 'w' and id = 1").first()
    assert struct.unpack("=4d", data[:32]) == (*first.v, first.b)


def test_text_files(spark, tmp_path):
    v = vectors(spark, [("a", [1.0, -0.5]), ("b", [math.pi, 0.0])])
    text.write_vectors(text.vector_lines(v, wv.unknown_vector(v), header=True), f"{tmp_path}/v")
    lines = [r.value for r in spark.read.text(f"{tmp_path}/v").collect()]
    assert lines == ["2 2", "a 1.000000 -0.500000", "b 3.141593 0.000000", "<unk> 2.070796 -0.250000"]
    assert sorted(r.word for r in text.read_vectors(spark, f"{tmp_path}/v").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="remove <unk>"):
        text.vector_lines(vectors(spark, [("<unk>", [1.0])])).collect()
    vocab = spark.createDataFrame([(1, "b", 3), (2, "a", 1)], "id int, word string, n long")
    assert text.refuse_repeated(vocab) is vocab
    with pytest.raises(ValueError):
        text.refuse_repeated(vocab.unionByName(vocab))
    params = spark.createDataFrame([(s, i, [0.0], 0.0, [i + 0.5], i + 0.25) for s in "wc" for i in (1, 2)], training.PARAMS)
    assert sorted(r.value for r in text.accumulator_lines(params, vocab).collect()) == ["a 2.500000 2.250000 2.500000 2.250000", "b 1.500000 1.250000 1.500000 1.250000"]
    text.write_vocab(vocab, f"{tmp_path}/w")
    assert [tuple(r) for r in text.read_vocab(spark, f"{tmp_path}/w").orderBy("id").collect()] == [(1, "b", 3), (2, "a", 1)]
    (tmp_path / "family.txt").write_text("boy girl brother sister\n")
    assert tuple(text.read_questions(spark, f"{tmp_path}/family.txt").first())[2:] == ("boy", "girl", "brother", "sister")
