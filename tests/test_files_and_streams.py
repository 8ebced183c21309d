"""Steps over files, the command line, streams, and training by cells."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom import cli
from wordloom.config import SaveOptions, TrainOptions
from wordloom.plans import cells, files, training
from wordloom.plans.checkpoint import Checkpoints
from wordloom.streaming.vocab import Counts, count_to_table, latest


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Words of two topics, and questions about them."""
    rng = random.Random(3)
    folder = tmp_path_factory.mktemp("files")
    lines = [" ".join(rng.choice("abcd" if k % 2 else "wxyz") for _ in range(rng.randint(3, 60))) for k in range(200)]
    (folder / "corpus.txt").write_text("\n".join(lines) + "\n")
    (folder / "questions").mkdir()
    (folder / "questions" / "family.txt").write_text("a b c d\nw x y z\na b nope d\n")
    (folder / "questions" / "gram1-x.txt").write_text("b a d c\n")
    return folder, lines


def test_command_line_from_text_to_accuracy(spark, corpus, capsys):
    folder, lines = corpus
    run = lambda *args: (cli.main([str(a) for a in args], spark), capsys.readouterr().out)[1]
    v, p, s, out = (folder / name for name in ("vocab.txt", "pairs.bin", "shuffled.bin", "vectors"))
    run("vocab-count", "--corpus", folder / "corpus.txt", "--vocab-file", v, "--min-count", 2)
    counts = Counter(w for line in lines for w in line.split())
    assert v.read_text().splitlines() == [f"{w} {n}" for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    run("cooccur", "--corpus", folder / "corpus.txt", "--vocab-file", v, "--pair-file", p, "--window-size", 3)
    run("shuffle", "--pair-file", p, "--shuffled-file", s, "--seed", 4)
    data = lambda path: np.fromfile(path, [("a", "i4"), ("b", "i4"), ("x", "f8")])
    assert (np.diff(data(p)["a"]) >= 0).all() and not (np.diff(data(s)["a"]) >= 0).all()
    assert sorted(map(tuple, data(p).tolist())) == sorted(map(tuple, data(s).tolist()))
    costs = run("train", "--pair-file", s, "--vocab-file", v, "--save-file", out, "--vector-size", 4, "--iterations", 4, "--x-max", 10, "--binary", 2, "--gradsq", 1, "--initial", 1, "--checkpoint-every", 2, "--header", 1).splitlines()
    values = [float(line.split("\t")[1]) for line in costs[1:]]
    assert costs[0] == "iteration\tcost" and len(values) == 4 and values == sorted(values, reverse=True)
    names = {f.name for f in folder.iterdir()}
    assert {"vectors.txt", "vectors.bin", "vectors.gradsq.txt", "vectors.gradsq.bin", "vectors.000.bin", "vectors.002.bin", "vectors.004.bin", "vectors.000.txt"} <= names
    text = (folder / "vectors.txt").read_text().splitlines()
    assert text[0] == "8 4" and [t.split()[0] for t in text[1:]] == [*(x.split()[0] for x in v.read_text().splitlines()), "<unk>"]
    whole = np.fromfile(folder / "vectors.bin").reshape(2, 8, 5)
    assert np.allclose([[float(x) for x in t.split()[1:]] for t in text[1:9]], whole.sum(axis=0)[:, :4], atol=1e-6)
    reports = [run("evaluate", "--vocab-file", v, "--vectors-file", folder / f"vectors.{kind}", "--questions", folder / "questions") for kind in ("txt", "bin")]
    rows = [dict((tuple(line.split("\t")[:2]), line.split("\t")[2]) for line in r.splitlines()[1:]) for r in reports]
    assert rows[0] == rows[1] == {("all", "all"): "3", ("category", "family"): "2", ("category", "gram1-x"): "1", ("kind", "semantic"): "2", ("kind", "syntactic"): "1"}
    # Going on from saved files is going on from memory.
    two = files.fit(spark, str(s), str(v), str(folder / "again"), TrainOptions(vector_size=4, iterations=2, x_max=10.0), SaveOptions(binary=1, gradsq=True))
    assert two.count() == 2 and (folder / "again.bin").read_bytes() == (folder / "vectors.002.bin").read_bytes()
    start = files.given_start(spark, 4, str(folder / "again.bin"), str(folder / "again.gradsq.bin"))
    files.fit(spark, str(s), str(v), str(folder / "more"), TrainOptions(vector_size=4, iterations=2, x_max=10.0), SaveOptions(binary=1), start=start)
    assert (folder / "more.bin").read_bytes() == (folder / "vectors.bin").read_bytes()


def test_all_steps_in_one_call(spark, corpus):
    folder, _ = corpus
    costs = files.text_to_vectors(spark, str(folder / "corpus.txt"), str(folder / "whole"), train=TrainOptions(vector_size=3, iterations=2, x_max=10.0))
    assert costs.count() == 2 and len((folder / "whole.txt").read_text().splitlines()) == 9
    with pytest.raises(ValueError):
        SaveOptions(binary=3)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["train", "--vector-size", "x"])


def test_stream_restarts_and_compacts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    parts = [["a b a", None, "c\nd"], ["a", "e e"], ["b", ""], ["z a"]]
    kept, seen = Counts(spark, out), Counter()
    assert latest(spark, out).count() == 0
    for k, texts in enumerate(parts):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(f"{source}/part={k}")
        count_to_table(spark.readStream.schema("text string").parquet(f"{source}/part=*"), out, f"{tmp_path}/checkpoint").awaitTermination()
        seen.update(w for t in texts for w in (t or "").split())
        if k % 2:
            kept.compact()
            kept.compact()
        assert {r.word: r.n for r in latest(spark, out).collect()} == seen
    assert kept.done("base") == [1, 3] and kept.done("changes") == [2, 3]
    # A batch without its mark isn't whole.
    spark.createDataFrame([("a", 99)], "word string, n long").write.parquet(f"{out}/changes/{9:09d}")
    assert {r.word: r.n for r in latest(spark, out).collect()} == seen
    # Run again, it takes its own place.
    kept.add(spark.createDataFrame([("z", 1)], "word string, n long"), 3)
    assert {r.word: r.n for r in latest(spark, out).collect()} == seen


def zipf_records(spark, n=300):
    rng = random.Random(2)
    pairs = {(min(n, int(rng.paretovariate(0.7))), min(n, int(rng.paretovariate(0.7)))) for _ in range(9000)}
    pairs |= {(1, k) for k in range(1, n + 1)} | {(k, 1) for k in range(1, n + 1)} | {(2, k) for k in range(1, n + 1)}
    return spark.createDataFrame([(i, j, float(1 + (i * j) % 9)) for i, j in sorted(pairs)], "word1 int, word2 int, val double")


def test_parts_are_of_like_weight(spark, tmp_path):
    records = zipf_records(spark)
    kept = Checkpoints(spark, f"{tmp_path}/a")
    laid, heavy, options = training._stratified_tables(records.withColumn("k", F.lit(0)), records.count(), TrainOptions(blocks=4), kept)
    sizes = [r["count"] for r in spark.read.parquet(laid).groupBy("s", "p").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == records.count()
    hashed = records.groupBy(cells.hashed("word1", 4), cells.hashed("word2", 4)).count().toPandas()["count"]
    assert max(sizes) < 1.5 * sum(sizes) / 16 and max(sizes) <= hashed.max()


def test_epochs_shuffle_nothing(spark, tmp_path):
    records = zipf_records(spark, 60)
    ids = spark.range(1, 61).select("id")
    seen = []
    plain = cells.sub_epoch

    def watched(*args):
        found = plain(*args)
        seen.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    training.sub_epoch = watched
    try:
        training.train(records, ids, TrainOptions(vector_size=3, iterations=2, x_max=10.0, blocks=3), f"{tmp_path}/a")
    finally:
        training.sub_epoch = plain
    assert len(seen) == 6 and not any("Exchange" in p for p in seen)


def test_stratified_equals_the_kernel_in_the_cells_order(spark, tmp_path):
    """One part: the run is run_records over all records in their order."""
    records, ids = zipf_records(spark, 40), spark.range(1, 41).select("id")
    options = TrainOptions(vector_size=3, iterations=1, x_max=10.0, blocks=1, batch=16)
    got = {(r.side, r.id): (r.v, r.b, r.g, r.gb) for r in training.train(records, ids, options, f"{tmp_path}/a").collect()}
    start = {(r.side, r.id): r for r in training.initial(ids, options).collect()}
    arrays = {s: [np.array([start[s, i].v for i in range(1, 41)]), np.array([start[s, i].b for i in range(1, 41)]), np.ones((40, 3)), np.ones(40)] for s in "wc"}
    rows = records.withColumn("k", training._order(0)).orderBy("k", "word1", "word2").collect()
    i, j, x = (np.array([r[c] for r in rows]) for c in ("word1", "word2", "val"))
    training.run_records(arrays["w"], arrays["c"], i - 1, j - 1, x, options, options.batch)
    for (side, n), (v, b, g, gb) in got.items():
        own = [m[n - 1] for m in arrays[side]]
        assert np.allclose(own[0], v, atol=1e-12) and np.allclose(own[2], g, atol=1e-12) and abs(own[1] - b) < 1e-12 and abs(own[3] - gb) < 1e-12


def test_block_sums_add_up_whatever_the_blocks(spark, monkeypatch):
    records, ids = zipf_records(spark, 50), spark.range(1, 60).select("id")
    bad = records.unionByName(spark.createDataFrame([(0, 1, 1.0), (1, 2, float("inf")), (900, 1, 2.0), (3, 3, -1.0)], records.schema))
    options = TrainOptions(vector_size=3, x_max=10.0, grad_clip=0.05)
    params = training.initial(ids, options)
    one = {(r.side, r.id): r for r in training.fullbatch_step(bad, params, options).collect()}
    monkeypatch.setattr(cells, "SUM_RECORDS", 500)
    monkeypatch.setattr(cells, "SUMMED", 100)
    many = {(r.side, r.id): r for r in training.fullbatch_step(bad, params, options).collect()}
    # By hand.
    w, c = ({r.id: (np.array(r.v), r.b) for r in params.where(F.col("side") == s).collect()} for s in "wc")
    t, fd = {k: np.zeros(3) for k in one}, dict.fromkeys(one, 0.0)
    for r in records.collect():
        d = w[r.word1][0] @ c[r.word2][0] + w[r.word1][1] + c[r.word2][1] - np.log(r.val)
        f = min(1.0, (r.val / 10) ** 0.75) * d
        for k, other in ((("w", r.word1), c[r.word2][0]), (("c", r.word2), w[r.word1][0])):
            t[k] += np.clip(f * other, -0.05, 0.05) * options.eta
            fd[k] += f
    assert set(one) == set(many) and len(one) == 118
    for k, r in one.items():
        start = (w if k[0] == "w" else c)[k[1]]
        assert np.allclose(r.v, start[0] - t[k], atol=1e-9) and np.allclose(many[k].v, r.v, atol=1e-9) and np.allclose(many[k].g, 1 + t[k] ** 2, atol=1e-9)
        assert abs(r.b - (start[1] - fd[k])) < 1e-9 and abs(many[k].gb - (1 + fd[k] ** 2)) < 1e-6
    total = sum(0.5 * min(1.0, (r.val / 10) ** 0.75) * (w[r.word1][0] @ c[r.word2][0] + w[r.word1][1] + c[r.word2][1] - np.log(r.val)) ** 2 for r in records.collect())
    assert training.cost(records, params, options).first().cost == pytest.approx(total / records.count(), rel=1e-9)
