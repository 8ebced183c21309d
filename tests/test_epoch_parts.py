"""Parts and updates of stratified epochs."""

from dataclasses import replace

import numpy as np

from wordloom.config import TrainOptions
from wordloom.plans import training


def test_parts_grow_with_records_and_two_is_the_least(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(training, "CELL_RECORDS", 40)
    pairs = spark.createDataFrame([(i, j, 1.0 + (i * j) % 7) for i in range(1, 31) for j in range(1, 31)], "word1 int, word2 int, val double")
    used = []
    whole = training.sub_epoch
    monkeypatch.setattr(training, "sub_epoch", lambda *a: (used.append(a[4]), whole(*a))[1])
    options = TrainOptions(vector_size=3, iterations=1, x_max=10.0, blocks=2)
    training.train(pairs, spark.range(1, 31).selectExpr("cast(id as int) as id"), options, f"{tmp_path}/a")
    assert used == [5] * 5  # 900 records; two parts would make cells of 225
    monkeypatch.setattr(training, "CELL_RECORDS", 500_000)
    used.clear()
    training.train(pairs, spark.range(1, 31).selectExpr("cast(id as int) as id"), replace(options, blocks=3), f"{tmp_path}/b")
    assert used == [3] * 3


def test_updates_of_repeated_rows_add_up_as_row_by_row():
    rng = np.random.default_rng(5)
    side = lambda n: [rng.normal(size=(n, 4)), rng.normal(size=n), 1 + rng.random((n, 4)), 1 + rng.random(n)]
    w, c = side(3), side(5)
    i, j, x = rng.integers(0, 3, 40), rng.integers(0, 5, 40), rng.uniform(0.5, 20, 40)
    options = TrainOptions(vector_size=4, x_max=10.0)
    mine = [[m.copy() for m in s] for s in (w, c)]
    training.run_records(*mine, i, j, x, options, 40)
    plain = [[m.copy() for m in s] for s in (w, c)]
    for a, b, v in zip(i, j, x, strict=True):
        diff = w[0][a] @ c[0][b] + w[1][a] + c[1][b] - np.log(v)
        fd = min(1.0, (v / 10.0) ** 0.75) * diff
        for new, old, at, other in ((plain[0], w, a, c[0][b]), (plain[1], c, b, w[0][a])):
            t = np.clip(fd * other, -100, 100) * options.eta
            new[0][at] -= t / np.sqrt(old[2][at])
            new[1][at] -= fd / np.sqrt(old[3][at])
            new[2][at] += t * t
            new[3][at] += fd * fd
    assert all(np.allclose(p, q) for s, r in zip(mine, plain, strict=True) for p, q in zip(s, r, strict=True))
