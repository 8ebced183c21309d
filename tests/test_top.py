"""What a task of scoring holds and rounds; results as before."""

import numpy as np
import pytest

from wordloom.operators import vectors as wv
from wordloom.sources import binary


@pytest.mark.parametrize("scored", [40, 700, 10**6])
def test_top_takes_ties_by_id_and_rounds_only_what_may_be_best(monkeypatch, scored):
    monkeypatch.setattr(wv, "SCORED", scored)
    rounded, rng = [], np.random.default_rng(2)
    whole = np.round
    monkeypatch.setattr(wv.np, "round", lambda x, *a: (rounded.append(np.size(x)), whole(x, *a))[1])
    vectors, asked = rng.integers(-2, 3, (400, 6)) / 7, rng.integers(-2, 3, (9, 6)) / 3
    ids = rng.permutation(1000)[:400].astype(np.int64)
    skip = [np.array([0, 0, 3]), np.array([ids[5], ids[6], ids[399]])]
    q, i, s = wv._top(asked, skip, ids, vectors, 4)
    for row in range(9):
        hidden = set(skip[1][skip[0] == row])
        best = sorted((-float(whole(asked[row] @ v, 12)), int(n)) for n, v in zip(ids, vectors, strict=True) if n not in hidden)[:4]
        assert [(-float(x), int(ids[n])) for x, n in zip(s[q == row], i[q == row], strict=True)] == best
    assert sum(rounded) < 9 * 400


def test_blocks_of_a_large_table_are_small():
    assert wv.QUERY_BYTES + wv.UNIT_BYTES + 8 * wv.SCORED <= 32 << 20 and binary.HALF_BYTES <= 8 << 20
