"""Near duplicates, language model, pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD, frame
from wordloom.llm import lm_score, near_dedup
from wordloom.llm.components import components

FOLD = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize(("seed", "sent"), [(0, 200_000), (1, 0), (2, 50)])
def test_components(spark, monkeypatch, seed, sent):
    monkeypatch.setattr("wordloom.llm.components.SENT_LINKS", sent)
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 340)] + [(400, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in brute_components([e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_near(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None and sets[i]]
    edges = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = brute_components(edges)
    return {i: (len(s), None if i is None else comp.get(i, i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 100
    for _ in range(12):
        base = [word() for _ in range(rng.randint(10, 150))]
        for _ in range(rng.randint(1, 12)):  # a chain of changes: first and last are often not linked
            rows.append((n, " ".join(base) if rng.random() < 0.8 else "\n".join(base).upper()))
            n += 1
            if rng.random() < 0.7:
                base[rng.randrange(len(base))] = word()
    head = " ".join(word() for _ in range(12))
    rows += [(n + j, f"{head} {' '.join(word() for _ in range(rng.randint(0, 8)))}") for j in range(40)]
    rows += [(i, t) for i, t in ODD if i is not None] + [(None, None)]
    got = near_dedup.near_duplicates(frame(spark, rows), k, num, 100).collect()
    want = expected_near(rows, k, num, 100)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_duplicates(frame(spark, rows), k, num, 100)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i is None or i == c}
    assert near_dedup.near_duplicates(frame(spark, []), k, num, 100).count() == 0


def test_seating():
    """Against seating one by one, in a restaurant whose parent takes the new tables as customers, and in the parent."""
    rng = np.random.default_rng(1)
    n, d, strength = 4000, 0.5, 1.5
    for own in (0.0, 1.0):
        full = lambda x: np.full(n, x)  # noqa: B023, E731
        others = lm_score.Others(full(4.0), full(3.0), full(9.0), strength, d, own)
        got = lm_score.seat(np.full(n, 60), others, rng)
        slow = []
        for _ in range(n):
            t = 1
            for k in range(1, 60):
                weight = (strength + d * (4 + t)) * (3 + own * t) / (9 + own * t)
                t += rng.random() < weight / (k - d * t + weight)
            slow.append(t)
        assert abs(got.mean() - np.mean(slow)) < 0.25 and abs(got.std() - np.std(slow)) < 0.2
    few = lm_score.Others(np.zeros(2), np.array([1.0, 1e-7]), np.ones(2), 1.0, d, 0.0)
    assert lm_score.seat(np.array([1, 10**9]), few, rng)[0] == 1
    weight = lambda t: 10.0 + 0.3 * t
    jumped = [lm_score._jumps(lm_score.STEPWISE + 600, weight, d, 30.0, rng) for _ in range(1500)]
    stepped = []
    for _ in range(1500):
        t = 30.0
        for k in range(lm_score.STEPWISE, lm_score.STEPWISE + 600):
            t += rng.random() < weight(t) / (k - d * t + weight(t))
        stepped.append(t)
    assert abs(np.mean(jumped) - np.mean(stepped)) < 0.3 and abs(np.std(jumped) - np.std(stepped)) < 0.3


def test_a_sweep_leaves_own_tables_out():
    """Of a token that one context alone has, the parent knows nothing while it is seated but what it seats now."""
    cells, counts = np.array([(1 << 20) | 3, (1 << 21) | 3], np.uint64), np.array([2, 2])
    b = lm_score.Bucket(cells, counts, 0)
    tables = np.zeros(lm_score.CLASSES)
    tables[3] = 2
    totals = lm_score.Totals(np.zeros(lm_score.CLASSES), tables, 2.0, 2.0, 2)
    seen, plain = [], lm_score.seat
    lm_score.seat = lambda c, others, rng: (seen.append(others), plain(c, others, rng))[1]
    try:
        b.sweep(totals, 0)
    finally:
        lm_score.seat = plain
    assert seen[0].tables.tolist() == [1, 1] and seen[0].room.tolist() == [lm_score.ROOT_STRENGTH + 1] * 2
    assert seen[0].dish.tolist() == [totals.root_new()] * 2 and seen[1].tables.tolist() == [1, 1]


def test_scores_against_probabilities_cell_by_cell():
    """Model.answer against the predictive rule written out token by token from the same seating."""
    texts = [t.encode() for _, t in lm_rows()]
    keys = [lm_score.token_keys(t) for t in texts]
    cells, counts = np.unique(np.concatenate([lm_score.cells_of(k) for k in keys]), return_counts=True)
    history = []
    for _ in range(lm_score.SWEEPS + 1):
        b = lm_score.Bucket(cells, counts, 0)
        for b in lm_score.seated(cells, counts, 0, history):  # noqa: B020
            pass
        at, x, y = b.sums()
        sums = np.zeros((lm_score.CLASSES + 2, 2))
        sums[at] = np.column_stack([x, y])
        history.append(lm_score.totals_of(sums))
    states = []
    for k, b in enumerate(lm_score.seated(cells, counts, 0, history[:-1])):
        if k >= lm_score.SWEEPS - lm_score.SAMPLES:
            states.append(({int(c): (n, t) for c, n, t in zip(b.cells, b.c, b.t, strict=True)}, {int(h): t for h, t in zip(b.hashes, b.root_t, strict=True)}))
    low = lm_score.CLASSES - 1

    def probability(cell):
        total = 0.0
        for seats, root in states:
            word, context = cell & ~low, cell & low
            at_parent = sum(t for c, (_, t) in seats.items() if c & ~low == word)
            parent_customers, parent_tables = sum(t for _, t in seats.values()), sum(root.values())
            base = 1 / (len(root) + 1)
            parent = (at_parent - lm_score.ROOT_DISCOUNT * root.get(word, 0) + (lm_score.ROOT_STRENGTH + lm_score.ROOT_DISCOUNT * parent_tables) * base) / (lm_score.ROOT_STRENGTH + parent_customers)
            here = [(n, t) for c, (n, t) in seats.items() if c & low == context]
            n, t = seats.get(cell, (0, 0))
            customers, tables = sum(n for n, _ in here), sum(t for _, t in here)
            total += (n - lm_score.DISCOUNT * t + (lm_score.STRENGTH + lm_score.DISCOUNT * tables) * parent) / (lm_score.STRENGTH + customers)
        return math.log10(total / len(states))

    model = lm_score.Model(cells, counts, 0, history)
    wanted = np.unique(np.append(cells[::37], [int(cells[5]) & ~low | 77, (1 << 40) | 9, (1 << 40) | int(cells[0]) & low]).astype(np.uint64))
    logs, _ = model.answer(wanted)
    assert logs == pytest.approx([probability(int(c)) for c in wanted], abs=1e-9)


def lm_rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    rows = []
    for k in range(120):
        w, text = rng.choice(vocabulary), []
        for _ in range(rng.randint(0, 80)):
            text.append(w)
            w = vocabulary[(vocabulary.index(w) * 7 + rng.choice([1, 1, 1, 2])) % 200] if rng.random() < 0.8 else rng.choice(vocabulary)
        rows.append((k, " ".join(text)))
    return rows


def test_lm_scores(spark):
    rows = lm_rows() + [(i if i is None else i + 1000, t) for i, t in ODD]
    got = lm_score.score_texts(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [*WORDS.findall((t or "").translate(FOLD)), "\n"]
    learnt = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1
    c = Counter(w for i, t in rows if learnt(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    first = {}
    for i, t in rows:
        first.setdefault(i, t)
    for r in got:
        if r.doc_id is None:
            continue
        w = tokens(first[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, not learnt(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score_texts(frame(spark, [])).count() == 0


def test_lm_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        cells = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm_score.unpacked_cells(lm_score.packed_cells(cells)) == cells).all()
        logs = rng.random(n).astype("<f4")
        assert (lm_score.unpacked(lm_score.packed(logs), "<f4") == logs).all()


def test_lm_probabilities_sum_to_one():
    texts = [t.encode() for _, t in lm_rows()]
    cells, counts = np.unique(np.concatenate([lm_score.cells_of(lm_score.token_keys(t)) for t in texts]), return_counts=True)
    history = []
    for _ in range(lm_score.SWEEPS + 1):
        b = lm_score.Bucket(cells, counts, 0)
        for b in lm_score.seated(cells, counts, 0, history):  # noqa: B020
            pass
        at, x, y = b.sums()
        sums = np.zeros((lm_score.CLASSES + 2, 2))
        sums[at] = np.column_stack([x, y])
        history.append(lm_score.totals_of(sums))
    model = lm_score.Model(cells, counts, 0, history)
    for context in (0, 5, lm_score.START):
        wanted = np.append(model.hashes, np.uint64(1 << 40)) | np.uint64(context)
        logs, known = model.answer(np.sort(wanted))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-9)
        assert (known > 0).sum() == len(model.hashes)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import toxic_rows
    from wordloom.llm import bpe, toxicity
    from wordloom.llm.registry import tokenizer_definition

    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ne", "pu"]) for _ in range(3))
    item = " ".join(word() for _ in range(30))
    plain = [(k, " ".join(word() for _ in range(60))) for k in range(2000, 2030)]
    w = plain[0][1].split()
    special = [(3000, plain[1][1] + " "), (3001, " ".join([*w[:-1], "other"])), (3002, f"{plain[2][1]} {item} x"), (None, None), (3003, None), (3004, ""), (None, plain[3][1])]
    toxic = toxic_rows(300)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [r[:2] for r in toxic] + plain + special]
    docs = spark.createDataFrame(rows + rows[-2:], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i, _ in plain if i not in (2001,)} <= got.keys() and 3000 in got  # 3000 has more code points than 2001
    assert not got.keys() & {2001, 3001, 3002}
    net = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.in_training())
    bad = {r.doc_id for r in toxicity.score_texts(docs, net).collect() if r.predicted}
    assert len(bad & {i for i, _, y in toxic if y}) > 90 and not bad & got.keys()
    codec = bpe.loaded(tokenizer_definition())
    assert all(codec.decode(np.frombuffer(r.ids, "<u4")) == r.decoded for r in got.values())
    docs_left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_left = stage(spark, docs_left, str(tmp_path))
        assert docs_left.columns == docs.columns


def test_near_dedup_drops_by_row(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, alone, other = (" ".join(word() for _ in range(60)) for _ in range(3))
    near = lambda t: t + " more"
    rows = [(3, base), (7, near(base)), (7, alone), (None, base + " most"), (None, other), (None, near(other)), (None, "")]
    kept = near_dedup.drop_near_duplicates(frame(spark, rows), 5, 80, 100).collect()
    texts = Counter((r.doc_id, r.text) for r in kept)
    assert texts[3, base] == texts[7, alone] == texts[None, ""] == 1
    assert len(kept) == 4 and texts[None, other] + texts[None, near(other)] == 1


@pytest.mark.parametrize("seed", range(4))
def test_joining_links_of_a_chunk(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 55, replace=False), rng.integers(0, 1 << 60, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(40)]
    sets += [rng.integers(0, 1 << 60, 5000).astype(np.uint64)]
    sets += [sets[-1][:4600]]
    both = near_dedup.common_counts([np.unique(x) for x in sets])
    sets = [np.unique(x) for x in sets]
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(len(sets)) for j in range(len(sets)))
    comps = rng.integers(0, 30, len(sets))
    links = near_dedup.joining_links(sets, comps, 80, 100)
    assert all(near_dedup._linked(sets[i], sets[j], 80, 100) and comps[i] != comps[j] for i, j in links) and len(links) < len(sets)
    same = [(i, j) for i in range(len(sets)) for j in range(i) if comps[i] == comps[j]]
    whole = [(i, j) for i in range(len(sets)) for j in range(i) if near_dedup._linked(sets[i], sets[j], 80, 100)]
    assert brute_components(same + links + [(i, i) for i in range(len(sets))]) == brute_components(same + whole + [(i, i) for i in range(len(sets))])


def test_large_buckets_are_dealt_without_loss(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    rows = []
    for k in range(150):  # copies with up to three changed words: many pairs just under the threshold, in the same buckets
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = word()
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "CHUNK_CLASSES", 20)
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows), 3, 85, 100).collect()}
    assert got == expected_near(rows, 3, 85, 100)
