"""Packing, the filter audit and whitening against brute force."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import ODD, frame
from wordloom.llm import filter_audit, packing, whitening
from wordloom.llm.registry import tokenizer_definition

# --- packing ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(tokenizer_definition())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("rows", [[], [(1, None)], ODD, [(9, "same words again " * 40)] * 30])
def test_packing(spark, library, rows, parts):
    docs = frame(spark, rows).repartition(parts) if rows else frame(spark, rows)
    pieces = packing.pack(docs, tokenizer_definition(), end_id=1, window=256)
    got = pieces.collect()
    # Pieces of one document, put together by start, are the library's ids and the end id; every row is one document.
    expected = Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    by_place = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    found, upto = Counter(), 0
    held = b""
    for r in by_place:
        assert r.sequence_id * 256 + r.offset == upto, "gapless"
        assert 0 < r.length <= 256 - r.offset
        assert len(r.ids) == 4 * r.length and r.start == len(held) // 4
        held += r.ids
        upto += r.length
        if len(held) == 4 * r.doc_tokens:
            found[(r.doc_id, held)] += 1
            held = b""
    assert not held and found == expected
    for r in packing.digests(pieces).collect():
        assert r.length > 0
    whole = sorted(packing.sequences(pieces, window=256, pad_id=7).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in whole] == list(range(math.ceil(upto / 256)))
    run = b"".join(r.ids for r in by_place)
    for r in whole:
        own = run[1024 * r.sequence_id : 1024 * (r.sequence_id + 1)]
        full = own if len(own) // 4 & (len(own) // 4 - 1) == 0 else own + np.full(256 - len(own) // 4, 7, "<u4").tobytes()
        assert r.ids == full and r.n_tokens == len(own) // 4
        assert [(d.doc_id, d.start, d.offset, d.length) for d in r.documents] == [(p.doc_id, p.start, p.offset, p.length) for p in by_place if p.sequence_id == r.sequence_id]


def test_packing_digests(spark):
    pieces = packing.pack(frame(spark, ODD), tokenizer_definition(), end_id=1, window=64)
    given = Counter((r.doc_id, r.start, zlib.crc32(r.ids)) for r in pieces.collect())
    assert given == Counter((r.doc_id, r.start, r.ids_crc32) for r in packing.digests(pieces).collect())


def test_places_beyond_a_broadcast_are_joined_by_shuffling(spark, monkeypatch):
    docs = frame(spark, [(k, f"text number {k} " * (k % 7)) for k in range(60)]).repartition(5)
    parts = packing.encoded(docs, tokenizer_definition(), 1)
    one = sorted(map(tuple, packing.cut(parts, 32).collect()))
    monkeypatch.setattr(packing, "SENT_TASKS", 1)
    assert sorted(map(tuple, packing.cut(parts, 32).collect())) == one


# --- filter audit ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", range(1, 6))
def test_swaps_visit_every_order_once(k):
    order = list(range(k))
    seen = {tuple(order)}
    for i in filter_audit.adjacent_swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(k) == 1 + len(list(filter_audit.adjacent_swaps(k)))


def audited(rows, labels):
    """Brute force: rows (id, text, part), labels (id, quality, toxic)."""

    def fails(i, text):
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        out["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)
        return out

    failing = [(part or "", i, fails(i, text)) for i, text, part in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out, shapley = [], Counter()
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[letter]]
                left = [(i, f) for i, f in left if not f[letter]]
                shapley[part, letter] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f[letter] for _, f in own) - len(gone), sum(f[letter] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted([*r, shapley[r[0], r[1][r[2] - 1]]] for r in out)


LONG = " ".join(f"word{k}" for k in range(260))
AUDITED = [
    (1, None, "a"), (2, "", "a"), (None, "", None), (None, None, "b"), (3, "", ""), (4, LONG, "a"), (5, LONG, "b"), (6, LONG + " #", "b"), (7, "word " * 300, "b"), (7, "word " * 300, "b"), (8, "word " * 300, "a"),
    (9, (LONG + " ") .upper(), "c"), (10, "SHORT", None), (11, "x\x0by\x0cz\r\n\t q" * 90, "c"), (12, "日本🎉 é " * 150, "c"), (13, "w " * 60_000, "c"), (4, LONG, "a"), (20, LONG.upper() + "|", "c"), (21, LONG.upper() + "|", "c"),
]
LABELS = [(4, 1, 0), (4, 1, 0), (5, None, 1), (7, 1, 1), (None, 1, 1), (9, 0, 1), (99, 1, 1), (20, 1, None), (13, None, None)]


@pytest.mark.parametrize(("rows", "labels"), [([], []), ([], LABELS), (AUDITED, []), (AUDITED, LABELS), ([(k, "copy " * 200, "s") for k in range(400)], [(k, k % 2, k % 3) for k in range(400)])])
def test_audit(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "z", 0) for r in rows], "doc_id long, text string, source string, mask int, part string, n long").repartition(3)
    named = spark.createDataFrame([(*r, "l") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(list(r) for r in filter_audit.audit(docs, named).collect())
    assert got == audited(rows, labels)


# --- whitening -------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3, "w") for i, v in rows], f"vec_id long, embedding array<{kind}>, n long, whitened string")


def brute(rows, k):
    """(x, n, S, V, eigenvalues falling) of the rows that remain."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = ((n * x - s) / n).astype(float)
    cov = z.T @ z / n
    values = np.linalg.eigvalsh(cov)[::-1]
    return x, n, s, z, cov, values[:k]


def check(spark, all_rows, good, components=32):
    got = whitening.whitened(vectors(spark, all_rows, "double").repartition(3), components).collect()
    x, n, s, z, cov, values = brute(good, components)
    deviation = [sum(int(e) ** 2 for e in row) for row in n * x - s]
    k = len(values)
    assert len(got) == n * k
    assert Counter(r.vec_id for r in got) == Counter({i: k * c for i, c in Counter(i for i, _ in good).items()})
    by = {}
    for r in got:
        assert r.n == n and abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-6
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    assert {d for _, d in by} == {d if d < 1 << 63 else None for d in deviation}
    # Each component is the projection on a unit eigenvector: whitened = z u / sqrt(e), so u solves a least-squares problem exactly.
    w = np.array([[by[i, d if d < 1 << 63 else None][c] for c in range(1, k + 1)] for (i, _), d in zip(good, deviation, strict=True)])
    u = np.linalg.lstsq(z, w, rcond=None)[0] * np.sqrt(values)
    assert np.allclose(z @ u / np.sqrt(values), w, atol=1e-6)
    assert np.allclose(cov @ u, u * values, atol=1e-6 * values[0]) and np.allclose(u.T @ u, np.eye(k), atol=1e-6)
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-6)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(7, 7))
    good = [(k, (rng.normal(size=7) @ mix).tolist()) for k in range(300)]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0]), (902, [1.0] * 6 + [float("nan")]), (903, [float("-inf")] + [1.0] * 6), (904, []), (905, [1.0, 2.0])]
    check(spark, good + bad, good)
    check(spark, good + bad, good, components=3)


def test_whitening_large_entries_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, [float(rng.integers(-(1 << 40), 1 << 40)), float(rng.integers(-(1 << 39), 1 << 39))]) for k in range(50)]
    check(spark, good, good, components=1)
    rows = [(k % 5, [float(k % 5), float((k * k) % 7)]) for k in range(40)]
    got = whitening.whitened(vectors(spark, rows), 2).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter({(i, c): 8 for i in range(5) for c in (1, 2)})
    # Entries that no long holds stay at a bound.
    assert whitening.whitened(vectors(spark, [(1, [3e38]), (2, [-3e38]), (None, [0.0])])).count() == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_whitening_without_variance(spark, rows):
    got = whitening.whitened(vectors(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_whitening_leaves_out_flat_directions(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    got = whitening.whitened(vectors(spark, rows)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_plain_words_are_encoded_as_the_library_does(library):
    import random

    from wordloom.llm.token_files import Encoder, plain_encoder

    rng = random.Random(1)
    letters = [chr(c) for c in range(33, 127)] + list("éßñÀɏΑωЯяぁんァ一龥\n\n   '''×÷\x1ć") + ["'s", "'ll", "\n\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    encoder = Encoder(tokenizer_definition())
    assert encoder.plain is not None
    assert encoder.encode_batch(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    spec = {"model": {"vocab": {"b": 0, "a": 1, "ab": 2}, "merges": ["a b"]}, "pre_tokenizer": {"use_regex": True}}
    assert plain_encoder(spec, {"a": 97, "b": 98}) is None
