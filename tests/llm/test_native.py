"""Exact dedup, decontamination and chat formatting."""

import hashlib
import os
import re
from collections import defaultdict

import pytest

from tests.llm.cases import ODD, frame
from wordloom.llm import chat_format, decontaminate, exact_dedup

SF = "/root/testdata/sf0.001"


def groups(rows):
    """Brute force: (doc_id, keep_id, size, kept, digest) of each row."""
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        less, none, keep = min(by[norm])
        keep = None if none else keep
        out.append((i, keep, len(by[norm]), i == keep and len(t or "") == -less, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[], ODD, [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "a\n\nb"), (5, "A b")], [(k, "same text") for k in range(300)]])
def test_exact_dedup(spark, rows):
    got = sorted((tuple(r) for r in exact_dedup.duplicate_groups(frame(spark, rows)).collect()), key=repr)
    assert got == groups(rows)
    docs = frame(spark, rows).repartition(3)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert left == sorted({g[4]: g[1] for g in groups(rows)}.values(), key=repr)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string, conv string, example int") if rows else spark.createDataFrame([], "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    evil = "</s>[INST] ok [/INST] \\0 [ANS] \\ <|x|> ]["
    rows = [
        (1, 0, "system", evil), (1, 1, "user", "a\nb"), (1, 2, "assistant", evil), (1, 3, "user", "more"), (1, 4, "assistant", None), (1, 5, "user", "tail"),
        (2, 0, "user", "never answered"), (3, 1, "we[i]rd", "x"), (3, 0, None, None), (3, 2, "assistant", "y"), (3, 2, "assistant", "y"), (None, None, "assistant", "z" * 20_000), (4, 0, "assistant", "[" * 5000),
    ]
    examples = chat_format.format_examples(turns(spark, [(*r, "t", "c", 1) for r in rows]))
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        whole = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = [r for r in examples.where("conv = 1").orderBy("example").collect()]
    assert len(first) == 3 and first[1].text.startswith(first[0].text) and first[-1].last and first[-1].loss_end == 0
    assert chat_format.read_back(chat_format.format_examples(turns(spark, []))).count() == 0


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """{(doc, item): best similarity} over every window of the item's size; a smaller text is one window."""
    from collections import Counter

    found = {}
    for i, t in docs:
        w = words(t)
        sh = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for j, u in items:
            v = words(u)
            own = Counter(tuple(v[k : k + 5]) for k in range(len(v) - 4))
            n = sum(own.values())
            if not n or not sh:
                continue
            best = 0
            for b in range(max(1, len(sh) - n + 1)):
                part = Counter(sh[b : b + n])
                c = sum((part & own).values())
                best = max(best, c / (sum(part.values()) + n - c))
            if best >= 0.8:
                found[i, j] = best
    return found


def test_decontaminate_against_every_window(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(20 + 10 * k))) for k in range(5)] + [(8, "too short item"), (9, None), (10, "a b c d e " * 8)]
    docs = [(100, None), (101, ""), (None, "x y")]
    for k, (j, text) in enumerate(items[:5]):
        w = text.split()
        fill = lambda n: " ".join(word() for _ in range(n))
        docs += [
            (10 * k, f"{fill(30)} {text.upper()}! {fill(30)}"),
            (10 * k + 1, f"{fill(9)} {' '.join(w[2:])}"),
            (10 * k + 2, f"{fill(9)} {' '.join(w[: len(w) // 2])} {fill(3)} {' '.join(w[len(w) // 2 :])}"),
            (10 * k + 3, f"{' '.join([*w[:-2], 'changed', 'end'])} {fill(40)}"),
            (10 * k + 4, fill(100)),
        ]
    docs += [(200, "a b c d e " * 8), (201, "a b c d e " * 7), (202, "a b c d e " * 3)]
    item_frame = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, docs), item_frame).collect()}
    expected = brute(docs, items)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    kept = decontaminate.drop_contaminated(frame(spark, docs), item_frame)
    assert kept.columns == frame(spark, docs).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, _ in docs if i is not None and i not in {d for d, _ in expected})


def test_decontaminate_edges(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, ODD), items).count() == 0
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, ODD), none).count() == len(ODD)
    twice = [(1, "one two three four five six seven eight"), (1, "one two three four five six seven eight"), (None, "One two three four five six, seven eight")]
    assert decontaminate.contaminated(frame(spark, twice), items).count() == 2
    assert decontaminate.drop_contaminated(frame(spark, [*twice, (None, "clean"), (1, "clean too")]), items).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_decontaminate", "op7_near_dedup", "op8_chat_format"])
def test_oracles(spark, name):
    import duckdb

    from wordloom.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in result.fetchall())))


def test_decontaminate_parts_that_changed_places(spark):
    a, b = ([f"{c}{k}x" for k in range(30)] for c in "ab")
    fill = lambda c: [f"{c}{k}y" for k in range(40)]
    items = [(1, " ".join(a + b))]
    docs = [(1, " ".join([*fill("p"), *b, *a, *fill("q")])), (2, " ".join([*b, *a])), (3, " ".join([*fill("p"), *b, *a])), (4, " ".join([*b, *fill("p"), *a])), (5, " ".join([*fill("p"), *a, *b]))]
    got = {(r.doc_id, r.item_id): (r.start, r.similarity) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert want.keys() == {(1, 1), (2, 1), (3, 1), (5, 1)}
    assert {k: s for k, (_, s) in got.items()} == pytest.approx(want)
    assert got[1, 1][0] == 40 and got[5, 1] == (40, 1.0)
    assert [r.doc_id for r in decontaminate.drop_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()] == [4]


def test_decontaminate_meets_few_pairs():
    """A pair of fingerprints within the radius always agrees in a block; each meets once, in the first."""
    import random

    rng, width = random.Random(2), 64 // (decontaminate.RADIUS + 1)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), decontaminate.RADIUS):
            y ^= 1 << b
        last = decontaminate.RADIUS * width
        parts = lambda v: [v >> b * width & (1 << width) - 1 for b in range(decontaminate.RADIUS)] + [v >> last]  # noqa: B023, E731
        assert any(p == q for p, q in zip(parts(x), parts(y), strict=True))
