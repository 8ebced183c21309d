import pytest

from wordloom.config import CooccurOptions, VocabOptions
from wordloom.functions.text import tokens
from wordloom.operators import cooccur, vocab


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(spark, text):
    return [r.word for r in tokens(corpus(spark, text)).orderBy("doc_id", "line", "pos").collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a  b\tc", ["a", "b", "c"]),
        ("a\rb", ["ab"]),
        (" \n\n x ", ["x"]),
        ("a\x0bb", ["a\x0bb"]),
        ("", []),
        (None, []),
        ("x" * 1000, ["x" * 999]),
        ("x" * 998 + "é", ["x" * 998]),
        ("x" * 997 + "é", ["x" * 997 + "é"]),
        ("x" * 996 + "日本", ["x" * 996 + "日"]),
    ],
)
def test_tokens(spark, text, expected):
    assert words(spark, text) == expected
    assert sorted(r.word for r in vocab.word_counts(corpus(spark, text)).collect()) == sorted(set(expected))


def test_ranks_and_cuts(spark):
    counts = vocab.word_counts(corpus(spark, "b a b c a b"))
    assert [tuple(r) for r in vocab.ranked(counts).orderBy("id").collect()] == [(1, "b", 3), (2, "a", 2), (3, "c", 1)]
    kept = vocab.limited(counts, VocabOptions(max_vocab=2, min_count=3))
    assert [r.word for r in kept.collect()] == ["b"]
    assert vocab.report(counts, VocabOptions(max_vocab=2, min_count=3)).first().cut_by == "count"
    assert vocab.report(counts, VocabOptions(max_vocab=2)).first().cut_by == "size"
    assert [r.word for r in vocab.ranked(vocab.word_counts(corpus(spark, "b a"))).orderBy("id").collect()] == ["a", "b"]


def test_ranks_of_many_ties(spark):
    import random

    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(2000))
    got = [(r.id, r.word, r.n) for r in vocab.ranked(vocab.word_counts(corpus(spark, text))).orderBy("id").collect()]
    from collections import Counter

    expected = sorted(Counter(text.split()).items(), key=lambda x: (-x[1], x[0].encode()))
    assert got == [(k + 1, w, n) for k, (w, n) in enumerate(expected)]


def test_unknown_word_is_refused(spark):
    with pytest.raises(vocab.UnknownInCorpus):
        vocab.vocabulary(corpus(spark, "a <u\rnk> b"))
    assert vocab.vocabulary(corpus(spark, "a <unk>x")).count() == 2


def pairs(spark, text, words="abc", **options):
    v = spark.createDataFrame([(k + 1, w, 1) for k, w in enumerate(words)], "id int, word string, n long")
    ids = cooccur.encoded(corpus(spark, *([text] if isinstance(text, str) else text)), v)
    return {(r.word1, r.word2): r.val for r in cooccur.cooccurrence(ids, CooccurOptions(**options)).collect()}


def test_cooccurrence(spark):
    half, one = 0.5, 1.0
    assert pairs(spark, "a b c", window_size=2) == {(1, 2): one, (2, 1): one, (2, 3): one, (3, 2): one, (1, 3): half, (3, 1): half}
    assert pairs(spark, "a b c", window_size=2, symmetric=False) == {(1, 2): one, (2, 3): one, (1, 3): half}
    assert set(pairs(spark, "a b c", window_size=2, distance_weighting=False).values()) == {1.0}
    assert (1, 3) not in pairs(spark, "a b c", window_size=1)
    assert pairs(spark, "a x b", window_size=2) == {(1, 2): 1.0, (2, 1): 1.0}
    assert pairs(spark, "a a", window_size=2) == {(1, 1): 2.0}
    assert pairs(spark, "a a", window_size=2, symmetric=False) == {(1, 1): 1.0}
    assert pairs(spark, "a\nb", window_size=2) == {}
    assert pairs(spark, ["a", "b"], window_size=2) == {}
    with pytest.raises(ValueError):
        CooccurOptions(window_size=0)


def test_long_line_over_blocks(spark):
    n = 3 * cooccur.BLOCK + 7
    found = pairs(spark, "a " * n, window_size=3, symmetric=False)
    assert found[1, 1] == pytest.approx((n - 1) + (n - 2) / 2 + (n - 3) / 3)
    assert pairs(spark, "a b " * 700, window_size=40)[1, 2] == pytest.approx(pairs(spark, "a b " * 700, window_size=40)[2, 1])


def test_shuffle_is_a_seeded_permutation(spark):
    p = spark.createDataFrame([(i, j, float(i * j)) for i in range(1, 20) for j in range(1, 20)], "word1 int, word2 int, val double")
    one, two, other = ([tuple(r) for r in cooccur.shuffled(p.repartition(n), s).collect()] for n, s in ((3, 1), (5, 1), (3, 2)))
    assert one == two != other
    assert sorted(one) == sorted(other) == sorted(map(tuple, p.collect()))


def test_rows_with_one_or_no_id_keep_their_lines_apart(spark):
    v = spark.createDataFrame([(k + 1, w, 1) for k, w in enumerate("abcd")], "id int, word string, n long")
    docs = spark.createDataFrame([(7, "a b"), (7, "c d"), (None, "a c"), (None, "b d")], "doc_id long, text string").repartition(3)
    ids = cooccur.encoded(docs, v)
    got = {(r.word1, r.word2): r.val for r in cooccur.cooccurrence(ids, CooccurOptions(window_size=1, symmetric=False)).collect()}
    assert got == {(1, 2): 1.0, (3, 4): 1.0, (1, 3): 1.0, (2, 4): 1.0}
    assert sorted((str(r.doc_id), r.pos) for r in ids.collect()) == [("7", 0), ("7", 0), ("7", 1), ("7", 1), ("None", 0), ("None", 0), ("None", 1), ("None", 1)]
    twice = docs.unionByName(docs)
    assert {r.val for r in cooccur.cooccurrence(cooccur.encoded(twice, v), CooccurOptions(window_size=1, symmetric=False)).collect()} == {2.0}
