"""Sources, sinks and places by ranges."""

import io
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.config import CooccurOptions
from wordloom.operators import cooccur, places, vocab
from wordloom.operators import vectors as wv
from wordloom.sources import binary, onefile, ranges, text


def words_by_line(data):
    return [(k, w) for k, line in enumerate(data.replace(b"\r", b"").split(b"\n")) for w in re.split(rb"[ \t]+", line) if w]


def cut(data, step):
    return [(a, min(a + step, len(data))) for a in range(0, len(data), step)]


def test_ranges_own_each_token_and_line_once(monkeypatch):
    rng = random.Random(5)
    letters = [b"a", b"b", b" ", b" ", b"\n", b"\t", b"\r", "é".encode(), "日".encode()]
    for _ in range(1500):
        monkeypatch.setattr(ranges, "PIECE_BYTES", rng.choice([3, 10, 1000]))
        data, step = b"".join(rng.choice(letters) for _ in range(rng.randint(0, 60))), rng.randint(1, 20)
        got, before, firsts = [], 0, []
        for a, b in cut(data, step):
            for k, line in enumerate(ranges.owned_tokens(io.BytesIO(data), a, b).split(b"\n")):
                got += [(before + k, w) for piece in ranges.pieces_of(line) for w in re.split(rb"[ \t]+", piece.replace(b"\r", b"")) if w]
            firsts.append(before)
            before += data[a:b].count(b"\n")
        assert got == words_by_line(data)
        lines = data.decode().split("\n")
        numbered = list(enumerate(lines[:-1] if lines[-1] == "" else lines, 1))
        monkeypatch.setattr(ranges, "_open", lambda path, data=data: io.BytesIO(data))
        monkeypatch.setattr(ranges, "_ranges", lambda path, s, data=data, step=step: [ranges._Range(0, "x", k, a, b) for k, (a, b) in enumerate(cut(data, step))])
        reader = ranges._LineReader("x", step, firsts)
        assert [x for r in reader.partitions() if r.path for x in reader.rows(r)] == numbered
        reader.least, reader.most = rng.randint(1, 8), rng.randint(1, 8)
        assert [x for r in reader.partitions() if r.path for x in reader.rows(r) if reader.least <= x[0] <= reader.most] == [x for x in numbered if reader.least <= x[0] <= reader.most]


def test_a_token_longer_than_many_ranges_is_read_once():
    data = b"a " + b"x" * 5000 + b" b"
    got = [ranges.owned_tokens(io.BytesIO(data), a, b) for a, b in cut(data, 100)]
    kept = b"".join(got).split()
    assert [w[:999] for w in kept] == [b"a", b"x" * 999, b"b"] and max(map(len, got)) < 1200 + 4096


@pytest.fixture(scope="module")
def one_line(tmp_path_factory):
    rng = random.Random(8)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(40_000)]
    path = tmp_path_factory.mktemp("corpus") / "one.txt"
    path.write_text(" ".join(words))
    return path, words


def test_one_long_line(spark, one_line):
    path, words = one_line
    pieces = ranges.read_pieces(spark, str(path), range_bytes=5000)
    assert {r.line for r in pieces.select("line").distinct().collect()} == {0}
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() >= 12
    counts = vocab.word_counts(pieces)
    assert {r.word: r.n for r in counts.collect()} == Counter(words)
    v = vocab.ranked(counts.where("n > 1200"))
    ids = {r.word: r.id for r in v.collect()}
    expected = list(enumerate(ids[w] for w in words if w in ids))
    found = cooccur.encoded_pieces(pieces, v)
    assert sorted((r.pos, r.id) for r in found.collect()) == expected
    plain = cooccur.encoded(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), v)
    options = CooccurOptions(window_size=4)
    rows = lambda d: sorted(map(tuple, cooccur.cooccurrence(d, options).collect()))
    assert rows(found) == rows(plain)


def test_ranges_grow_with_the_corpus(spark, one_line):
    path, words = one_line
    pieces = ranges.read_pieces(spark, str(path), range_bytes=10)
    assert pieces.rdd.getNumPartitions() <= ranges.CORE_RANGES * spark.sparkContext.defaultParallelism + 1
    assert {r.word: r.n for r in vocab.word_counts(pieces).collect()} == Counter(words)
    assert ranges.grown(1 << 20, 8 << 20, 12) == 1 << 20
    assert ranges.grown(1 << 20, 10 << 30, 12) == ranges.RANGE_BYTES
    assert ranges.grown(64 << 20, 10 << 30, 12) == 64 << 20


def test_pieces_are_encoded_without_a_row_for_each_token(spark, one_line, monkeypatch):
    path, words = one_line
    pieces = ranges.read_pieces(spark, str(path), range_bytes=5000)
    v = vocab.ranked(vocab.word_counts(pieces))
    tables, written = {}, cooccur.written
    monkeypatch.setattr(cooccur, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    assert cooccur.encoded_pieces(pieces, v).count() == len(words)
    assert sum(t.count() for t in tables.values()) < len(words) / 100


@pytest.mark.parametrize("sent", [cooccur.SENT_BYTES, -1])
def test_odd_words_of_pieces(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(cooccur, "SENT_BYTES", sent)
    monkeypatch.setattr(cooccur, "LOOKUP_BYTES", 2000)  # several lookups in a task
    rng = random.Random(3)
    long = "é" * 700  # 499 characters are kept
    some = ["a", "b", "é", "日本", "a\rb", "\r", "\u00a0", "a\u3000b", "zz", long, "x" + long, "y" * 999, "y" * 1005]
    for name in ("1.txt", "2.txt"):
        lines = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\t", " \t "]) for _ in range(rng.choice([0, 3, 40]))) for _ in range(30)]
        (tmp_path / name).write_bytes("\n".join(lines).encode())
    keep = lambda w: w.replace("\r", "").encode()[:999].decode("utf-8", "ignore")
    known = {w: k for k, w in enumerate(dict.fromkeys(keep(w) for w in some if keep(w) and w != "zz"), 1)}
    v = spark.createDataFrame([(k * 3, w) for w, k in known.items()] + [(1, "")], "id int, word string")
    found = cooccur.encoded_pieces(ranges.read_pieces(spark, str(tmp_path), range_bytes=3000), v)
    expected = []
    for row, name in enumerate(("1.txt", "2.txt")):
        for line, text in enumerate((tmp_path / name).read_bytes().decode().split("\n")):
            ids = [known[keep(w)] * 3 for w in re.split("[ \t]+", text.replace("\r", "")) if keep(w) in known]
            expected += [(row, line, pos, k) for pos, k in enumerate(ids)]
    assert sorted(map(tuple, found.collect())) == expected
    assert found.schema.simpleString() == "struct<row:bigint,line:bigint,pos:bigint,id:int>"


@pytest.fixture
def spread_out(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_line_is_numbered_by_many_tasks(spark, monkeypatch, spread_out):
    monkeypatch.setattr(cooccur, "LONG", 1000)
    words = [f"w{k % 7}" for k in range(25_300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2 zz w3"), (None, None), (3, "zz " * 1500 + "w1\nw2 " + "zz w5 " * 700)], "doc_id long, text string").repartition(3)
    v = spark.createDataFrame([(k + 1, f"w{k}") for k in range(6)], "id int, word string")
    found = cooccur.encoded(docs, v)
    got = {}
    for r in found.collect():
        got.setdefault((r.doc_id, r.line), []).append((r.pos, r.id))
    order = lambda ids: list(enumerate(ids))
    expected = {(1, 0): order([int(w[1]) + 1 for w in words if w != "w6"]), (2, 0): order([2, 3, 4]), (3, 0): order([2]), (3, 1): order([3] + [6] * 700)}
    assert {k: sorted(x) for k, x in got.items()} == expected
    # No task numbered much more than a block of the line.
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(shares) < 0.6 * sum(shares)


def test_words_that_begin_alike_are_ranked_by_many_tasks(spark, spread_out):
    n = 200_000
    counts = spark.range(n).select(F.concat(F.lit("http"), F.col("id").cast("string")).alias("word"), F.lit(1).cast("long").alias("n"))
    dealt = places.by_range(counts, [F.desc("n"), "word"])
    shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(shares) >= 3 and max(shares) < 2 * sorted(shares)[len(shares) // 2]
    ranked = vocab.ranked(counts)
    top = sorted(f"http{k}" for k in range(n))
    got = {r.word: r.id for r in ranked.where(F.col("id") % 997 == 1).collect()}
    assert got == {top[k - 1]: k for k in range(1, n + 1, 997)}
    assert ranked.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (1, n, n)


def test_running_sums(spark):
    rows = [(k, (k * 7) % 5) for k in range(500)]
    random.Random(1).shuffle(rows)
    got = places.running(spark.createDataFrame(rows, "k long, size long"), ["k"], "size", "before").collect()
    upto = 0
    for r in sorted(got):
        assert r.before == upto
        upto += r.size
    assert places.running(spark.createDataFrame([], "k long, size long"), ["k"], "size", "before").count() == 0


def test_vocabulary_files_are_read_and_written_by_many_tasks(spark, tmp_path, monkeypatch):
    v = spark.range(1, 5001).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("wörd"), F.col("id")).alias("word"), (9000 - F.col("id")).alias("n")).repartition(3)
    text.write_vocab(v, f"{tmp_path}/vocab.txt")
    assert (tmp_path / "vocab.txt").read_text() == "".join(f"wörd{k} {9000 - k}\n" for k in range(1, 5001))
    lines = ranges.read_lines(spark, f"{tmp_path}/vocab.txt", range_bytes=1000)
    assert lines.rdd.getNumPartitions() > 60
    some = lines.where("id between 2000 and 2003")
    assert [r.value for r in some.orderBy("id").collect()] == [f"wörd{k} {9000 - k}" for k in range(2000, 2004)]
    assert some.rdd.getNumPartitions() <= 3
    assert sorted(map(tuple, text.read_vocab(spark, f"{tmp_path}/vocab.txt").collect())) == sorted(map(tuple, v.select("id", "word", "n").collect()))
    (tmp_path / "twice.txt").write_text("a 3\nb 2\na 1")
    with pytest.raises(ValueError, match="more than once"):
        text.read_vocab(spark, f"{tmp_path}/twice.txt")
    (tmp_path / "none.txt").write_text("")
    assert text.read_vocab(spark, f"{tmp_path}/none.txt").count() == 0
    monkeypatch.setattr(onefile, "CHUNK_BYTES", 100)
    onefile.write_lines(v, [F.desc("id")], "word", f"{tmp_path}/sub/again.txt")
    assert (tmp_path / "sub" / "again.txt").read_text() == "".join(f"wörd{k}\n" for k in range(5000, 0, -1))
    assert onefile.write_lines(v.where("id < 0"), ["id"], "word", f"{tmp_path}/sub/again.txt") == 0 == (tmp_path / "sub" / "again.txt").stat().st_size
    assert sorted(p.name for p in (tmp_path / "sub").iterdir()) == ["again.txt"]
    with pytest.raises(ValueError, match="mounted"):
        onefile.write_lines(v, ["id"], "word", "s3://bucket/file")


def test_pair_and_parameter_files(spark, tmp_path):
    pairs = spark.createDataFrame([(i, j, i / j) for i in range(1, 40) for j in range(1, 30)], "word1 int, word2 int, val double").repartition(5)
    binary.write_pair_file(pairs, f"{tmp_path}/pairs.bin")
    records = list(struct.iter_unpack("=iid", (tmp_path / "pairs.bin").read_bytes()))
    assert records == sorted(map(tuple, pairs.collect()))
    words = spark.createDataFrame([(k, f"w{k}") for k in range(1, 31)], "id int, word string")
    params = spark.createDataFrame([(s, i, [i + 0.5, float(-i), i * i / 7], 9.0 + i, [1.0] * 3, 1.0) for s in "cw" for i in range(1, 31)], "side string, id int, v array<double>, b double, g array<double>, gb double")
    binary.write_parameter_file(params, f"{tmp_path}/params.bin")
    matrix = np.fromfile(tmp_path / "params.bin").reshape(60, 4)
    assert matrix[:, 3].tolist() == [9.0 + i for i in range(1, 31)] * 2
    got = binary.read_summed(spark, f"{tmp_path}/params.bin", words)
    expected = {r.id: (r.word, r.v) for r in wv.exported(params, words, 2).collect()}
    assert {r.id: (r.word, r.v) for r in got.collect()} == expected
    with pytest.raises(Exception, match="two sides"):
        binary.read_summed(spark, f"{tmp_path}/params.bin", words.where("id <= 29")).collect()
