"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A step is a word; its input joins a hashed word embedding with the mean of hashed embeddings of the
word's character trigrams. Every text is scored whole, by all windows of WINDOW words at every
STRIDE-th word; a text's score is that of its worst window. The network is fitted on the driver on
a bounded sample of labelled texts (SAMPLE texts by label, each whole); which window makes a text
toxic is unknown, so of a toxic text only the windows that score highest are taught. Windows overlap by
half, so a passage of STRIDE words lies whole in one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import by_text, chosen, give_back, take_over
from wordloom.llm.license_scan import words_of
from wordloom.llm.shared import text_of

WINDOW, STRIDE = 64, 32
SAMPLE = {1: 1000, 0: 3000}
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 13, 1 << 14, 8, 12, 8, 8
STEPS, BATCH, RATE = 60, 256, 0.01  # a small sample is gone through more often
CACHED_WORDS = 150_000
CHUNK = 2048
THRESHOLD = 0.7
NO_WORD = b" "  # row 0; no word of a text is a space


def char_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of ^word$ one after another, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    h = (data[:-2] * np.uint64(0x9E3779B97F4A7C15) + data[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + data[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(20)
    end = np.cumsum(size)
    inside = np.ones(len(data), bool)
    inside[end - 1] = inside[end - 2] = False  # trigrams that would reach into the next word
    return (h % np.uint64(CHAR_BUCKETS)).astype(np.int64)[inside[:-2]], np.concatenate([[0], np.cumsum(size - 2)[:-1]])


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(w) % WORD_BUCKETS for w in words], np.int64)


def starts_of(n: int) -> np.ndarray:
    """Windows' starts in a text of n words; the last window reaches the end."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def windows_of(rows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of row numbers; 0 where the text has ended."""
    starts = starts_of(len(rows))
    padded = np.zeros(int(starts[-1]) + WINDOW, np.int32)
    padded[: len(rows)] = rows
    return padded[starts[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Parameters; gates are in the order reset, update, candidate; directions forth, back."""

    word: np.ndarray
    char: np.ndarray
    w: np.ndarray  # (2, input, 3 HIDDEN)
    u: np.ndarray  # (2, HIDDEN, 3 HIDDEN)
    b: np.ndarray  # (2, 3 HIDDEN)
    look: np.ndarray  # (2 HIDDEN, ATTENTION)
    ask: np.ndarray  # (ATTENTION,)
    out: np.ndarray  # (2 HIDDEN,)
    bias: np.ndarray  # (1,)

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        r, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        f = lambda *shape, by=0.3: (r.standard_normal(shape) * by).astype(np.float32)
        return cls(f(WORD_BUCKETS, WORD_DIM, by=0.02), f(CHAR_BUCKETS, CHAR_DIM, by=0.02), f(2, d, 3 * HIDDEN), f(2, HIDDEN, 3 * HIDDEN), np.zeros((2, 3 * HIDDEN), np.float32), f(2 * HIDDEN, ATTENTION), f(ATTENTION), f(2 * HIDDEN), np.zeros(1, np.float32))

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """(words, WORD_DIM + CHAR_DIM)"""
        chars, begin = char_buckets(words)
        count = np.diff(np.append(begin, len(chars)))[:, None]
        return np.concatenate([self.word[word_buckets(words)], np.add.reduceat(self.char[chars], begin, axis=0) / count], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs' share of the gates: (words, 2, 3 HIDDEN)"""
        return np.stack([x @ self.w[k] + self.b[k] for k in (0, 1)], axis=1).astype(np.float32)

    def gates(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), 2, 3 * HIDDEN), np.float32)
        for k in range(0, len(words), 20_000):
            out[k : k + 20_000] = self.project(self.inputs(words[k : k + 20_000]))
        return out

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows. gates: projected inputs, row 0 for no word; at: (n, WINDOW) of rows of gates."""
        n, h = len(at), HIDDEN
        real = at > 0
        full = bool(real.all())
        states, saved = np.zeros((WINDOW, n, 2 * h), np.float32), []
        for k in (0, 1):
            s, own, u_rz, u_c = np.zeros((n, h), np.float32), gates[:, k], self.u[k][:, : 2 * h], self.u[k][:, 2 * h :]
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                g = own[at[:, t]]
                rz = _sigmoid(g[:, : 2 * h] + s @ u_rz)
                m = s @ u_c
                c = np.tanh(g[:, 2 * h :] + rz[:, :h] * m)
                new = c + rz[:, h:] * (s - c)
                if not full:
                    new *= real[:, t, None]
                if keep:
                    saved.append((k, t, s, rz, m, c))
                s = new
                states[t, :, k * h : k * h + h] = s
        seen = np.tanh(states @ self.look)
        a = seen @ self.ask
        a = np.where(real.T, a, np.float32(-1e9))
        a = np.exp(a - a.max(axis=0))
        a *= real.T
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logits = pooled @ self.out + self.bias[0]
        return (logits, (states, saved, seen, a, pooled, real)) if keep else logits

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean logistic loss: by parameter, and by input row."""
        h, n = HIDDEN, len(at)
        logits, (states, saved, seen, a, pooled, real) = self.forward(self.project(x), at, keep=True)
        d = ((_sigmoid(logits) - y) / n).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        d_pooled = d[:, None] * self.out
        d_a = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        g["ask"] = np.einsum("tn,tnk->k", d_score, seen)
        d_seen = d_score[:, :, None] * self.ask * (1 - seen**2)
        g["look"] = np.einsum("tnh,tnk->hk", states, d_seen)
        d_states = a[:, :, None] * d_pooled + d_seen @ self.look.T
        g["w"], g["u"], g["b"] = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        d_gates = np.zeros((2, WINDOW, n, 3 * h), np.float32)
        d_s, last = np.zeros((n, h), np.float32), 1
        for k, t, s, rz, m, c in reversed(saved):
            if k != last:
                d_s, last = np.zeros((n, h), np.float32), k
            d_new = (d_s + d_states[t, :, k * h : k * h + h]) * real[:, t, None]
            r, z = rz[:, :h], rz[:, h:]
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (s - c) * z * (1 - z)
            d_r = d_c * m * r * (1 - r)
            d_gates[k, t] = np.concatenate([d_r, d_z, d_c], axis=1)
            d_rec = np.concatenate([d_r, d_z, d_c * r], axis=1)
            g["u"][k] += s.T @ d_rec
            d_s = d_new * z + d_rec @ self.u[k].T
        flat = at.T.ravel()
        for k in (0, 1):
            d_flat = d_gates[k].reshape(-1, 3 * h)
            g["b"][k], g["w"][k] = d_flat.sum(axis=0), x[flat].T @ d_flat
        d_in = sum(d_gates[k].reshape(-1, 3 * h) @ self.w[k].T for k in (0, 1))
        d_x = np.stack([np.bincount(flat, d_in[:, c], len(x)) for c in range(x.shape[1])], axis=1).astype(np.float32)
        return g, d_x


class Adam:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def step(self, name: str, value: np.ndarray, g: np.ndarray, rows: np.ndarray | None = None) -> None:
        """rows: those of value that g is for, each once; only they and their moments change."""
        m, v, n = self.seen.setdefault(name, (np.zeros_like(value), np.zeros_like(value), [0]))
        n[0] += 1
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        value[at] -= self.rate * (m[at] / (1 - 0.9 ** n[0])) / (np.sqrt(v[at] / (1 - 0.999 ** n[0])) + 1e-6)


def fit(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = 5) -> Network:
    net, adam, rng = Network.fresh(seed), Adam(RATE), np.random.default_rng(seed)
    row: dict[bytes, int] = {NO_WORD: 0}
    windows, owner = [], []
    for k, x in enumerate(texts):  # a text's words become numbers at once: the driver holds each distinct word once
        if len(found := np.fromiter((row.setdefault(w, len(row)) for w in words_of(x)), np.int32)):
            windows.append(windows_of(found))
            owner += [k] * len(windows[-1])
    all_words = list(row)
    at, owner, y = np.concatenate(windows), np.array(owner), np.array(labels)
    for epoch in range(max(6, min(100, steps * BATCH * 2 // (3 * len(texts)) + 1))):
        gates = net.gates(all_words)
        logits = np.concatenate([net.forward(gates, at[k : k + CHUNK]) for k in range(0, len(at), CHUNK)])
        # Of each text its worst window (at first two), and other windows of clean texts by chance.
        order = np.lexsort((-logits, owner))
        place = np.empty(len(order), np.int64)
        first = np.concatenate([[True], owner[order][1:] != owner[order][:-1]])
        place[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        toxic = y[owner] == 1
        taken = place < (2 if epoch < 2 else 1)
        spare = ~toxic & ~taken
        picked = np.concatenate([np.flatnonzero(taken), rng.permutation(np.flatnonzero(spare))[: len(texts) // 2]])
        picked = rng.permutation(picked)
        for k in range(0, len(picked), BATCH):
            one = picked[k : k + BATCH]
            rows, local = np.unique(at[one], return_inverse=True)
            local = local.reshape(at[one].shape)
            if rows[0] != 0:
                rows, local = np.append(0, rows), local + 1
            words = [all_words[r] for r in rows]
            x = net.inputs(words)
            g, d_x = net.gradients(x, local, y[owner[one]].astype(np.float32))
            for name, d in g.items():
                adam.step(name, getattr(net, name), d)
            for name, buckets, d in (("word", word_buckets(words), d_x[:, :WORD_DIM]), ("char", *_spread(words, d_x[:, WORD_DIM:]))):
                used, inverse = np.unique(buckets, return_inverse=True)
                total = np.stack([np.bincount(inverse, d[:, c], len(used)) for c in range(d.shape[1])], axis=1).astype(np.float32)
                adam.step(name, getattr(net, name), total, used)
    return net


def _spread(words: list[bytes], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars, begin = char_buckets(words)
    count = np.diff(np.append(begin, len(chars)))
    return chars, np.repeat(d / count[:, None], count, axis=0)


class Scorer:
    """Scores texts; gates of words are kept in a bounded table, row 0 for no word."""

    def __init__(self, net: Network):
        self.net, self.row = net, {}
        self.gates = np.zeros((1024, 2, 3 * HIDDEN), np.float32)

    def _rows(self, words: list[list[bytes]]) -> list[np.ndarray]:
        new = set().union(*words).difference(self.row)
        if len(self.row) + len(new) > CACHED_WORDS:
            self.row.clear()
            new = set().union(*words)
        if new:
            begin, new = len(self.row) + 1, list(new)
            if begin + len(new) > len(self.gates):
                bigger = np.zeros((max(2 * len(self.gates), begin + len(new)), 2, 3 * HIDDEN), np.float32)
                bigger[:begin] = self.gates[:begin]
                self.gates = bigger
            self.gates[begin : begin + len(new)] = self.net.gates(new)
            self.row.update(zip(new, range(begin, begin + len(new)), strict=True))
        got = self.row.__getitem__
        return [np.fromiter(map(got, ws), np.int32, len(ws)) for ws in words]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """From 0 to 1 for each text: its worst window's."""
        words = [words_of(x) for x in texts]
        at = [windows_of(r) for r in self._rows(words)]
        begin = np.cumsum([0, *map(len, at)])[:-1]
        joined = np.concatenate(at)
        full = joined[:, -1] > 0
        logits = np.empty(len(joined), np.float32)
        for part in (np.flatnonzero(full), np.flatnonzero(~full)):  # whole windows need no mask
            for k in range(0, len(part), CHUNK):
                logits[part[k : k + CHUNK]] = self.net.forward(self.gates, joined[part[k : k + CHUNK]])
        return _sigmoid(np.maximum.reduceat(logits, begin).astype(np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, fold, id_col="doc_id", text_col="text", label_col="toxic", sizes=SAMPLE) -> tuple[list[bytes], list[int]]:
    """At most sizes[label] texts of each label, those with the smallest hash of the id among rows where fold holds.

    The ids are chosen first, from the small labels table, so the broadcast is bounded by sizes.
    """
    key = F.xxhash64("id")
    ids = labels.where(fold).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    few = [ids.where(F.col("y") == v).orderBy(key, "id").limit(sizes[v]) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    rows = texts.join(F.broadcast(few[0].union(few[1])), "id").groupBy("id", "y").agg(F.max("text").alias("text")).orderBy(F.xxhash64("id"), "id").collect()
    return [r.text.encode() for r in rows], [r.y for r in rows]


def train(docs: DataFrame, labels: DataFrame, fold, **columns) -> Network | None:
    """None where the sample lacks one of the labels."""
    texts, y = labelled_sample(docs, labels, fold, **columns)
    net = fit(texts, y) if len(set(y)) == 2 else None
    give_back()
    return net


_HELD: list = [None, None]


def _drop_scorer() -> None:
    _HELD[:] = [None, None]


def _scorer(sent) -> Scorer:
    """One scorer for each worker process and model, with its table of words."""
    take_over("toxicity", _drop_scorer)
    if _HELD[0] != sent.id:
        _HELD[:] = [sent.id, Scorer(sent.value)]
    return _HELD[1]


class _Sent:
    """A broadcast network with a name of its own."""

    def __init__(self, spark, net: Network):
        import uuid

        self.id, self.net = uuid.uuid4().hex, spark.sparkContext.broadcast(net)

    @property
    def value(self) -> Network:
        return self.net.value


def score_texts(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out (crc32 of the id as text, mod 3, is 1), score, predicted (score >= THRESHOLD); every row, whole texts.

    Null or empty text, or one without words: the score of a window without words. Without a network
    (no labelled rows of both kinds) every score is 0. A null id counts as the empty id; repeated
    rows give repeated results. Empty table: no rows. Only id and text are read.
    """
    sent = None if net is None else _Sent(docs.sparkSession, net)

    def work(ids, texts):
        for k in range(0, len(ids), 100):
            part = texts[k : k + 100]
            found = np.zeros(len(part)) if sent is None else _scorer(sent).scores(part)
            yield from ((i, chosen(i, 3) == 1, float(s), int(s >= THRESHOLD)) for i, s in zip(ids[k : k + 100], found, strict=True))

    return by_text(docs, id_col, text_col, work, "id long, held_out boolean, score double, predicted int", binary=True).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below THRESHOLD, whole and with their columns.

    The score is computed beside the row, so null or repeated ids and columns of any name are as they were. A score at
    the threshold goes; null and empty texts score as a text without words; repeated rows stay or go together. Without
    a network all rows stay. Empty table: no rows.
    """
    if net is None:
        return docs
    sent = _Sent(docs.sparkSession, net)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = [_scorer(sent).scores([x.encode() for x in texts[k : k + 100]]) for k in range(0, len(texts), 100)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(score, "double")(text_of(text_col)) < THRESHOLD)


def in_training(id_col: str = "doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1
