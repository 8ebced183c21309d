"""Secret scan: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags every token of a text as secret begin, inside or outside. Its features are a token's
shape, the shapes and key words of its neighbours (three to the left, one to the right), and
features of the whole file. It is fitted at run time on windows labelled by the fixed patterns in a
bounded sample of documents, and on generated lines.

Viterbi decoding is exact but cheap: where "outside" leads by more than any two transitions can
change, every best path is outside there, so only the runs between such tokens need the recursion.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.batches import by_text

# Fixed patterns; a match whose length (of the group) is below the number is dropped.
PATTERNS = (
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+", re.A), 0, 32),
)
#: Runs below 32 are dropped anyway, and a run of that many is found whole.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}", re.A)
KIND_ORDER = {"assign": 0, "access": 1, "hex": 2, "crf": 3}

#: Key words whose presence beside a token matters; fixed values.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "pwd", "auth", "bearer", "credential", "private", "access")
MARKS = ("=", ":", '"', "'", ",", ";", "|")
_NAMED = frozenset(KEYWORDS + MARKS)
#: Size class of a token by its bytes, up to 40.
_SIZE = tuple(sum(n >= least for least in (2, 4, 6, 8, 12, 16, 20, 32, 40)) for n in range(41))
_TOKEN = re.compile(r"[^\s\"'=:,;|()<>\[\]{}]+|[\"'=:,;|()<>\[\]{}]")
#: Byte classes of a token: a-f, other lower case, upper case, digit, symbol of secrets, others.
_CLASS = bytes(
    (97 if chr(c) in "abcdef" else 98 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 43 if chr(c) in "+/_.-=" else 117) for c in range(256)
)
_RUNS = re.compile(rb"(.)\1*", re.S)
OFFSETS = (0, -1, -2, -3, 1)
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 300, 8, 40  # bounds of the labelled sample
GENERATED = 1500
CACHED = 400_000
FILE_FEATURES = 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, pattern, group, least in PATTERNS:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KIND_ORDER[s[2]]))


def signature(token: str) -> tuple:
    """The token's features as a small tuple: few tuples occur, however many tokens."""
    low = token.lower()
    word = low if low in _NAMED else ""
    shape = token.encode().translate(_CLASS)
    n, runs = len(shape), len(_RUNS.findall(shape))
    digits = shape.count(b"0")
    mask = (b"a" in shape) | (b"b" in shape) << 1 | (b"A" in shape) << 2 | (digits > 0) << 3 | (b"+" in shape) << 4 | (b"u" in shape) << 5
    return word, _SIZE[min(n, 40)], mask, min(3, digits * 5 // n), min(3, runs * 4 // n), token.startswith("AKIA")


def feature_names(sig: tuple, offset: int) -> list[tuple]:
    word, size, mask, digits, changes, akia = sig
    if offset:
        return [(offset, "w", word), (offset, "m", mask, size)] if not word else [(offset, "w", word)]
    return [(0, "w", word), (0, "s", size), (0, "m", mask), (0, "ms", mask, size), (0, "d", digits), (0, "c", changes), (0, "mc", mask, changes), (0, "a", akia)]


def file_parts(sig: tuple) -> tuple[bool, ...]:
    """What file features count of a token: marks, digits, non-ASCII characters, key words."""
    return sig[0] in MARKS, bool(sig[2] & 8), bool(sig[2] & 32), sig[0] in KEYWORDS


def file_features(parts: np.ndarray, n: int) -> np.ndarray:
    """Of the whole text: length, shares of tokens by file_parts (summed in parts), a constant."""
    if not n:
        return np.zeros(FILE_FEATURES)
    return np.array([min(1.0, np.log1p(n) / 10), parts[0] / n, parts[1] / n, parts[2] / n, min(1.0, 50 * parts[3] / n), 1.0])


class Field:
    """Weights of the field; tags are 0 outside, 1 begin, 2 inside."""

    def __init__(self, index: dict[tuple, int], weights: np.ndarray, of_file: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.of_file, self.steps = index, weights, of_file, steps
        self.start()

    def __getstate__(self):
        return self.index, self.weights, self.of_file, self.steps

    def __setstate__(self, state):
        self.index, self.weights, self.of_file, self.steps = state
        self.start()

    def start(self) -> None:
        self.rows: dict[tuple, int] = {}
        self.parts = np.zeros((1024, 4))
        self.scores = np.zeros((len(OFFSETS), 1024, 3))
        self.tokens: dict[str, int] = {}
        self.margin = 2 * float(self.steps.max() - self.steps.min()) + 1e-6

    def row(self, sig: tuple) -> int:
        if (r := self.rows.get(sig)) is None:
            r = self.rows[sig] = len(self.rows)
            if r == len(self.parts):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], axis=1)
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            self.parts[r] = file_parts(sig)
            for o, offset in enumerate(OFFSETS):
                known = [self.index[f] for f in feature_names(sig, offset) if f in self.index]
                self.scores[o, r] = self.weights[known].sum(axis=0)
        return r

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        cache = self.tokens
        try:
            return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            new = set(tokens).difference(cache)
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = set(tokens)
            for t in new:
                cache[t] = self.row(signature(t))
            return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        n = len(rows)
        parts = np.bincount(rows, minlength=len(self.parts)) @ self.parts
        out = self.scores[0][rows] + file_features(parts, n) @ self.of_file
        for o, offset in enumerate(OFFSETS[1:], 1):
            if offset < 0 and n > -offset:
                out[-offset:] += self.scores[o][rows[:offset]]
            elif offset > 0 and n > offset:
                out[:-offset] += self.scores[o][rows[offset:]]
        return out

    def tags(self, tokens: list[str]) -> np.ndarray | None:
        """The best path of tags, None if all are outside."""
        if not tokens:
            return None
        e = self.emissions(self.rows_of(tokens))
        open_ = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.margin)
        if not len(open_):
            return None
        out = np.zeros(len(tokens), np.int8)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            out[run] = self._viterbi(e[run])
        return out if out.any() else None

    def _viterbi(self, e: np.ndarray) -> list[int]:
        """Before and after the run stands an outside token, or the text's end, which counts as one (fit learns so)."""
        best, back = e[0] + self.steps[0], []
        for x in e[1:]:
            each = best[:, None] + self.steps
            back.append(each.argmax(axis=0))
            best = each.max(axis=0) + x
        path = [int((best + self.steps[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def spans_of(field: Field, text: str) -> list[tuple[int, int]]:
    """Code-point spans that the field tags as secret. An inside tag after an outside one begins a span."""
    tags = field.tags(_TOKEN.findall(text))
    if tags is None:
        return []
    found: list[list[int]] = []
    for tag, m in zip(tags.tolist(), _TOKEN.finditer(text), strict=True):
        if tag == 1 or tag == 2 and (not found or found[-1][1] != last):
            found.append([m.start(), m.end()])
        elif tag == 2:
            found[-1][1] = m.end()
        last = m.end()
    return [(a, b) for a, b in found]


def labelled(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens and tags; of a span, the value is tagged: what follows the key word, mark and quote."""
    tokens, tags, k = [], [], 0
    for m in _TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = k < len(spans) and m.end() > spans[k][0] and m.start() < spans[k][1]
        tokens.append(m[0])
        tags.append(0 if not inside else 2 if tags and tags[-1] and m.start() > spans[k][0] else 1)
    return tokens, tags


def _values(text: str) -> list[tuple[int, int]]:
    """Spans of the secrets proper, without key word and mark."""
    found = []
    for kind, pattern, group, least in PATTERNS:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(group), m.end(group)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    return merged


def sample_windows(key: object, text: str) -> list[tuple[list[str], list[int]]]:
    """At most SAMPLE_WINDOWS windows of WINDOW tokens: those with secrets first, then evenly placed ones."""
    tokens, tags = labelled(text, _values(text))
    hits = [k for k, t in enumerate(tags) if t == 1][: SAMPLE_WINDOWS // 2]
    starts = [max(0, k - WINDOW // 2) for k in hits]
    free = SAMPLE_WINDOWS - len(starts)
    starts += [k * max(1, len(tokens) // free) for k in range(free) if k * max(1, len(tokens) // free) < len(tokens)]
    return [(tokens[a : a + WINDOW], tags[a : a + WINDOW]) for a in starts]


def generated(n: int = GENERATED, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Lines with and without secrets, from a seeded generator."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 12))).capitalize() if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 12)))
    mixed = lambda k, alphabet: "".join(rng.choice(alphabet) for _ in range(k))
    strong = letters + letters.upper() + "0123456789" * 2
    out = []
    for _ in range(n):
        left, right = (" ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(2))
        kind = rng.randrange(7)
        if kind == 0:
            value = mixed(rng.randint(8, 40), strong + "+/_-")
            name = rng.choice(KEYWORDS)
            lead = rng.choice([name, name.upper(), name.capitalize()]) + rng.choice(["=", " = ", ": ", ":", '="', ' = "'])
        elif kind == 6:  # no mark between key word and value
            value, lead = mixed(rng.randint(16, 48), strong + "+/_-."), rng.choice(["Bearer ", "bearer ", "Authorization: Bearer ", "token ", "api key "])
        elif kind == 1:
            value, lead = "AKIA" + mixed(rng.randint(12, 16), letters.upper() + "0123456789"), ""
        elif kind == 2:
            value, lead = mixed(rng.choice([32, 40, 64]), "0123456789abcdef"), ""
        elif kind == 3:  # a key word in prose
            value, lead = "", rng.choice(KEYWORDS) + rng.choice([" ", ": ", " is "]) + word()
        elif kind == 4:  # numbers, dates, addresses
            value, lead = "", rng.choice([str(rng.randint(1, 10**9)), f"20{rng.randint(10, 30)}-{rng.randint(1, 12):02d}", f"{word()}.{word()}@{word()}.com", f"{rng.randint(1, 999)}-{rng.randint(1, 9999)}"])
        else:
            value, lead = "", " ".join(word() for _ in range(6))
        text = f"{left} {lead}{value}"
        spans = [(len(text) - len(value), len(text))] if value else []
        out.append(labelled(f"{text} {right}.", spans))
    return out


def fit(windows: list[tuple[list[str], list[int]]], epochs: int = 40, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by AdaGrad on forward-backward gradients, all windows at once."""
    windows = [w for w in windows if w[0]]
    sigs = [[signature(t) for t in tokens] for tokens, _ in windows]
    index: dict[tuple, int] = {}
    at, feature = [], []
    n, long = len(windows), max(len(t) for t, _ in windows)
    y, real, files = np.zeros((n, long), np.int64), np.zeros((n, long), bool), np.zeros((n, FILE_FEATURES))
    for k, ((_, tags), ss) in enumerate(zip(windows, sigs, strict=True)):
        y[k, : len(tags)], real[k, : len(tags)] = tags, True
        files[k] = file_features(np.sum([file_parts(x) for x in ss], axis=0), len(ss))
        for j in range(len(ss)):
            for offset in OFFSETS:
                if 0 <= j + offset < len(ss):
                    for f in feature_names(ss[j + offset], offset):
                        at.append(k * long + j)
                        feature.append(index.setdefault(f, len(index)))
    at, feature = np.array(at), np.array(feature)
    w, v, t = np.zeros((len(index), 3)), np.zeros((FILE_FEATURES, 3)), np.zeros((3, 3))
    sums = [np.full_like(p, 1e-8) for p in (w, v, t)]
    last = real.sum(axis=1) - 1
    one = np.eye(3)[y] * real[:, :, None]
    for _ in range(epochs):
        e = np.stack([np.bincount(at, w[feature, c], n * long) for c in range(3)], axis=1).reshape(n, long, 3) + (files @ v)[:, None, :]
        # Windows begin and end in an outside token, as the runs of decoding do.
        a, b = np.empty_like(e), np.empty_like(e)
        a[:, 0] = e[:, 0] + t[0]
        for j in range(1, long):
            z = a[:, j - 1, :, None] + t
            m = z.max(axis=1)
            a[:, j] = np.where(real[:, j, None], m + np.log(np.exp(z - m[:, None]).sum(axis=1)) + e[:, j], a[:, j - 1])
        b[:, -1] = t[:, 0]
        for j in range(long - 2, -1, -1):
            z = t + (e[:, j + 1] + b[:, j + 1])[:, None, :]
            m = z.max(axis=2)
            b[:, j] = np.where(real[:, j + 1, None], m + np.log(np.exp(z - m[:, :, None]).sum(axis=2)), t[:, 0])
        z = a[np.arange(n), last] + t[:, 0]
        m = z.max(axis=1)
        total = m + np.log(np.exp(z - m[:, None]).sum(axis=1))
        p = np.exp(a + b - total[:, None, None]) * real[:, :, None]
        gap = (p - one).reshape(-1, 3)
        g_w = np.stack([np.bincount(feature, gap[at, c], len(index)) for c in range(3)], axis=1)
        g_v = files.T @ (p - one).sum(axis=1)
        pair = a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - total[:, None, None, None]
        both = real[:, 1:, None, None]
        g_t = (np.exp(np.where(both, pair, -np.inf))).sum(axis=(0, 1)) - np.einsum("nji,njk->ik", one[:, :-1], one[:, 1:])
        g_t[0] += (p[:, 0] - one[:, 0]).sum(axis=0)
        g_t[:, 0] += (p[np.arange(n), last] - one[np.arange(n), last]).sum(axis=0)
        for x, g, s in zip((w, v, t), (g_w, g_v, g_t), sums, strict=True):
            g = g / n + ridge * x / n
            s += g * g
            x -= rate * g / np.sqrt(s)
    return Field(index, w, v, t)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fitted on windows of one text of each of the SAMPLE_DOCS ids with the smallest crc32, at most SAMPLE_WINDOWS a text, and on generated lines."""
    key = F.crc32(F.col(id_col).cast("string"))
    ids = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("k")).orderBy("k", "id").limit(SAMPLE_DOCS)
    # The ids first, without texts: SAMPLE_DOCS of them are sent to the scan that takes the texts.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # One text of an id, whatever the number of its rows: that of the smallest hash.
    few = texts.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def work(ids, texts):
        return ((i, n, tokens, tags) for i, x in zip(ids, texts, strict=True) for n, (tokens, tags) in enumerate(sample_windows(i, x)))

    rows = by_text(few, "id", "text", work, "id long, n int, tokens array<string>, tags array<int>").orderBy("id", "n", "tokens").collect()
    return fit([(list(r.tokens), list(r.tags)) for r in rows] + generated())


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: array of (kind, start, end) in code points, by start, then kind; every row and whole text.

    Kinds assign, access and hex are the fixed patterns', all kept; crf spans are added unless they
    lie inside one of those. Null or empty text: no spans. A null id stays null; repeated rows give
    repeated results. Empty table: no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col))

    def work(ids, texts):
        field = sent.value
        for i, x in zip(ids, texts, strict=True):
            base = base_spans(x)
            more = [(a, b, "crf") for a, b in spans_of(field, x) if not any(s <= a and b <= e for s, e, _ in base)]
            yield i, [{"kind": k, "start": a, "end": b} for a, b, k in sorted(base + more, key=lambda s: (s[0], KIND_ORDER[s[2]]))]

    return by_text(docs, id_col, text_col, work, "id long, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan_secrets' spans."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(k) for k in ("assign", "access", "hex")], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
