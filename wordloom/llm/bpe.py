"""Byte-level BPE encoding and decoding; encoding by traversal of a trie of distinct words.

A word's encoding is fixed by the last token of each of its prefixes: the last token t of a prefix is
the one for which the prefix without t ends, in its own encoding, in a token that may stand before t.
Two tokens may stand together if no merge across their border would have come first. So a trie's
node needs only its last token, and words with a common prefix share the work for it: the distinct
words of a batch go into a trie, and a depth-first walk carries the last tokens of the path along.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from wordloom.llm.batches import by_text, take_over
from wordloom.llm.chunks import Encoded, uncut

_WHITE = r"\t-\r \x85\xa0  -     　"
#: The pre-tokeniser's fixed pattern, its white space written out as Unicode's property.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
CACHED = 200_000
BYTES = [bytes([b]) for b in range(256)]
TRIE_WORDS = 20_000
TAIL = 4


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Bpe:
    def __init__(self, definition: str):
        """definition: the JSON text of a tokenizers file with a byte-level BPE model."""
        spec = json.loads(definition)
        model, letters = spec["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]) or spec["normalizer"]:
            raise ValueError("added tokens with options and normalizers aren't supported")
        self.rank, self.halves = {}, {}
        for n, merge in enumerate(model["merges"]):
            a, b = (self.ids[raw(s)] for s in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[a, b] = n
            self.halves.setdefault(self.ids[raw("".join(merge.split(" ") if isinstance(merge, str) else merge))], (n, a, b))
        size = max([*self.ids.values(), *self.special.values()]) + 1
        content = [b""] * size
        for s, i in self.ids.items():
            content[i] = s
        for s, i in self.special.items():
            content[i] = s.encode()
        self.blob = np.frombuffer(b"".join(content), np.uint8)
        self.size = [len(s) for s in content]
        self.longest = max(self.size)
        self.length = np.array(self.size, np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lengths: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) >= TAIL:
                self.lengths.setdefault(t[-TAIL:], set()).add(len(t))
        self.tails: dict[bytes, tuple[int, ...]] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words, self.spaced, self.bare = Encoded(CACHED), Encoded(CACHED), Encoded(CACHED // 10)

    def _edge(self, token: int) -> tuple[list, list]:
        """(right, left): the tokens at the token's right and left end while it was merged, as (token, rank of its birth, rank at which it is used up)."""
        if token not in self.edges:
            both = []
            for side in (2, 1):
                t, gone, found = token, len(self.rank), []
                while t in self.halves:
                    born = self.halves[t][0]
                    found.append((t, born, gone))
                    t, gone = self.halves[t][side], born
                both.append([*found, (t, -1, gone)])
            self.edges[token] = tuple(both)
        return self.edges[token]

    def fit(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their joint bytes; kept in fits."""
        rank, ok = self.rank, True
        for x, x_born, x_gone in self._edge(a)[0]:
            for y, y_born, y_gone in self._edge(b)[1]:
                r = rank.get((x, y))
                # Of equal ranks the left pair is merged first.
                if r is not None and x_born < r < x_gone and y_born < r <= y_gone:
                    ok = False
        if len(self.fits) >= 250_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def _tail(self, tail: bytes) -> tuple[int, ...]:
        """Lengths that tokens at the end of a text with this tail may have, shortest first."""
        if len(self.tails) >= 250_000:
            self.tails.clear()
        short = [n for n in range(1, min(TAIL, len(tail) + 1)) if tail[-n:] in self.ids]
        found = self.tails[tail] = (*short, *sorted(self.lengths.get(tail, ())))
        return found

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian uint32; words sorted, so that slices share prefixes."""
        out = []
        collecting = gc.isenabled()
        gc.disable()  # a trie is many objects without cycles
        try:
            for k in range(0, len(words), TRIE_WORDS):
                out += self._walk([w.encode() for w in words[k : k + TRIE_WORDS]])
        finally:
            if collecting:
                gc.enable()
        return out

    def _walk(self, words: list[bytes]) -> list[bytes]:
        trie: dict = {}
        for n, w in enumerate(words):
            node = trie
            for b in w:
                nxt = node.get(b)
                if nxt is None:
                    nxt = node[b] = {}
                node = nxt
            node[-1] = n
        out: list[bytes] = [b""] * len(words)
        ids, fits, tails, size = self.ids, self.fits, self.tails, self.size
        last = [-1]  # last[d]: last token of the path's first d bytes
        stack = [(BYTES[b], 1, node) for b, node in trie.items() if b >= 0]
        while stack:
            text, depth, node = stack.pop()  # text: the path, or its end where it is longer than any token
            del last[depth:]
            tail = text[-TAIL:]
            for n in tails.get(tail) or self._tail(tail):
                token = ids.get(text[-n:])
                if token is not None:
                    before = last[depth - n]
                    ok = before < 0 or fits.get((before, token))
                    if ok or ok is None and self.fit(before, token):
                        last.append(token)
                        break
            if depth > self.longest:
                text = text[-self.longest :]
            for c, nxt in node.items():
                if c >= 0:
                    stack.append((text + BYTES[c], depth + 1, nxt))
                else:
                    tokens, d = array("I"), depth
                    while d:
                        tokens.append(last[d])
                        d -= size[last[d]]
                    tokens.reverse()
                    out[nxt] = tokens.tobytes()
        return out

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [_WORDS.findall(c) for c in chunks]
        self.words.learn({w for ws in cut for w in ws}, self.encode_words)
        got = self.words.__getitem__
        return [b"".join(map(got, ws)) for ws in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        cut, first, rest = [], set(), set()
        for x in texts:
            parts = []
            for piece in self.special_split.split(x) if self.special_split and any(s in x for s in self.special) else (x,):
                chunks = [piece] if piece in self.special or uncut(piece) else piece.split(" ")
                parts.append(chunks)
                if piece not in self.special:
                    first.add(chunks[0])
                    rest.update(chunks[1:])
            cut.append(parts)
        self.bare.learn(first, self._encode_chunks)
        self.spaced.learn(rest, lambda new: self._encode_chunks([" " + c for c in new]))
        bare, spaced, out = self.bare.__getitem__, self.spaced.__getitem__, []
        for parts in cut:
            found = []
            for chunks in parts:
                if (i := self.special.get(chunks[0])) is not None and len(chunks) == 1:
                    found.append(i.to_bytes(4, "little"))
                else:
                    found.append(bare(chunks[0]))
                    found += map(spaced, chunks[1:])
            out.append(b"".join(found))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        size = self.length[ids]
        upto = np.cumsum(size)
        at = np.repeat(self.begin[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(definition: str) -> Bpe:
    """One codec for each worker process, with its caches."""
    take_over("bpe", _LOADED.clear)
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(definition)
    return _LOADED[key]


SCHEMA = "id long, n_tokens long, ids binary, decoded string"
DIGESTS = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(ids: list, texts: list[str], codec: Bpe):
    for i, found in zip(ids, codec.encode_batch(texts), strict=True):
        yield i, found, codec.decode(np.frombuffer(found, "<u4"))


def encode_decode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian uint32), decoded: each whole text encoded, then decoded from the ids.

    Null or empty text: no ids, decoded ''. A null id stays null; repeated rows give repeated
    results. Empty table: no rows. Other columns are ignored. Very long words take a deeper trie.
    """

    def work(ids, texts):
        return ((i, len(f) // 4, f, t) for i, f, t in _rows(ids, texts, loaded(definition)))

    return by_text(docs, id_col, text_col, work, SCHEMA).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with SHA-256 of ids and of the decoded text in their place."""

    def work(ids, texts):
        return ((i, len(f) // 4, hashlib.sha256(f).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, f, t in _rows(ids, texts, loaded(definition)))

    return by_text(docs, id_col, text_col, work, DIGESTS).withColumnRenamed("id", id_col)
