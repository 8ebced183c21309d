"""Token ids in binary files of our own format: fixed-width bit packing with block offsets.

A file holds whole documents. All numbers are little-endian:

    magic 8 bytes | bits u32 | ids in a block u32 | documents u64 | ids u64
    document id i64 for each document | 1 for a null id, u8 for each document
    first id of each document, and the number of ids, i64
    byte offset of each block in the payload, and its end, i64
    payload: blocks of ids packed with ``bits`` bits each, low bit first, each from a byte's start

``bits`` is the least number that holds every id of the vocabulary. A document is read by unpacking
only the blocks that hold it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.batches import slices, take_over
from wordloom.llm.chunks import Encoded, uncut
from wordloom.llm.shared import shared_dir, text_of, written

MAGIC = b"WLTOKEN1"
BLOCK = 1 << 14
FILE_IDS = 1 << 24
CACHED = 500_000
GROUP = 200
PART = 20_000  # chunks that are encoded as one text


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="<u4")) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype("<u4") @ (np.uint32(1) << np.arange(bits, dtype="<u4"))


def file_bytes(docs: list[int | None], ends: list[int], ids: np.ndarray, bits: int) -> bytes:
    """ends: number of ids up to and with each document."""
    blocks = [pack(ids[k : k + BLOCK], bits) for k in range(0, len(ids), BLOCK)]
    head = MAGIC + np.array([bits, BLOCK], "<u4").tobytes() + np.array([len(docs), len(ids)], "<u8").tobytes()
    keys = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<i8").tobytes()
    return head + keys + np.array([0, *ends], "<i8").tobytes() + offsets + b"".join(blocks)


class TokenFile:
    """Random access to the documents of one file. source: seekable and readable."""

    def __init__(self, source):
        self.source = source
        head = source.read(32)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block = (int(x) for x in np.frombuffer(head, "<u4", 2, 8))
        n, self.n_ids = (int(x) for x in np.frombuffer(head, "<u8", 2, 16))
        keys, null = np.frombuffer(source.read(8 * n), "<i8"), np.frombuffer(source.read(n), np.uint8)
        self.docs = [None if z else int(k) for k, z in zip(keys, null, strict=True)]
        self.begin = np.frombuffer(source.read(8 * (n + 1)), "<i8")
        self.offsets = np.frombuffer(source.read(8 * (-(-self.n_ids // self.block) + 1)), "<i8")
        self.payload = 32 + 17 * n + 8 + 8 * len(self.offsets)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, -(-stop // self.block)
        self.source.seek(self.payload + int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last] - self.offsets[first]))
        parts = [
            unpack(data[int(a - self.offsets[first]) : int(b - self.offsets[first])], self.bits, min(self.block, self.n_ids - k * self.block))
            for k, (a, b) in enumerate(pairwise(self.offsets[first : last + 1]), first)
        ]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.begin[k]), int(self.begin[k + 1]))


#: Characters that every version of Unicode and both libraries class alike: ASCII but for white space and control characters other than
#: line breaks, and letters of common scripts; and the spaces between chunks.
PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]+")
#: The byte-level pre-tokeniser's pattern.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_encoder(spec: dict, letters: dict[str, int]) -> Callable[[str], list[int]] | None:
    """tiktoken's encoder of the vocabulary; None where ids aren't in the order of merges, or the model has options that it lacks."""
    import tiktoken

    model, raw = spec["model"], lambda s: bytes(letters[c] for c in s)
    vocabulary, merges = model["vocab"], ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    first = len(vocabulary) - len(merges)
    if first != 256 or any(vocabulary.get(m) != first + k for k, m in enumerate(merges)) or any(c not in letters for s in vocabulary for c in s):
        return None
    if model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or not spec["pre_tokenizer"].get("use_regex", True):
        return None
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks={raw(s): i for s, i in vocabulary.items()}, special_tokens={}).encode_ordinary


class Encoder:
    """The tokenizers library, asked only for chunks that aren't in a bounded cache.

    New chunks that start and end without white space go to the library as one text, and the ids are
    cut where the chunks end; chunks for which no id ends there, and all others, go one by one. Of these texts, those of
    PLAIN characters alone are encoded by tiktoken, which is faster on words seen once and gives the same ids where the
    vocabulary's ids are in the order of its merges (plain_encoder).
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        plain = json.loads(definition)
        self.chunked = (plain["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not plain["pre_tokenizer"]["add_prefix_space"] and not plain["normalizer"]
        from wordloom.llm.bpe import byte_letters

        self.plain = plain_encoder(plain, byte_letters()) if self.chunked else None
        letters, self.length = byte_letters(), np.zeros(self.size, np.int64)
        for s, i in vocabulary.items():
            self.length[i] = len(s) if all(c in letters for c in s) else len(s.encode())
        self.spaced, self.bare = Encoded(CACHED), Encoded(CACHED // 10)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Chunks in parts, and the ids of each part as one text, a space before each chunk."""
        for k in range(0, len(chunks), PART):
            part = chunks[k : k + PART]
            text = " " + " ".join(part)
            if self.plain and PLAIN.fullmatch(text):
                yield part, np.array(self.plain(text), "<u4")
                continue
            plain = [c for c in part if PLAIN.fullmatch(c)] if self.plain else []
            if plain:
                yield plain, np.array(self.plain(" " + " ".join(plain)), "<u4")
                part = [c for c in part if not PLAIN.fullmatch(c)]
            yield part, np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")

    def _spaced(self, chunks: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        for part, ids in self._joined([c for c in chunks if c and c[0] > " " < c[-1]]):
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)) + 1)
            upto = np.cumsum(self.length[ids])
            at = np.searchsorted(upto, ends)
            good = upto[np.minimum(at, len(upto) - 1)] == ends
            good[1:] &= good[:-1].copy()
            data, stop = ids.tobytes(), (4 * at + 4).tolist()
            cut = [data[a:b] for a, b in zip([0, *stop], stop)]  # noqa: B905
            out.update(zip(part, cut, strict=True))
            if not good.all():
                for j in np.flatnonzero(~good):
                    del out[part[j]]
        if len(out) < len(chunks):
            rest = [c for c in chunks if c not in out]
            out.update(zip(rest, self._whole([" " + c for c in rest]), strict=True))
        return list(map(out.__getitem__, chunks))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        out: list = [None] * len(texts)
        cut, first, rest = {}, set(), set()
        for k, x in enumerate(texts):
            if self.chunked and not any(s in x for s in self.special) and not uncut(x):
                cut[k] = chunks = x.split(" ")
                first.add(chunks[0])
                rest.update(chunks[1:])
        whole = [k for k in range(len(texts)) if k not in cut]
        for k, found in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = found
        self.bare.learn(first, self._whole)
        self.spaced.learn(rest, self._spaced)
        for k, chunks in cut.items():
            out[k] = self.bare[chunks[0]] + b"".join(map(self.spaced.__getitem__, chunks[1:]))
        return out


_LOADED: dict[int, Encoder] = {}


def loaded(definition: str) -> Encoder:
    import os

    take_over("token_files", _LOADED.clear)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if (key := hash(definition)) not in _LOADED:
        _LOADED[key] = Encoder(definition)
    return _LOADED[key]


def _save(folder: str, name: str, data: bytes) -> str:
    """Written under a name of this attempt's own; the row that names it is what makes it part of the result."""
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}.tok"
    with system.open_output_stream(f"{path}/{own}") as f:
        f.write(data)
    return f"{folder}/{own}"


def write_tokens(docs: DataFrame, folder: str, definition: str, end_id: int | None, id_col="doc_id", text_col="text") -> DataFrame:
    """Encodes and writes all texts in ascending id order; a row for each file: part, seq, path, n_ids.

    Texts are dealt by ranges of ids, encoded where they land and written at once; a file is closed
    at FILE_IDS ids, so a task's memory is bounded. A repeated task writes files of other names, and only
    those that a row names count. folder: a URI that all executors can reach.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = loaded(definition), TaskContext.get().partitionId(), 0
        bits, tail = bits_for(max(encoder.size, (end_id or 0) + 1)), b"" if end_id is None else end_id.to_bytes(4, "little")
        keys, ends, data, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            path = _save(folder, f"part-{part:06d}-{seq:04d}", file_bytes(keys, ends, np.frombuffer(b"".join(data), "<u4"), bits))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_ids": [n]}, schema=schema)

        for batch in (some for whole in batches for some in slices(whole)):
            for i, found in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist()), strict=True):
                keys.append(i)
                data += (found, tail)
                n += (len(found) + len(tail)) // 4
                ends.append(n)
            if n >= FILE_IDS:
                yield close()
                keys, ends, data, n, seq = [], [], [], 0, seq + 1
        if keys:
            yield close()

    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_ids", pa.int64())])
    return written(ranged.mapInArrow(run, "part long, seq long, path string, n_ids long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian uint32): every document of the files, each file by its blocks."""
    return _read(files, "ids binary", lambda ids: (ids.tobytes(),))


def read_counts(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files alone."""
    return _read(files, "n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids.tobytes())))


def _read(files: DataFrame, ddl: str, of) -> DataFrame:
    # One row for each file, FILE_IDS ids or a task's share: small enough for one task's running sum.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = files.select("path", before.alias("base")).repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = pafs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as f:
                    tokens = TokenFile(f)
                    for k in range(0, len(tokens.docs), GROUP):
                        docs = tokens.docs[k : k + GROUP]
                        begin = tokens.begin[k : k + len(docs) + 1]
                        ids = tokens.ids(int(begin[0]), int(begin[-1]))
                        found = [(d, base + int(a), *of(ids[a - begin[0] : b - begin[0]])) for d, (a, b) in zip(docs, pairwise(begin), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

    names = ["doc_id", "start", *(c.split()[0] for c in ddl.split(", "))]
    return based.mapInArrow(run, f"doc_id long, start long, {ddl}")


def tokenize_to_files(docs: DataFrame, definition: str, end_id: int | None, id_col="doc_id", text_col="text") -> DataFrame:
    """read_counts of the files that write_tokens makes in a new folder of the shared one.

    Null or empty text: only the end id. Null ids come first, repeated rows each get their place (ties
    by the text's hash, then the text). Empty table: no file, no rows. Other columns are ignored.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_counts(write_tokens(docs, folder, definition, end_id, id_col, text_col))
