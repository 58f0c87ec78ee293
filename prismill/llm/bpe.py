"""Byte-pair encoding by a priority queue of merge ranks over a linked symbol list.

A tokenizer file gives the vocabulary and the ranked merges. A text is cut at
white space; a word is normalised, split into pieces and each piece merged: a
heap holds (rank, position) of every adjacent pair with a merge, symbols form
a doubly linked list, and an entry whose symbols have changed since it was
pushed is skipped. Decoding joins vocabulary strings.

Defined results
- null or empty text, or white space only: no ids, decoded text is empty
- a text of any length is encoded whole; a word is bounded only by the text
- repeated rows give repeated results, an empty table gives an empty table
- columns of the input are kept; one that has an output's name is replaced by the output
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismill.llm import wordhash

#: Words kept with their ids in each Python worker; beyond that the memory is emptied and filled anew.
CACHED_WORDS = 25_000
#: The same for the compact table that encoding of many texts uses: some 40 bytes a word with its ids.
TABLE_WORDS = 1_500_000
#: A worker remembers words of so many bytes from one task to the next.
KEEP_BYTES = 32 << 20

#: White space to Python's split() that the tokenizer files treat as symbols.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


#: Fixed: ranges of letters and numbers of Unicode 16 that Python's tables don't have yet, and small letters of newer capitals.
_NEWER = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0),
    (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
]
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _sign(c: str) -> bool:
    """A code point without a letter or number in the tokenizers' Unicode."""
    return unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in _NEWER)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Encodes and decodes with a tokenizer file of BPE with word ends (given as its JSON text)."""

    def __init__(self, spec: str, cached_words: int = CACHED_WORDS):
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        self.strings = [""] * (max([*vocab.values(), *(t["id"] for t in d["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        end = model["end_of_word_suffix"]
        self.inner = [vocab[c] for c in byte_symbols()]
        self.final = [vocab[c + end] for c in byte_symbols()]
        splits = [p["pattern"]["Regex"] for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0])
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.limit = cached_words
        self.words = _Memory(self._word, cached_words)
        self.table = _Table()
        self.piece_ids = _Memory(self._merge, cached_words)

    def _merge(self, piece: str) -> bytes:
        data = piece.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        n, merges = len(ids), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        queue = [(rank, i, a, b, made) for rank, made, i, a, b in queue]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            right[i] = k = right[j]
            right[j] = -1
            if k >= 0:
                left[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(queue, (m[0], i, made, ids[k], m[1]))
            if (h := left[i]) >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, ids[h], made, m[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        word = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        cut = word
        if not word.isascii():  # the regex module's Unicode is newer than the tokenizers', Python's older
            word = word.translate(_SMALL)
            cut = "".join("\uffff" if _sign(c) else c for c in word)
        return b"".join(self.piece_ids[word[m.start() : m.end()]] for m in self.pieces.finditer(cut))

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in _SEPARATORS):
            return b"".join(map(self._word, re.split("[^\\S\x1c-\x1f]+", text)))
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.apart and "<|" in text:
            parts = self.apart.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _any(self, word: str) -> bytes:
        """Ids of what stands between ASCII white space."""
        return self.encode(word) if "<|" in word or not word.isprintable() else self._word(word)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers: equal words of all texts are found by hash and looked up once."""
        parts = [(t or "").encode() for t in texts]
        if not parts:
            return []
        data = b"\n".join(parts)
        first, last = wordhash.spans(data)
        h, check = (wordhash.hashes(data, first, last, seed) for seed in (0, 1))
        code, unique = pd.factorize(h)
        at = _first(code, len(unique))
        if not np.array_equal(check[at][code], check):  # different words of one hash
            code = pd.factorize(pd.MultiIndex.from_arrays([h, check]))[0]
            at = _first(code, int(code.max()) + 1)
        start, size = self.table.places(data, h[at], check[at], first[at], last[at], self._encode_words)
        n = size[code]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = self.table.ids[np.repeat(start[code] - end[:-1], n) + np.arange(end[-1])]
        return np.split(ids, end[np.searchsorted(first, np.cumsum([len(p) + 1 for p in parts]))][:-1])

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return list(map(self._any, words))

    def forget(self) -> None:
        """Let go of the words remembered, if they take more than ``KEEP_BYTES``: less may stay for a worker's next task."""
        held = self.table.n_bytes() + 200 * sum(len(m) + len(m.older) for m in (self.words, self.piece_ids))
        if held <= KEEP_BYTES:
            return
        self.words, self.table, self.piece_ids = _Memory(self._word, self.limit), _Table(), _Memory(self._merge, self.limit)

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The vocabulary strings of the ids, with one space between, as files without a decoder ask for."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _first(code: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes is first."""
    at = np.zeros(n, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    return at


class LibraryEncoder(WordEncoder):
    """The same ids from the tokenizers library, asked once for each word that isn't remembered."""

    def __init__(self, spec: str, cached_words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__(spec, cached_words)
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()

    def _word(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        return self._word(text)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]


class _Table:
    """Words seen, as sorted arrays: a 64-bit hash, another of 32 bits against chance, and where the word's ids are.

    Some 30 bytes a word, where a dict takes 200. Emptied beyond ``TABLE_WORDS``.
    """

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 12, "<u4"), 0

    def n_bytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.checks, self.starts, self.sizes, self.ids))

    def places(self, data: bytes, keys: np.ndarray, checks: np.ndarray, first: np.ndarray, last: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these different words are, and how many; words not seen before are encoded."""
        if len(self.keys) > TABLE_WORDS:
            self.__init__()
        check = (wordhash.mix(checks) >> np.uint64(32)).astype(np.uint32)
        at = np.searchsorted(self.keys, keys)
        safe = np.minimum(at, max(0, len(self.keys) - 1))
        known = (self.keys[safe] == keys) & (self.checks[safe] == check) if len(self.keys) else np.zeros(len(keys), bool)
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        start[known], size[known] = self.starts[safe[known]], self.sizes[safe[known]]
        new = np.flatnonzero(~known)
        if len(new):
            got = encode([data[a:b].decode() for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)])
            size[new] = np.fromiter(map(len, got), np.int64, len(got)) >> 2
            end = self.used + np.cumsum(size[new])
            start[new] = end - size[new]
            if end[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), int(end[-1]) - len(self.ids)), "<u4")])
            self.ids[self.used : end[-1]] = np.frombuffer(b"".join(got), "<u4")
            self.used = int(end[-1])
            order = new[np.argsort(keys[new])]
            to = np.searchsorted(self.keys, keys[order])
            self.keys, self.checks = np.insert(self.keys, to, keys[order]), np.insert(self.checks, to, check[order])
            self.starts, self.sizes = np.insert(self.starts, to, start[order]), np.insert(self.sizes, to, size[order])
        return start, size


class _Memory(dict):
    """Results of a function by its argument. When full, what was asked for lately stays for one more filling."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


_LOADED: list = [None, None]


def _loaded(kind: type[WordEncoder], spec: str) -> WordEncoder:
    if _LOADED[0] != (kind, spec):
        _LOADED[:] = [(kind, spec), kind(spec)]
    return _LOADED[1]


def encoder(spec: str) -> WordEncoder:
    """The encoder of a file's text, made once in each Python worker."""
    return _loaded(WordEncoder, spec)


def library(spec: str) -> LibraryEncoder:
    """The same with the library's merges."""
    return _loaded(LibraryEncoder, spec)


def read_spec(path: str) -> str:
    """The text of a tokenizer file. The driver reads it and sends it along, so executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def texts(column: pa.ChunkedArray | pa.Array, chars: int = 1 << 22) -> Iterator[list[str | None]]:
    """A column's strings in lists of about so many bytes, one text at least."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), float)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right")))
        yield column.slice(at, end - at).to_pylist()
        at = end


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of the input's."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def added(df: DataFrame, *fields: T.StructField, reads: str = "") -> tuple[DataFrame, T.StructType, str]:
    """The input without columns that the new fields replace, the schema with these, and the name under which ``reads`` is found now."""
    new = {f.name.lower() for f in fields}
    at = reads
    if reads.lower() in new:
        at = fresh(df, reads)
        df = df.withColumn(at, F.col(reads))
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in new))
    return df, T.StructType([*df.schema.fields, *fields]), at


def mapped(df: DataFrame, column: str, fields: dict[str, T.DataType], make, keep: bool = True, whole: bool = False, end=None) -> DataFrame:
    """Add fields that ``make`` gives for each text of a column: make(text) -> tuple, or with ``whole`` make(texts) -> tuples. Columns of these names are replaced; the text itself need not be kept. ``end`` is called when a task is done."""
    from pyspark.sql.pandas.types import to_arrow_type

    d, schema, at = added(df, *(T.StructField(n, t) for n, t in fields.items()), reads=column)
    names, types = list(fields), [to_arrow_type(t) for t in fields.values()]
    stay = [c for c in d.columns if keep and at == column or c != at]
    schema = T.StructType([f for f in schema.fields if f.name in stay or f.name in fields])

    def run(batches):
        for batch in batches:
            rows = []
            for part in texts(batch.column(at)):
                rows += make(part) if whole else map(make, part)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), *made], names=[*stay, *names])
        if end:
            end()

    return d.mapInArrow(run, schema)


def encode(df: DataFrame, spec: str, column: str = "text", to: str = "ids") -> DataFrame:
    """Add the ids of each text as an array of integers."""
    return mapped(df, column, {to: T.ArrayType(T.IntegerType(), False)}, lambda ts: [(x.view(np.int32),) for x in encoder(spec).encode_all(ts)], whole=True)


def decode(df: DataFrame, spec: str, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null gives an empty text."""
    d, schema, at = added(df, T.StructField(to, T.StringType()), reads=column)

    def run(batches):
        for batch in batches:
            code = encoder(spec)
            out = [code.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, to])

    out = d.mapInArrow(run, schema)
    return out if at == column else out.drop(at)


def round_trip(df: DataFrame, spec: str, column: str = "text", ids: str | None = None, keep: bool = True) -> DataFrame:
    """Encode each text and decode its ids again in one pass: n_tokens, ids_sha256 and decoded_sha256 are added, on request also the ids; the text need not be kept."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    fields = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def make(texts):
        code = encoder(spec)
        for x in code.encode_all(texts):
            out = len(x), sha(x), sha(code.decode(x).encode())
            yield (*out, x.view(np.int32)) if ids else out

    return mapped(df, column, fields | ({ids: T.ArrayType(T.IntegerType(), False)} if ids else {}), make, keep, whole=True, end=lambda: encoder(spec).forget())
