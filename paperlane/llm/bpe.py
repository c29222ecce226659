"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text marks cuts, wherever they fall, so that passages shared by
documents give the same chunks. A chunk's core, from its first blank to its last, is encoded once
and kept by content. At each cut the join is repaired: the fragments on both sides are put
together and encoded anew, and so is a window of them with the words next to them. If the window's
encoding is not, token for token, that of its parts, the join grows: it takes in the cores on both
sides, whole, and is encoded and compared again, until all joins agree or the text is one span.

A core is made of its words' encodings, each word being encoded once (`units` gives cores to the
library whole instead). New words go to the library TOGETHER at a time, with a sign of one token
between them; where the parts found are not as many as the words, each is encoded alone. That is exact where neither normaliser nor splitter carries anything over
an ASCII blank and no added token holds one, which the windows check at every join.

What is kept lives in the Python worker, is bounded by entries, and serves all its tasks. There is
no shuffle: a chunk store shared by all executors would move every text twice.

Null counts as the empty text: no tokens, no decoded text. Rows are never merged, so repeated rows
and null ids give one row each; other columns are ignored; an empty table gives an empty one. The
decoder is the vocabulary's own.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

WINDOW, TOGETHER = 16, 64
STOP = "\x01"
KINDS = {"n_tokens": (pa.int64(), "long"), "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_letter = np.zeros(256, bool)
_letter[97:123] = True
_gear = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, 256, dtype=np.uint32)


def folded(data: bytes) -> bytes:
    """A text whose words differ less and whose encoding is the same.

    The normaliser lowers ASCII letters anyhow, unless an added token is spelled with them or a
    combining mark may compose with the capital alone. The splitter parts a letter from a comma or
    full stop at a word's end.
    """
    if b"<|" in data or b"\xcc" in data or b"\xcd" in data:
        return data
    data = data.lower()
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b[1:-1] == 46) | (b[1:-1] == 44)) + 1
    at = at[_letter[b[at - 1]] & _blank[b[at + 1]]]
    return np.insert(b, at, 32).tobytes() if len(at) else data


def cuts(data: bytes, bits: int = 9) -> np.ndarray:
    """Positions where the rolling hash of the WINDOW bytes before has its top bits zero: one in 2 ** bits."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < WINDOW:
        return np.empty(0, np.int64)
    g = _gear[b]
    n = len(b) - WINDOW + 1
    h = np.zeros(n, np.uint32)
    for j in range(WINDOW):  # gear hash, shifted by one bit for each later byte
        h += g[j : j + n] << np.uint32(WINDOW - 1 - j)
    h *= np.uint32(0x9E3779B1)
    return np.flatnonzero(h >> np.uint32(32 - bits) == 0) + WINDOW


def pieces(data: bytes, bits: int = 9) -> list[tuple[bool, bytes]]:
    """Cores (True) and repaired joins (False, without blanks) of a text, in order."""
    c = cuts(data, bits)
    if not len(c):
        return [(True, data)]
    at = np.flatnonzero(_blank[np.frombuffer(data, np.uint8)])
    k = np.searchsorted(at, c)
    left = np.where(k > 0, at[np.maximum(k - 1, 0)] + 1 if len(at) else 0, 0)
    right = np.append(at, len(data))[k]
    out, done = [], 0
    for lo, hi in zip(left.tolist(), right.tolist(), strict=True):
        if lo < done:  # a span that holds several cuts
            continue
        if lo > done:
            out.append((True, data[done:lo]))
        if hi > lo:
            out.append((False, data[lo:hi]))
        done = hi
    if done < len(data):
        out.append((True, data[done:]))
    return out


class ChunkEncoder:
    """Encodes texts through stores of chunks, joins and words.

    An encoding is (number of tokens, decimal ids joined by spaces, decoded text). `counts` tells how
    many cores were met and how many of them encoded, and how many joins were met, encoded and grown.
    """

    def __init__(self, path: str, bits: int = 9, units: bool = False, most_words: int = 400_000, most_chunks: int = 40_000, most_joins: int = 200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.units, self.most_words, self.most_chunks, self.most_joins = bits, units, most_words, most_chunks, most_joins
        self.words: dict[bytes, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple[int, str, str]] = {}
        self.joins: dict[bytes, bool] = {}
        self.silent = False  # whether any word gave no token
        self.stop = self.plain([STOP])[0]
        self.counts = dict.fromkeys(("cores", "encoded_cores", "joins", "encoded_joins", "grown_joins"), 0)

    def plain(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """The library's own encodings."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        decode = self.tokenizer.decode
        return [(len(ids := e.ids), " ".join(map(str, ids)), decode(ids, skip_special_tokens=False)) for e in found]

    def _together(self, parts: list) -> tuple[int, str, str]:
        if self.silent:
            parts = [p for p in parts if p[0]]
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return 0, "", ""
        n, ids, texts = zip(*parts, strict=True)
        return sum(n), " ".join(ids), " ".join(texts)

    def _apart(self, words: list[str]) -> list[tuple[int, str, str]]:
        """The words' own encodings, many words being encoded together with STOP between them."""
        one, number, sign = self.stop
        parts = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        some = [p for p in parts if one == 1 and not any(STOP in w for w in p)]
        whole = dict(zip(map(id, some), self.plain([f" {STOP} ".join(p) for p in some]), strict=True))
        out = []
        for p in parts:
            _, ids, text = whole.get(id(p), (0, "", ""))
            ids, texts = ids.split(f" {number} "), text.split(f" {sign} ")
            if len(ids) == len(texts) == len(p) and ids[0] and id(p) in whole:
                out += zip([i.count(" ") + 1 for i in ids], ids, texts, strict=True)
            else:  # a word without tokens, or with the sign
                out += self.plain(p)
        return out

    def _learn(self, met: set[bytes]) -> None:
        fresh = list(met.difference(self.words))
        found = self._apart([w.decode() for w in fresh])
        self.silent = self.silent or not all(e[0] for e in found)
        self.words.update(zip(fresh, found, strict=True))

    @staticmethod
    def _beside(doc: list[tuple[bool, bytes]], at: int) -> tuple[int, int]:
        """The span of pieces around a join that has text on both sides, as far as the text goes."""
        lo = at - 1 if at < 2 or doc[at - 1][1].strip() else at - 2
        hi = at + 1 if at + 2 >= len(doc) or doc[at + 1][1].strip() else at + 2
        return max(0, lo), min(len(doc) - 1, hi)

    def _windows(self, doc: list[tuple[bool, bytes]]) -> Iterator[tuple[bytes, ...]]:
        """Each join with the words next to it."""
        for i, (core, data) in enumerate(doc):
            if not core:
                lo, hi = self._beside(doc, i)
                left = doc[lo][1].rsplit(None, 1)[-1:] if lo < i else []
                right = doc[hi][1].split(None, 1)[:1] if hi > i else []
                yield (*left, data, *right)

    def _check(self, windows: set[tuple[bytes, ...]]) -> None:
        """Encodes windows anew and notes whether they agree with their parts."""
        fresh = [w for w in windows if w not in self.joins]
        self._learn({part for w in fresh for part in w})
        words = self.words
        for w, whole in zip(fresh, self.plain([b" ".join(w).decode() for w in fresh]), strict=True):
            self.joins[w] = self._together([words[part] for part in w]) == whole
        self.counts["encoded_joins"] += len(fresh)

    def _grown(self, doc: list[tuple[bool, bytes]]) -> tuple[int, str, str]:
        """A text with joins that do not agree: spans grow over the cores beside them until all do."""
        spans: dict[bytes, tuple[int, str, str]] = {}
        at = 0
        while at < len(doc):
            lo, hi = self._beside(doc, at)
            beside = [d for _, d in doc[lo : hi + 1]]
            if doc[at][0] or self._together(self.plain([d.decode() for d in beside if d.strip()])) == self.plain([b"".join(beside).decode()])[0]:
                at += 1
                continue
            self.counts["grown_joins"] += 1
            span = b"".join(beside)
            spans[span] = self.plain([span.decode()])[0]
            doc = [*doc[:lo], (False, span), *doc[hi + 1 :]]
            at = max(0, lo - 2)
        return self._together([self.chunks[d] if core and d in self.chunks else spans.get(d) or self.plain([d.decode()])[0] for core, d in doc])

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        for store, most in ((self.words, self.most_words), (self.chunks, self.most_chunks), (self.joins, self.most_joins)):
            if len(store) > most:
                store.clear()
        words, chunks, counts = self.words, self.chunks, self.counts
        split = [pieces(folded(t.encode()), self.bits) if t else [] for t in texts]
        new_chunks: dict[bytes, list[bytes]] = {}
        met: set[bytes] = set()
        for doc in split:
            for core, data in doc:
                counts["cores"] += core
                if not core:
                    met.add(data)
                elif data not in chunks and data not in new_chunks:
                    new_chunks[data] = own = [] if self.units else data.split()
                    met.update(own)
        before = set(words)
        self._learn(met)
        counts["encoded_cores"] += len(new_chunks)
        if self.units:
            found = self.plain([d.decode() for d in new_chunks])
            self.silent = self.silent or not all(e[0] for e in found)
            chunks.update(zip(new_chunks, found, strict=True))
        else:
            self.silent = self.silent or not all(new_chunks.values())
            for data, own in new_chunks.items():
                chunks[data] = self._together([words[w] for w in own])
        windows = [list(self._windows(doc)) for doc in split]
        counts["joins"] += sum(map(len, windows))
        self._check({w for some in windows for w in some})
        agreed = self.joins
        out = [self._together([chunks[d] if core else words[d] for core, d in doc]) if all(agreed[w] for w in some) else self._grown(doc) for doc, some in zip(split, windows, strict=True)]
        for d in [d for d in set(words) - before if len(d) > 64]:  # long ones seldom come again
            del words[d]
        for d in [d for d in new_chunks if len(d) > 8192]:
            del chunks[d]
        return out


_encoders: dict[tuple, ChunkEncoder] = {}


def encode(docs: DataFrame, vocabulary: str, columns: tuple = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text", bits: int = 9) -> DataFrame:
    """Per row the id and any of n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    vocabulary: a path of the tokenizer's file that all executors can read. A decoder that does not
    join tokens by one space is refused, as chunks could not be put together then.
    """
    small_batches(docs.sparkSession, 500)
    fields = [pa.field("id", pa.int64()), *(pa.field(c, KINDS[c][0]) for c in columns)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, bits)
        if key not in _encoders:
            _encoders[key] = ChunkEncoder(vocabulary, bits)
            if _encoders[key].tokenizer.decoder is not None:
                raise ValueError("a vocabulary with a decoder of its own")
        enc = _encoders[key]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        make = {"n_tokens": lambda e: e[0], "ids": lambda e: list(map(int, e[1].split())), "decoded": lambda e: e[2], "ids_sha256": lambda e: sha(e[1]), "decoded_sha256": lambda e: sha(e[2])}
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            found = enc.encode(texts)
            cols = [ids.cast(pa.int64()), *(pa.array([make[c](e) for e in found], KINDS[c][0]) for c in columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(fields))

    schema = ", ".join(["id long", *(f"{c} {KINDS[c][1]}" for c in columns)])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
