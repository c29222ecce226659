"""Substring dedup: repeated word windows found from winnowed anchors.

Seed: a text's words are hashed; of every `window - gram + 1` neighbouring grams the least is an
anchor, so any two equal windows of `window` words hold the same anchor at the same place. Anchors
meet by hash, and those that occur once anywhere are dropped.

Extend: around each anchor that occurs again, every window whose own anchor it is, is hashed in
full (96 bits) and meets its equals the same way. Reaching both ways from the anchor this finds
each stretch of repeated windows, and their union is the maximal repeats over the threshold.

No pair of occurrences is formed, and no group is held whole. Before a shuffle each task resolves
what repeats within its own rows and sends one row for it; the others travel under keys of their
own, so a hot passage puts at most one row per task on its key. After the shuffle a task streams
over sorted rows and compares each with its neighbours.

Texts travel packed. Equal texts are one text with a number of copies; if there are several, every
window of it repeats. Windows are judged on the input, not on what is left of it. Null and empty
texts have no words. Texts shorter than the window lose nothing. Repeated rows and null ids give
one row each. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches

WINDOW, GRAM = 35, 9
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 4096, 2 * len(held[0]) if held else 0)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        held = _powers[base] = (out[0], out[1])
    return held


def rolled(h: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of every k neighbouring values."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _power(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down[:n], out=sums[1:])
    x = (sums[k:] - sums[:-k]) * up[k - 1 : n]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return hash_array(np.array(words, dtype=object), categorize=False)


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor, and the hashes of all grams."""
    g = rolled(h, gram)
    if len(h) < window:
        return np.empty(0, np.int64), g
    return sliding_window_view(g, window - gram + 1).argmin(axis=1) + np.arange(len(h) - window + 1), g


def covered(starts: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """Which of n words a window starting at one of the positions covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + window, -1)
    return np.cumsum(d[:-1]) > 0


CHUNK = 1 << 20


def collapse(w: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Resolves the keys (w, v) that repeat among these rows with references (a, b).

    The last array says what is known: 0 nothing, 1 that the key repeats, 2 the same of a row that
    is sent under a key of its own because another stands for it.
    """
    order = np.lexsort((v, w))
    w, v, a, b = w[order], v[order], a[order], b[order]
    same = np.zeros(len(w) + 1, bool)
    same[1:-1] = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    known = np.where(same[:-1], 2, np.where(same[1:], 1, 0)).astype(np.int32)
    away = known == 2
    mixed = (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(31)
    w[away], v[away] = mixed.view(np.int64)[away], -1
    return w, v, a, b, known


class _Keys:
    """Gathers keyed references of a task and sends them on collapsed."""

    schema = pa.schema([("w", pa.int64()), ("v", pa.int32()), ("a", pa.int64()), ("b", pa.int32()), ("known", pa.int32())])
    ddl = "w long, v int, a long, b int, known int"

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, w: np.ndarray, v: np.ndarray, a: int, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((w, v, np.full(len(w), a, np.int64), b))
        self.n += len(w)
        if self.n >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            cols = collapse(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
            whole = pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(cols, self.schema, strict=True)], schema=self.schema)
            for s in range(0, whole.num_rows, 50_000):
                yield whole.slice(s, 50_000)
        self.parts, self.n = [], 0


def repeating(keys: DataFrame) -> DataFrame:
    """The references (a, b) whose key occurs again. References below zero are only met, not returned."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, False
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            w, v, a, b, known = cols
            if not len(w):
                continue
            same = (w[1:] == w[:-1]) & (v[1:] == v[:-1])
            hit = known > 0
            hit[0] |= matched
            hit[1:] |= same
            hit[:-1] |= same
            held, matched = [c[-1:] for c in cols], bool(hit[-1])
            keep = hit[:-1] & (a[:-1] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[:-1][keep]), pa.array(b[:-1][keep])], ["a", "b"])
        if held is not None and matched and held[2][0] >= 0:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[3])], ["a", "b"])

    return keys.repartition("w").sortWithinPartitions("w", "v").mapInArrow(meet, "a long, b int")


def lost_texts(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, digest: bool) -> DataFrame:
    """One row for each text that loses words: its hashes k1 and k2, n_removed, and what is left as `kept` (its SHA-256 if digest)."""
    import zstandard

    small_batches(docs.sparkSession, 500)
    # Ids only lead to texts here: a number below zero or null is led to by the text's own hash.
    text, raw = F.col(text_col), F.col(id_col).cast("long")
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(3), text)
    ref = F.when(raw >= 0, raw).otherwise(F.shiftrightunsigned(k1, 1))
    rows = docs.where(text.isNotNull()).select(ref.alias("ref"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Keys()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = t.encode().split()
                if len(words) >= window:
                    at, g = anchors(word_hashes(words), window, gram)
                    p = np.unique(at)
                    yield from out.add(g[p].view(np.int64), np.zeros(len(p), np.int32), k, p.astype(np.int32))
        yield from out.flush()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            packed = pa.array([squeeze(t.encode()) for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["ref", "k1", "k2", "packed"])

    names = settle(rows.select("ref", "k1", "k2"), "repeat-names")
    per = settle(names.groupBy("k1", "k2").agg(F.min("ref").alias("least"), F.count("*").alias("copies")), "repeat-copies")
    firsts = names.join(per, ["k1", "k2"]).where("ref = least").select("ref", "k1", "k2", "copies").distinct()
    places = repeating(rows.select("ref", "text").mapInArrow(seeds, _Keys.ddl)).groupBy(F.col("a").alias("ref")).agg(F.collect_list("b").alias("ps"))
    places = settle(places.join(firsts, "ref"), "repeat-places")
    packed = rows.mapInArrow(pack, "ref long, k1 long, k2 long, packed binary")
    near = packed.join(places, ["ref", "k1", "k2"]).select(F.monotonically_increasing_id().alias("n"), "k1", "k2", "packed", "copies", "ps")
    near = settle(near, "repeat-texts")  # the numbers hold from here on, as they are read from the files

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, unpack = _Keys(), zstandard.ZstdDecompressor().decompress
        for b in batches:
            for n, t, c, ps in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                h = word_hashes(unpack(t).split())
                at, _ = anchors(h, window, gram)
                q = np.flatnonzero(np.isin(at, np.array(ps)))
                w, v = rolled(h, window)[q], (rolled(h, window, _BASES[1])[q] >> np.uint64(33)).astype(np.int32)
                if c > 1:  # all of it is lost, and all of it repeats
                    w, v, q = np.repeat(w, 2), np.repeat(v, 2), np.repeat(q, 2)
                yield from out.add(w.view(np.int64), v, -1 if c > 1 else n, q.astype(np.int32))
        yield from out.flush()

    hits = repeating(near.select("n", "packed", "copies", "ps").mapInArrow(extend, _Keys.ddl)).groupBy(F.col("a").alias("n")).agg(F.collect_list("b").alias("qs"))
    lost = near.select("n", "k1", "k2", "packed", "copies").join(hits, "n", "left").where("copies > 1 or qs is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            removed, kept = [], []
            for t, c, qs in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                words = unpack(t).split()
                left = [] if c > 1 else [w for w, g in zip(words, covered(np.array(qs), len(words), window).tolist(), strict=True) if not g]
                removed.append(len(words) - len(left))
                whole = b" ".join(left)
                kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["k1", "k2", "n_removed", "kept"])

    lost = lost.select("k1", "k2", "packed", "copies", "qs").mapInArrow(cut, "k1 long, k2 long, n_removed long, kept string")
    return settle(lost.dropDuplicates(["k1", "k2"]), "repeat-lost")


def _on_text(text_col: str) -> list:
    text = F.col(text_col)
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(3), text).alias("_k2")]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the words left as the text of those that lose some; the other texts stay as they are."""
    lost = lost_texts(docs, id_col, text_col, window, gram, False).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_kept"))
    rows = docs.select("*", *_on_text(text_col)).join(lost, ["_k1", "_k2"], "left")
    return rows.withColumn(text_col, F.coalesce("_kept", text_col)).select(*docs.columns)


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row the id, n_words, n_removed and kept_sha256. Only hashes of the texts are joined to what is lost."""
    lost = lost_texts(docs, id_col, text_col, window, gram, True).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [(t or "").encode().split() for t in b.column(3).to_pylist()]
            sha = pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(map(len, words)), pa.int64()), sha], ["id", "_k1", "_k2", "n_words", "sha"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_on_text(text_col), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(whole, "id long, _k1 long, _k2 long, n_words long, sha string")
    rows = rows.join(lost, ["_k1", "_k2"], "left")
    return rows.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
