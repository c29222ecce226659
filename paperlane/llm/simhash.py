"""SimHash near-duplicates: fingerprints linked through BK-trees of bounded shards.

A fingerprint has 64 bits. Two that differ in at most three bits agree on one of four blocks of 16,
so each distinct fingerprint goes to four shards named by (half of) its blocks, and the links inside
the shards are all there are. In a shard a BK-tree is grown: a child is keyed by its Hamming distance
to the parent, and a search follows only the edges within the radius of the distance. A tree's
shard is sent to the one task that searches it rather than to every task, as all shards together
grow with the data. A shard of more than CROWDED fingerprints is split on the whole block, and
again on parts of the other bits, by the same argument; the tables of crowded shards have at most
4 * 256 and 4 * 65,536 rows.

Equal texts share a fingerprint and are reduced to one row first. A shard gives only the links of
its spanning forest; components are found on the distributed links.

Null and empty texts have fingerprint zero and link like any other. A null id is a member of its
component but never its name, unless all ids are null. Repeated rows stay. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Rows, discard, settle, small_batches

SEED, RADIUS, CROWDED = 42, 3, 2000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The text's fingerprint, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(whole)
    return majority(np.array([digest(view[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp), fp as a signed long."""
    small_batches(docs.sparkSession, 500)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, "id long, fp long")


class BKTree:
    """A tree of fingerprints, searched by Hamming distance."""

    __slots__ = ("values", "children")

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        k = len(self.values)
        self.values.append(x)
        self.children.append({})
        at = 0
        while k:
            d = (self.values[at] ^ x).bit_count()
            nxt = self.children[at].setdefault(d, k)
            if nxt == k:
                return
            at = nxt

    def near(self, x: int, radius: int) -> Iterator[int]:
        """Positions of the values within the radius."""
        todo = [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ x).bit_count()
            if d <= radius:
                yield at
            for key, child in children[at].items():
                if -radius <= key - d <= radius:
                    todo.append(child)


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    tree, up, out, groups = BKTree(), [], [], 0

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for k, x in enumerate(values):
        up.append(k)
        groups += 1
        for j in tree.near(x, radius):
            a, b = top(j), top(k)
            if a != b:
                up[b] = a
                out.append((x, values[j]))
                groups -= 1
                if groups == 1:  # nothing is left to join
                    break
        tree.add(x)
    return out


def _block(b: int) -> str:
    return f"(shiftrightunsigned(fp, {16 * b}) & 65535L)"


def _rest(b: int) -> str:
    """The 48 bits outside block b."""
    low = f"(fp & {(1 << 16 * b) - 1}L)"
    return low if b == 3 else f"(shiftleft(shiftrightunsigned(fp, {16 * b + 16}), {16 * b}) | {low})"


def _deep(b: int) -> list[str]:
    """Of two that agree on block b and differ in at most three of the other bits: 16 keys, one of which they share."""
    out = []
    for j in range(4):
        twelve = f"(shiftrightunsigned({_rest(b)}, {12 * j}) & 4095L)"
        low = f"({_rest(b)} & {(1 << 12 * j) - 1}L)"
        left = low if j == 3 else f"(shiftleft(shiftrightunsigned({_rest(b)}, {12 * j + 12}), {12 * j}) | {low})"
        out += [f"shiftleft({b * 16 + j * 4 + k}L + 64, 37) | shiftleft({_block(b)}, 21) | shiftleft({twelve}, 9) | (shiftrightunsigned({left}, {9 * k}) & 511L)" for k in range(4)]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp), enough to connect all that lie within RADIUS."""
    spark = distinct.sparkSession
    by_block = lambda make: "CASE b " + " ".join(f"WHEN {b} THEN {make(b)}" for b in range(4)) + " END"

    def crowded(rows: DataFrame) -> DataFrame:
        """Rows with `crowded` set where their shard is too large. The list has at most as many rows as four blocks have values."""
        large = settle(rows.groupBy("shard").count().where(F.col("count") > CROWDED).select("shard", F.lit(True).alias("crowded")), "simhash-crowded")
        return rows.join(F.broadcast(large), "shard", "left")

    # Shards by half a block first, as numbers below zero; by the whole block; by the block and parts of the rest.
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"))
    rows = crowded(rows.withColumn("shard", F.expr(by_block(lambda b: f"-1L - (shiftleft({b}L, 8) | shiftrightunsigned({_block(b)}, 8))"))))
    rows = rows.select("fp", "b", F.when(F.col("crowded"), F.expr(by_block(lambda b: f"shiftleft({b}L, 16) | {_block(b)}"))).otherwise(F.col("shard")).alias("shard"))
    halves, blocks = rows.where("shard < 0"), crowded(rows.where("shard >= 0"))
    deep = F.when(F.col("crowded"), F.expr(by_block(lambda b: f"array({', '.join(_deep(b))})"))).otherwise(F.array("shard"))
    rows = halves.select("fp", "shard").union(blocks.select("fp", F.explode(deep).alias("shard")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "shard").sortWithinPartitions("shard")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def ended(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, int)
            sizes = np.diff(np.append(starts, len(key)))
            for s, m in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                found = shard_links(np.sort(fp[s : s + m].view(np.uint64)).tolist())
                if found:
                    pairs = np.array(found, np.uint64).view(np.int64)
                    yield from out.add(pairs[:, 0], pairs[:, 1])

        for b in batches:
            key = np.concatenate([key, b.column("shard").to_numpy()])
            fp = np.concatenate([fp, b.column("fp").to_numpy()])
            if len(key):
                whole = int(np.searchsorted(key, key[-1]))  # the last shard may go on
                yield from ended(key[:whole], fp[:whole])
                key, fp = key[whole:], fp[whole:]
        yield from ended(key, fp)
        yield from out.flush()

    return rows.select("shard", "fp").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id, fp (signed) and component_id: the smallest id among the documents reachable by links."""
    rows = settle(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    distinct = settle(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    return _named(rows, distinct, links(distinct.select("fp")), id_col)


def _named(rows: DataFrame, distinct: DataFrame, met: DataFrame, id_col: str) -> DataFrame:
    """From rows (id, fp), distinct (fp, least) and links of fingerprints: id, fp and component_id."""
    parts = settle(components(met), "simhash-parts")
    inside = parts.join(distinct, parts["node"] == distinct["fp"]).select("fp", "component", "least")
    names = inside.groupBy("component").agg(F.min("least").alias("name"))
    named = settle(inside.join(names, "component").select("fp", "name"), "simhash-named")
    whole = settle(distinct.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "simhash-names")
    return rows.join(whole, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Bytes of a shingle's hash in sets and keys; bits of a set's mask; documents sampled for how common shingles are, and so many counts are kept at most.
HASH, MASK, SAMPLE, COMMON, CHUNK = 6, 1024, 49_152, 400_000, 1 << 20


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The 64-bit hashes of the text's shingles, repeats included. A text of fewer words is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(whole))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        spans = zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True)
    digest, view = xxhash.xxh64_intdigest, memoryview(whole)
    return np.array([digest(view[a:b], SEED) for a, b in spans], np.uint64)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The hashes' leading 48 bits, sorted, each once."""
    return np.unique(hashes >> np.uint64(64 - 8 * HASH)).view(np.int64)


def pack_set(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :HASH]).tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // HASH, 8), np.uint8)
    out[:, :HASH] = np.frombuffer(packed, np.uint8).reshape(-1, HASH)
    return out.view("<i8").reshape(-1)


def mask(values: np.ndarray) -> bytes:
    """The parity of the set's members on each of MASK places: two sets differ in at least as many members as their masks in bits."""
    return np.packbits(np.bincount(values % MASK, minlength=MASK) & 1 == 1).tobytes()


def folded_mask(packed: bytes) -> np.ndarray:
    """The mask on a quarter of its places, as four numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(packed, "<i8").reshape(4, -1), axis=0)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three different texts of a sample share, sorted, and in how many. It sets the order of shingles only, so any sample is right.

    A passage in a given part of the documents is known as common at any size of the table, so
    that pairs of documents that only share it are not compared.
    """
    n = docs.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingle_hashes(t, shingle)))], ["token"])

    part = docs.sample(min(1.0, SAMPLE / max(1, n)), 17).dropDuplicates(["th"]).select("text")
    found = part.mapInArrow(work, "token long").groupBy("token").count().where("count >= 3").orderBy(F.desc("count"), "token").limit(COMMON).orderBy("token").toArrow()
    return found["token"].to_numpy().copy(), found["count"].to_numpy().copy()


def _named_sets(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (id, th, set, fp, n, core, m0 to m3, mask, prefix) of documents (id, th, text): set names the set of n shingles, fp is the text's fingerprint, m0 to m3 are the folded mask.

    core is the mean of log2(1 + count) over the set's shingles, in thousandths, by the sample's counts: the
    member of a group of near copies that differs least from the others has the greatest. prefix has the shingles that come first, rare ones before common ones: two sets as similar as
    wanted share one of them. It, core and the mask are null where the task has given them with an earlier row.
    """
    tokens, counts = _common(docs, shingle)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            names, fps, sizes, cores, masks, short, prefixes = [], [], [], [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, shingle)
                s = shingle_set(h)
                name = xxhash.xxh64_intdigest(pack_set(s), SEED)
                new = name not in seen
                if new:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(name)
                    rank = np.zeros(len(s), np.int64)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        rank = np.where(tokens[at] == s, counts[at], 0)
                    most = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
                names.append(name)
                fps.append(majority(h))
                sizes.append(len(s))
                bits = mask(s)
                short.append(folded_mask(bits))
                cores.append(int(1000 * np.log2(1 + rank).mean()) if new and len(s) else 0 if new else None)
                masks.append(bits if new else None)
                prefixes.append(s[np.lexsort((s, rank))[:most]] if new else None)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            short = np.array(short, np.int64).reshape(-1, 4)
            cols = [b.column(0), b.column(1), signed(names), signed(fps), pa.array(sizes, pa.int64()), pa.array(cores, pa.int64()), *[pa.array(short[:, k].copy()) for k in range(4)], pa.array(masks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "th", "set", "fp", "n", "core", "m0", "m1", "m2", "m3", "mask", "prefix"])

    return docs.mapInArrow(work, "id long, th long, set long, fp long, n long, core long, m0 long, m1 long, m2 long, m3 long, mask binary, prefix array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Places (token, set, n, core, pos) of those shingles of the prefixes that come in other rows as well.

    What a task finds repeated among its own places is known already: one place stands for it under
    the shingle's key, the others travel under keys of their own. A hot shingle so puts one row for
    each CHUNK places on its key.
    """
    fields = pa.schema([(c, pa.int64()) for c in ("key", "token", "set", "n", "core", "pos")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list) -> Iterator[pa.RecordBatch]:
            token, name, n, core, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            token, name, n, core, pos = token[order], name[order], n[order], core[order], pos[order]
            same = np.append(False, token[1:] == token[:-1])
            known = same | np.append(same[1:], False)
            mixed = (name.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (token.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            key = np.where(same, -1 - (mixed >> np.uint64(1)).view(np.int64), token)  # shingles are never below zero
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, token, name, n, core, 2 * pos + known)], schema=fields)
            for s in range(0, whole.num_rows, 50_000):
                yield whole.slice(s, 50_000)

        parts, held = [], 0
        for b in batches:
            lists = b.column(3)
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            first = np.cumsum(size) - size
            pos = np.arange(len(token)) - np.repeat(first, size)
            parts.append((token, *(np.repeat(b.column(k).to_numpy(), size) for k in range(3)), pos))
            held += len(token)
            if held >= CHUNK:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, False
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            key, token, name, n, core, pos = cols
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            hit = pos & 1 == 1
            hit[0] |= matched
            hit[1:] |= same
            hit[:-1] |= same
            held, matched = [c[-1:] for c in cols], bool(hit[-1])
            keep = hit[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep]) for c in (token, name, n, core, pos >> 1)], ["token", "set", "n", "core", "pos"])
        if held is not None and matched:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*held[1:5], held[5] >> 1)], ["token", "set", "n", "core", "pos"])

    posts = rows.where("prefix is not null").select("set", "n", "core", "prefix").mapInArrow(spread, "key long, token long, set long, n long, core long, pos long")
    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "token long, set long, n long, core long, pos long")


def _merged(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """A join of two tables that both grow with the documents: by shuffle at any size."""
    return a.join(b.hint("merge"), on)


def _verified(pairs: DataFrame, rows: DataFrame, distinct: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of sets whose Jaccard similarity is as high as wanted.

    The masks of two sets bound how much they differ, so most pairs end there. For the others the
    sets are made again, from the texts that have them: distinct names one (th) for each set, so that
    copies are not dealt by their set.
    """
    both = lambda pairs, table, c: _merged(_merged(pairs, table.select(F.col("set").alias("a"), F.col(c).alias("x")), "a"), table.select(F.col("set").alias("b"), F.col(c).alias("y")), "b").select("a", "b", "x", "y")
    nodes = lambda pairs: pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    masks = rows.where("mask is not null").select("set", F.struct("n", "mask").alias("m")).join(nodes(pairs), "set", "left_semi").groupBy("set").agg(F.min("m").alias("m"))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2), b.column(3)
            bits = [np.frombuffer(b"".join(c.field("mask").to_pylist()), np.uint64).reshape(-1, MASK // 64) for c in (x, y)]
            n = x.field("n").to_numpy() + y.field("n").to_numpy()
            keep = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1) <= n * (1 - similarity) / (1 + similarity) + 1e-6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = settle(both(pairs, settle(masks, "similar-masks"), "m").mapInArrow(may, "a long, b long"), "similar-left")
    held = distinct.select("set", "th").join(nodes(left), "set", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack_set(shingle_set(shingle_hashes(t, shingle))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["set", "packed"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = unpack_set(x.as_py()), unpack_set(y.as_py())
                z = np.concatenate([x, y])
                z.sort()
                shared = int((z[1:] == z[:-1]).sum())
                keep.append(shared / max(1, len(z) - shared) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = texts.select("th", "text").join(settle(held, "similar-held"), "th").groupBy("set").agg(F.min("text").alias("text"))
    sets = settle(first.mapInArrow(make, "set long, packed binary"), "similar-sets")
    return both(left, sets, "packed").mapInArrow(same, "a long, b long")


def _similar(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, th, set), distinct sets (set, least) and links of sets that connect all pairs as similar as wanted.

    All pairs that are proposed are compared on whole sets. The BK-trees propose texts of near
    fingerprints. Each set that shares a shingle of its prefix with others is compared with two that
    have it, the one whose shingles are the most common and the one of the greatest name, so that
    large groups are linked without all their pairs: near copies of one text differ more from each
    other than from the one that differs least from it. Then all pairs that share a shingle and are still apart are compared: two sets as similar as wanted
    share one, so none is missed.
    """
    small_batches(docs.sparkSession, 500)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = settle(_named_sets(texts, shingle, similarity), "similar-rows")
    distinct = settle(rows.groupBy("set").agg(F.min("id").alias("least"), F.min("th").alias("th")), "similar-distinct")
    verify = lambda pairs: settle(_verified(pairs, rows, distinct, texts, shingle, similarity), "similar-links")

    first = settle(rows.groupBy("fp").agg(F.min("set").alias("first")), "similar-fingerprints")
    same = rows.join(first, "fp").where("set <> first").select(F.least("first", "set").alias("a"), F.greatest("first", "set").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    met = settle(_shared(rows).distinct(), "similar-met")
    # What is left behind the first shingle shared bounds what two sets can share.
    may = F.expr(f"{1 + similarity!r} * least(n - pos, n2 - pos2) >= {similarity!r} * (n + n2) - 1e-6")
    pair = (F.least("set", "set2").alias("a"), F.greatest("set", "set2").alias("b"))
    named2 = lambda d: d.select("token", *[F.col(c).alias(f"{c}2") for c in d.columns if c != "token"])
    central = F.expr("max_by(set, shiftleft(core, 40) | (set & 1099511627775))")  # ties by the set's low bits
    ends = met.groupBy("token").agg(central.alias("central"), F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo < hi")
    ends = settle(ends.select("token", "central", "hi"), "similar-ends")
    some = settle(_merged(met, ends, "token"), "similar-some")
    tips = named2(some.where("set = central or set = hi").select("token", "set", "n", "pos"))
    tips = _merged(some, tips, "token").where("set <> set2").where(may).select(*pair)
    tried = settle(tips.union(same).union(near.select(F.least("x", "y"), F.greatest("x", "y"))).distinct(), "similar-tried")
    found = verify(tried)

    parts = settle(components(found), "similar-parts")
    tagged = some.join(parts, F.col("set") == F.col("node"), "left").select("token", "set", "n", "pos", F.coalesce("component", "set").alias("group"))
    tagged = settle(tagged, "similar-tagged")
    several = settle(tagged.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g < h").select("token"), "similar-several")
    masks = rows.groupBy("set").agg(*[F.min(m).alias(m) for m in ("m0", "m1", "m2", "m3")])
    apart = settle(_merged(_merged(tagged, several, "token"), masks, "set"), "similar-apart")
    differ = F.expr(" + ".join(f"bit_count(m{k} ^ m{k}2)" for k in range(4)) + f" <= {(1 - similarity) / (1 + similarity)!r} * (n + n2) + 1e-6")
    rest = _merged(apart, named2(apart), "token").where("group < group2").where(may).where(differ).select(*pair).distinct().join(tried, ["a", "b"], "left_anti")
    rest = settle(rest, "similar-rest")
    links_ = settle(found.union(verify(rest)), "similar-links")
    discard(met, ends, some, parts, tagged, several, apart)
    return rows.select("id", "th", "set"), distinct.select("set", "least"), links_


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and component_id: the smallest id among the documents reachable by pairs of this Jaccard similarity of shingles or more."""
    rows, distinct, met = _similar(docs, shingle, similarity, id_col, text_col)
    return _named(rows.select("id", F.col("set").alias("fp")), distinct.withColumnRenamed("set", "fp"), met, id_col).select(id_col, "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar documents: that of the smallest id, null being the greatest, of repeated ids the first by the text's hash.

    All texts without words are one group. An empty table gives an empty one. Other columns pass through.
    """
    rows, _, met = _similar(docs, shingle, similarity, id_col, text_col)
    parts = settle(components(met), "similar-parts")
    keys = rows.groupBy("id", "th", "set").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "n")).alias("w")
    first = keys.join(parts, F.col("set") == F.col("node"), "left").groupBy(F.coalesce("component", "set").alias("group")).agg(least)
    first = settle(first.select(F.col("w.id").alias("_id"), F.col("w.th").alias("_th"), F.col("w.n").alias("_n")), "similar-first")
    kept = docs.join(first, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_th")))
    if not first.where("_n > 1").limit(1).count():
        return kept.select(*docs.columns)
    again = kept.where("_n > 1").groupBy("_id", "_th").agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return kept.where("_n = 1").select(*docs.columns).unionByName(again)
