"""Embedding near-duplicates by E8 lattice hashing.

Each table projects a unit vector onto random orthonormal directions, eight for each E8 block, and
decodes every block to its nearest lattice point. A table's cell is named by its points; besides
its own cell a vector enters the neighbouring cells reached by the next nearest point of a block.
Vectors that meet in a cell are compared by cosine in double precision. A pair that passes and
meets in several cells counts in the first of them only, so no pair is emitted: a cell gives each
vector's number of links and a spanning forest of them.

The scale is chosen for pairs right at a cosine of 0.95: such a pair meets in one table with a
chance of about 0.6, so six tables miss about one in 300; unrelated vectors meet with 0.001.

Equal vectors are reduced to one row with its number of copies. Crowded cells are dealt out as
tiles, pairs of parts of bounded size, so that no task holds a large group whole.

A vector that is null, has no component, is all zero or holds null or non-finite components links
with nothing. A null id is counted as a link by others but names no component unless all ids are
null. Repeated rows are vectors of their own and link with each other. Vectors of different
lengths are never compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Rows, runs, settle, small_batches

TABLES, BLOCKS, SCALE, PROBES, TILE, SEED = 6, 2, 1.35, 3, 2048, 5


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the next point of D8 (integers of even sum): arrays (2, n, 8), and their squared distances (2, n)."""
    r = np.rint(x)
    e = x - r
    order = np.argsort(-np.abs(e), axis=1)
    rows = np.arange(len(x))
    step = np.where(e >= 0, 1.0, -1.0)
    odd = (r.sum(axis=1) % 2) != 0

    def moved(*which: int) -> np.ndarray:
        y = r.copy()
        for k in which:
            y[rows, order[:, k]] += step[rows, order[:, k]]
        return y

    first = np.where(odd[:, None], moved(0), r)
    second = np.where(odd[:, None], moved(1), moved(0, 1))
    both = np.stack([first, second])
    return both, ((both - x) ** 2).sum(axis=2)


def e8_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four near points of E8 for each row, nearest first: doubled coordinates (n, 4, 8) as integers, and squared distances."""
    whole, dw = _d8(x)
    half, dh = _d8(x - 0.5)
    points = np.concatenate([2 * whole, 2 * half + 1]).astype(np.int64).transpose(1, 0, 2)
    dist = np.concatenate([dw, dh]).T
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(dist, order, axis=1)


_frames: dict[tuple, np.ndarray] = {}


def _frame(table: int, dim: int) -> np.ndarray:
    key = (table, dim)
    if key not in _frames:
        rng = np.random.Generator(np.random.PCG64([SEED, table, dim]))
        width = 8 * BLOCKS
        q = np.linalg.qr(rng.standard_normal((max(dim, width), width)))[0][:dim] if dim >= width else rng.standard_normal((dim, width)) / np.sqrt(width)
        _frames[key] = q * np.sqrt(dim / 8.0)
    return _frames[key]


def cells(unit: np.ndarray) -> np.ndarray:
    """Names of the cells of each unit vector: (n, TABLES, PROBES). A name's last three bits are its table."""
    n, dim = unit.shape
    mix = np.random.Generator(np.random.PCG64([SEED, 99])).integers(0, 2**63, (BLOCKS, 8), dtype=np.int64) * 2 + 1
    out = np.empty((n, TABLES, PROBES), np.int64)
    for t in range(TABLES):
        x = unit @ _frame(t, dim) * SCALE
        names, dist = [], []
        for b in range(BLOCKS):
            p, d = e8_points(x[:, 8 * b : 8 * b + 8])
            names.append((p * mix[b]).sum(axis=2))
            dist.append(d)
        # Own cell, then those that move one block to a next nearest point, the least farther first.
        home = sum(k[:, 0] for k in names)
        ways = [(names[b][:, k] - names[b][:, 0], dist[b][:, k] - dist[b][:, 0]) for b in range(BLOCKS) for k in (1, 2, 3)]
        shift, cost = np.stack([w[0] for w in ways], axis=1), np.stack([w[1] for w in ways], axis=1)
        near = np.argsort(cost, axis=1, kind="stable")[:, : PROBES - 1]
        all_ = np.concatenate([home[:, None], home[:, None] + np.take_along_axis(shift, near, axis=1)], axis=1)
        h = (all_ + np.int64(((t + 1) * 0x2545F4914F6CDD1D + dim) % 2**63)).view(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[:, t] = ((h ^ (h >> np.uint64(32))) & ~np.uint64(7) | np.uint64(t)).view(np.int64)
    return out


def _packed(vector: np.ndarray) -> bytes:
    """A vector's bytes, in single precision if that loses nothing. The first byte tells."""
    narrow = vector.astype("<f4")
    return b"4" + narrow.tobytes() if (narrow == vector).all() else b"8" + vector.astype("<f8").tobytes()


def _units(packed: list[bytes]) -> np.ndarray:
    """The unit vectors of packed ones of one length."""
    out = np.array([np.frombuffer(p, f"<f{p[:1].decode()}", offset=1) for p in packed], np.float64)
    return out / np.linalg.norm(out, axis=1)[:, None]


def cell_links(cell: int, unit: np.ndarray, part: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell with at least the threshold's cosine whose first common cell this is. cross: only pairs of different parts.

    Cells are named again for the vectors of such pairs only. First is the earliest table, and of a table's common cells the least.
    """
    found_i, found_j = [], []
    names = None
    for s in range(0, len(unit), 512):
        i, j = np.nonzero(unit[s : s + 512] @ unit.T >= threshold)
        i += s
        keep = (i < j) & ((part[i] != part[j]) | (not cross))
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        names = cells(unit) if names is None else names
        for k in range(0, len(i), 65_536):
            a, b = i[k : k + 65_536], j[k : k + 65_536]
            for t in range(cell & 7):
                apart = ~(names[a, t][:, :, None] == names[b, t][:, None, :]).any(axis=(1, 2))
                a, b = a[apart], b[apart]
            x, y = names[a, cell & 7], names[b, cell & 7]
            common = (x[:, :, None] == y[:, None, :]).any(axis=2)
            first = np.where(common, x, np.iinfo(np.int64).max).min(axis=1) == cell
            found_i.append(a[first])
            found_j.append(b[first])
    none = np.empty(0, np.int64)
    return (np.concatenate(found_i) if found_i else none), (np.concatenate(found_j) if found_j else none)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of pairs that make a spanning forest."""
    up, out = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            up[b] = a
            out.append(k)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row the id, n_links, component_id and kept."""
    spark = vectors.sparkSession
    small_batches(spark, 500)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.select("id", "v", sound.alias("sound"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    narrow = settle(rows.select("id", "sound", "h1", "h2"), "lattice-ids")
    reps = rows.where("sound").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = settle(reps, "lattice-vectors")

    # A vector's name from here on is its hash pair; h1 alone decides the part of a crowded cell.
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = pa.Table.from_batches([b]).drop_columns("v")
            packed = [_packed(np.array(x, np.float64)) for x in b.column("v").to_pylist()]
            size = np.array([(len(p) - 1) // int(p[:1]) for p in packed])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                vectors = [packed[k] for k in at]
                names = [np.unique(r) for r in cells(_units(vectors)).reshape(len(at), -1)]
                which = np.repeat(np.arange(len(at)), [len(r) for r in names])
                out = some.take(pa.array(at[which])).append_column("v", pa.array([vectors[k] for k in which], pa.binary()))
                yield from out.append_column("dim", pa.array(np.full(len(which), d, np.int32))).append_column("cell", pa.array(np.concatenate(names))).to_batches(max_chunksize=5000)

    base = reps.select("h1", "h2", "copies", "v").mapInArrow(spread, "h1 long, h2 long, copies long, v binary, dim int, cell long")
    sizes = settle(base.groupBy("cell").count().where("count > 1"), "lattice-cells")
    crowded = sizes.where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / F.lit(float(TILE))).cast("int").alias("parts"))
    few = crowded.count() <= 100_000
    rows = base.join(F.broadcast(crowded) if few else crowded, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("h1", "h2"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("cell", F.least("part", "other").alias("ta"), F.greatest("part", "other").alias("tb"), "dim", "part", "h1", "h2", "copies", "v")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "cell", "ta", "tb").sortWithinPartitions("cell", "ta", "tb", "dim")
    schema = pa.schema([("kind", pa.int32()), ("a1", pa.int64()), ("a2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for t in runs(batches, ["cell", "ta", "tb", "dim"], 2):
            cross = t["ta"][0].as_py() != t["tb"][0].as_py()
            h1, h2, copies, part = (t[c].to_numpy() for c in ("h1", "h2", "copies", "part"))
            i, j = cell_links(t["cell"][0].as_py(), _units(t["v"].to_pylist()), part, cross, threshold)
            if not len(i):
                continue
            k = _forest(t.num_rows, i, j)
            count = np.bincount(i, copies[j], len(h1)) + np.bincount(j, copies[i], len(h1))
            m = np.flatnonzero(count)
            yield from out.add(np.zeros(len(m), np.int32), h1[m], h2[m], count[m].astype(np.int64), np.zeros(len(m), np.int64))
            a, b = i[k], j[k]
            yield from out.add(np.ones(len(a), np.int32), h1[a], h2[a], h1[b], h2[b])
        yield from out.flush()

    found = settle(rows.mapInArrow(meet, "kind int, a1 long, a2 long, b1 long, b2 long"), "lattice-found")
    counts = found.where("kind = 0").groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("b1").alias("linked"))
    pairs = found.where("kind = 1").select(F.struct(F.col("a1").alias("x"), F.col("a2").alias("y")).alias("a"), F.struct(F.col("b1").alias("x"), F.col("b2").alias("y")).alias("b"))
    parts = components(pairs).select(F.col("node.x").alias("h1"), F.col("node.y").alias("h2"), F.col("component").alias("c"))
    least = reps.select("h1", "h2", "least", "copies")
    inside = parts.join(least, ["h1", "h2"])
    names = inside.groupBy("c").agg(F.min("least").alias("name"))
    named = inside.join(names, "c").select("h1", "h2", "name")
    whole = least.join(counts, ["h1", "h2"], "left").join(named, ["h1", "h2"], "left")
    whole = settle(whole.select("h1", "h2", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "least").alias("component_id")), "lattice-whole")
    # Vectors with many copies are looked up apart, where their list is short enough to send: one copy of each goes to every task.
    many = whole.where(F.col("copies") > TILE)
    many = F.broadcast(many) if many.count() <= 100_000 else many
    sound = narrow.where("sound")
    columns = ("id", "n_links", "component_id")
    often = sound.join(many, ["h1", "h2"]).select(*columns)
    seldom = sound.join(many.select("h1", "h2"), ["h1", "h2"], "left_anti").join(whole.where(F.col("copies") <= TILE), ["h1", "h2"]).select(*columns)
    sound = often.union(seldom)
    rest = narrow.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = sound.union(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
