"""Periodic runs of words: stretches that go on repeating their first q words.

A run is a stretch of consecutive words of smallest period q, at least two periods and `least` words
long, that no neighbouring word extends at that period. Every run holds a Lyndon root of one of two
orders of the words, one being the other reversed, and that root is the longest Lyndon word at its
place. Phase one of Baier's suffix sorter groups positions by exactly these words, so it is run once
for each order and stopped there: the roots it leaves are extended to both sides by longest common
extensions (ranks of blocks of 2^k words), and those that reach two periods are the runs.

Only parts of a text can hold runs: the first length - q words of a run come again q words later, and
these are at least least / 2, so each word of a run lies in a sequence of least / 2 words that the run
has twice. Parts are found by hashed sequences over a whole batch; a collision only adds to them.

Each document is judged by itself, in time n log n of its words, whatever other documents hold: there
is no shuffle, and a lost executor costs its tasks only. Null and empty texts have no words and no
runs; repeated rows are judged alike; null ids stay null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

Words = list[bytes]


def longest_lyndon(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position: suffixes grouped as in phase one of Baier's sorter.

    Groups lie in `order` by rank, each as an interval that is known by its head. From the highest
    group down, each member lengthens the Lyndon word of the nearest earlier position of a lower
    group by its own; positions lengthened equally often leave their group for one just above it.
    """
    n = len(word)
    order = sorted(range(n), key=word.__getitem__)
    place, head, size = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if word[i] != word[order[first]]:
            first = k
        place[i], head[i] = k, first
        size[first] += 1
    length = [1] * n
    lower = list(range(n + 1))  # lower[i + 1] - 1: where to look for the nearest position up to i whose group is still to come
    end = n
    while end:
        start = head[order[end - 1]]
        members = order[start:end]
        end = start
        for i in members:
            lower[i + 1] = i
        reached: dict[int, tuple[int, int]] = {}
        for i in members:
            j = i
            while lower[j] != j:
                lower[j] = j = lower[lower[j]]
            if j:
                times, last = reached.get(j - 1, (0, 0))
                reached[j - 1] = (times + 1, i if i > last else last)
        rounds: dict[int, list[int]] = {}
        for j, (times, last) in reached.items():
            length[j] = last + length[last] - j
            rounds.setdefault(times, []).append(j)
        for times in sorted(rounds, reverse=True):
            leaving: dict[int, int] = {}
            for j in rounds[times]:
                h = head[j]
                gone = leaving.get(h, 0)
                slot, at = h + size[h] - 1 - gone, place[j]
                other = order[slot]
                order[slot], order[at], place[j], place[other] = j, other, slot, at
                leaving[h] = gone + 1
            for h, gone in leaving.items():
                size[h] -= gone
                new = h + size[h]
                size[new] = gone
                for k in range(new, new + gone):
                    head[order[k]] = new
    return length


class Extensions:
    """Longest common extensions of pairs of positions, by ranks of all blocks of 2^k symbols."""

    def __init__(self, word: np.ndarray):
        self.n, self.ranks = len(word), [word]
        while (step := 1 << (len(self.ranks) - 1)) * 2 <= self.n:
            r = self.ranks[-1]
            pairs = r[:-step].astype(np.int64) * (int(r.max()) + 1) + r[step:]
            found, r = np.unique(pairs, return_inverse=True)
            if len(found) == len(pairs):  # no block of this length comes twice
                break
            self.ranks.append(r.astype(np.int64))

    def _extend(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            r, step = self.ranks[k], 1 << k
            x, y = (a - far - step + 1, b - far - step + 1) if back else (a + far, b + far)
            inside = np.flatnonzero((x >= 0) & (y < len(r)) & (y >= 0) & (x < len(r)))
            same = inside[r[x[inside]] == r[y[inside]]]
            far[same] += step
        return far

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a and b on are equal."""
        return self._extend(a, b, False)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols up to a and b, these included, are equal."""
        return self._extend(a, b, True)


def runs_of(word: np.ndarray, least: int = 12) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of symbols 0, 1, ..., by start, then period."""
    n = len(word)
    found = [np.empty((0, 3), np.int64)]
    extensions = Extensions(word) if n >= 2 else None
    for symbols in (word, -word) if n >= 2 else ():
        period = np.array(longest_lyndon(symbols.tolist()), np.int64)
        at = np.arange(n)
        nxt = at + period
        more = (word[at] == word[np.minimum(nxt, n - 1)]) & (nxt < n)
        more[1:] |= word[at[:-1]] == word[nxt[1:] - 1]
        at, nxt, period = at[more], nxt[more], period[more]
        before = extensions.backward(at - 1, nxt - 1)
        length = period + extensions.forward(at, nxt) + before
        run = length >= np.maximum(2 * period, least)
        found.append(np.stack([at - before, length, period], 1)[run])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _repeating(hashes: np.ndarray, part: np.ndarray, gram: int) -> np.ndarray:
    """Whether each word lies in a sequence of `gram` words that its part has twice. part: ascending numbers."""
    n = len(hashes) - gram + 1
    covered = np.zeros(len(hashes), bool)
    if n < 2:
        return covered
    with np.errstate(over="ignore"):
        h = part[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(gram):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    inside = np.flatnonzero(part[:n] == part[gram - 1 :])
    h = h[inside]
    turn = np.argsort(h)
    same = h[turn[1:]] == h[turn[:-1]]
    twice = np.zeros(len(h), bool)
    twice[turn[1:][same]] = twice[turn[:-1][same]] = True
    starts = inside[twice]
    for k in range(gram):
        covered[starts + k] = True
    return covered


def parts_with_repeats(texts: list[Words], least: int = 12) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of the stretches that can hold runs."""
    gram = (least + 1) // 2
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    hashes = np.fromiter((hash(x) for w in texts for x in w), np.int64, total).view(np.uint64)
    place, part = np.arange(total), np.repeat(np.arange(len(texts)), sizes)
    while len(place):
        keep = _repeating(hashes, part, gram)
        new = np.ones(len(place), bool)
        new[1:] = (part[1:] != part[:-1]) | ~keep[:-1]
        place, hashes, number = place[keep], hashes[keep], np.cumsum(new)[keep]
        same = len(keep) == len(place)
        part = number
        if same:  # all that is left repeats within its own part
            break
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(place)).tolist(), strict=True):
        if hi - lo >= least:
            text = int(np.searchsorted(ends, place[lo], "right"))
            base = int(ends[text] - sizes[text])
            yield text, int(place[lo]) - base, int(place[hi - 1]) + 1 - base


def runs_of_texts(texts: list[Words], least: int = 12) -> list[np.ndarray]:
    """The runs of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for k, lo, hi in parts_with_repeats(texts, least):
        number: dict[bytes, int] = {}
        rows = runs_of(np.array([number.setdefault(w, len(number)) for w in texts[k][lo:hi]], np.int64), least)
        rows[:, 0] += lo
        out[k].append(rows)
    return [np.concatenate(x) if x else np.empty((0, 3), np.int64) for x in out]


def collapsed(words: Words, runs: np.ndarray) -> bytes:
    """The words joined by one space, less those that any run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs.tolist():
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def with_periodic_tail(doc_id: int | None, words: Words) -> Words:
    """Of one document in ten, by the CRC-32 of its decimal id, the words from some place on, made periodic; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    g, ten = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if ten:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _list_of(run: np.ndarray) -> list[dict]:
    return [dict(zip(("start", "length", "period"), r, strict=True)) for r in run.tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Output columns: Arrow type, Spark type, and what each makes of a document's words and runs and its greatest run.
COLUMNS: dict[str, tuple[pa.DataType, str, Callable]] = {
    "n_runs": (pa.int64(), "long", lambda w, r, top: len(r)),
    "start": (pa.int64(), "long", lambda w, r, top: top and top[0]),
    "length": (pa.int64(), "long", lambda w, r, top: top and top[1]),
    "period": (pa.int64(), "long", lambda w, r, top: top and top[2]),
    "exponent_milli": (pa.int64(), "long", lambda w, r, top: top and 1000 * top[1] // top[2]),
    "runs": (pa.list_(_RUN), "array<struct<start:long,length:long,period:long>>", lambda w, r, top: _list_of(r)),
    "collapsed": (pa.string(), "string", lambda w, r, top: collapsed(w, r).decode()),
    "runs_sha256": (pa.string(), "string", lambda w, r, top: hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in r.tolist()).encode()).hexdigest()),
    "collapsed_sha256": (pa.string(), "string", lambda w, r, top: hashlib.sha256(collapsed(w, r)).hexdigest()),
}


def find_runs(docs: DataFrame, columns: tuple = ("n_runs", "runs", "collapsed"), least: int = 12, edit: Callable[[int | None, Words], Words] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and any of COLUMNS; start, length, period and exponent_milli are the greatest run's (ties: the first, then of the smallest period), null without runs.

    edit changes the words of a document before runs are sought. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession, 500)
    schema = pa.schema([("id", pa.int64()), *((c, COLUMNS[c][0]) for c in columns)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            words = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            if edit:
                words = [edit(i, w) for i, w in zip(ids, words, strict=True)]
            out: list[list] = [[] for _ in columns]
            for w, r in zip(words, runs_of_texts(words, least), strict=True):
                top = max(r.tolist(), key=lambda x: (x[1], -x[0], -x[2]), default=None)
                for have, c in zip(out, columns, strict=True):
                    have.append(COLUMNS[c][2](w, r, top))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, COLUMNS[c][0]) for x, c in zip(out, columns, strict=True))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, ", ".join(["id long", *(f"{c} {COLUMNS[c][1]}" for c in columns)])).withColumnRenamed("id", id_col)
