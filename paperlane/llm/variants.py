"""Spelling variants: words of the corpus one edit apart, and for each the frequent word it is a form of.

Two words of one edit (a code point inserted, deleted or replaced) agree before and after it: of the
m code points of the shorter one, the longer of the two common ends has at least half of m - 1. So
each word goes to the block of its first half and to that of its last half, once as one of equal
length and once as the longer one, and near words meet in a block. A block that is crowded is halved
again at both sides of what its words do not share, until it is not; when nothing is left to halve,
the alphabet bounds it.

Within a block the rest of the words is a sorted list, scanned by dynamic programming: the row of the
edit matrix of a word and a prefix, of which a band of three cells can be 1 or less, is computed once
for all words in the range that shares the prefix (adjacent words that have it in common), from the
row of the prefix one shorter; where all three cells exceed one edit, the range is skipped whole. The
scan goes one code point deeper at a time for all words of many blocks, so rows are arrays.

Counts are added up per task before they are shuffled. Vocabulary and links are tables; nothing goes
to the driver. Null and empty texts have no words, rows that repeat count again, a null id deletes
nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Rows, discard, runs, settle, small_batches

#: Letters as bytes of ISO 8859-1, where a code point is a byte: whatever that lacks becomes a question mark, no letter.
LETTERS = rb"[A-Za-z\xC0-\xFF]"
#: Words counted in a task before it hands them on.
MOST_WORDS = 200_000
#: Blocks of more words are halved again.
CROWDED = 50_000
#: Words sought at once in the blocks of a task.
QUERIES = 20_000

Edit = Callable[[int | None, bytes], bytes]


def one_letter_lost(doc_id: int | None, word: bytes, prefix_crc: int, one_in: int = 199) -> bytes:
    """Deletes a letter where the CRC-32 of `<id>:<word>` says so. prefix_crc: of `<id>:`. word is ISO 8859-1."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix_crc)
    if doc_id is None or h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5, lose: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters of the whole texts, lower-cased from A to Z, of at least `shortest` code points and `least` occurrences.

    lose: one in so many has a letter deleted, see one_letter_lost.
    """
    small_batches(docs.sparkSession, 500)
    # A maximal run that is long enough is found whole; shorter ones cannot become words.
    find = re.compile(LETTERS + b"{%d,}" % shortest).findall
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], schema=schema)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                found = Counter(find(t.encode("latin-1", "replace").lower()))
                prefix = zlib.crc32(b"%d:" % i) if i is not None else 0
                for w, n in found.items():
                    if lose and i is not None:
                        w = one_letter_lost(i, w, prefix, lose)
                        if len(w) < shortest:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) >= MOST_WORDS:
                    yield handed()
                    held.clear()
        yield handed()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Rows (m, p, s, word, n), which share p first and s last code points with their block, at both sides halved once more."""
    half = F.ceil((F.col("m") - F.col("p") - F.col("s") - 1) / 2).cast("int")
    sides = F.array(F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s")))
    return rows.withColumn("side", F.explode(sides)).select("m", "side.p", "side.s", "word", "n")


def _block() -> Column:
    """What the words of a block share; ':' is no letter."""
    return F.concat_ws(":", "m", "p", "s", F.expr("substring(word, 1, p)"), F.expr("right(word, s)"))


def one_edit(rest: list[bytes], block: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of list places whose rests are one edit apart, i being asked and in the block of j.

    rest: of the list's words, sorted by block, then by rest. The state of the scan is a row for each
    word asked and each range of the list it has not skipped: the range, and the band of the edit
    matrix after the d code points that the range shares: its cells d - 1, d and d + 1 of the word.
    """
    n = len(rest)
    size = np.fromiter(map(len, rest), np.int64, n)
    wide = int(size.max(initial=0))
    letters = np.zeros((n, wide + 3), np.uint8)
    flat = np.frombuffer(b"".join(rest), np.uint8)
    ends = np.cumsum(size)
    letters[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(ends - size, size)] = flat
    shared = np.full(n, -1, np.int64)  # code points in common with the word before; -1 in another block
    same = np.flatnonzero(block[1:] == block[:-1]) + 1
    equal = letters[same] == letters[same - 1]
    shared[same] = np.minimum(np.where(equal.all(1), wide, equal.argmin(1)), np.minimum(size[same], size[same - 1]))
    opens = np.append(np.flatnonzero(shared < 0), n)
    for k in range(0, len(asks), QUERIES):
        word = asks[k : k + QUERIES]
        at = np.searchsorted(opens, word, "right")
        low, high = opens[at - 1], opens[at]
        far = np.int8(2)
        before, on, after = np.full(len(word), far), np.zeros(len(word), np.int8), np.where(size[word] > 0, np.int8(1), far)
        ended = size[low] == 0
        yield from _near(word[ended], low[ended], size, 0, before[ended], on[ended], after[ended])
        for d in range(wide):
            starts = np.flatnonzero((shared <= d) & (size > d))  # where ranges sharing d + 1 code points begin
            bounds = np.append(np.flatnonzero(shared <= d), n)
            first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
            wider = last - first
            turn = np.repeat(np.arange(len(word)), wider)
            low = starts[np.repeat(first - (np.cumsum(wider) - wider), wider) + np.arange(len(turn))]
            high = bounds[np.searchsorted(bounds, low, "right")]
            word, before, on, after = word[turn], before[turn], on[turn], after[turn]
            x, length = letters[low, d], size[word]
            # Cells d, d + 1 and d + 2 of the next row; those beyond the word are too far.
            lead = np.minimum(before + (x != letters[word, d - 1]), on + 1) if d else np.full(len(word), far) if not len(on) else on + 1
            own = np.minimum(np.minimum(on + (x != letters[word, d]), after + 1), lead + 1)
            own = np.where(d + 1 <= length, own, far)
            nxt = np.where(d + 2 <= length, np.minimum(after + (x != letters[word, d + 1]), own + 1), far)
            lead = np.where(d <= length, lead, far)
            alive = np.flatnonzero((lead <= 1) | (own <= 1) | (nxt <= 1))
            word, low, high = word[alive], low[alive], high[alive]
            before, on, after = (np.minimum(c[alive], far).astype(np.int8) for c in (lead, own, nxt))
            ended = size[low] == d + 1
            yield from _near(word[ended], low[ended], size, d + 1, before[ended], on[ended], after[ended])


def _near(word: np.ndarray, other: np.ndarray, size: np.ndarray, d: int, before: np.ndarray, on: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the list's words that end after d code points whose last cell is 1."""
    gap = size[word] - d
    cell = np.where(gap == -1, before, np.where(gap == 0, on, np.where(gap == 1, after, 2)))
    hit = np.flatnonzero(cell == 1)
    if len(hit):
        yield word[hit], other[hit]


def _links_of_blocks(rows: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, from rows (m, block, rest, word, n)."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        held: list[pa.Table] = []

        def scanned() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            words, n = t.column("word"), t.column("n").to_numpy()
            rest = [r.encode("latin-1") for r in t.column("rest").to_pylist()]
            block = t.column("number").to_numpy()
            longer = t.column("longer").to_numpy()
            for i, j in one_edit(rest, block, np.flatnonzero(~longer)):
                yield from out.add(words.take(pa.array(i)).to_pylist(), words.take(pa.array(j)).to_pylist(), n[j])
                back = longer[j]  # words of equal length find each other, longer ones do not ask
                yield from out.add(words.take(pa.array(j[back])).to_pylist(), words.take(pa.array(i[back])).to_pylist(), n[i[back]])

        many = 0
        for k, t in enumerate(runs(batches, ["block"], 2)):
            held.append(t.append_column("number", pa.array(np.full(t.num_rows, k))))
            many += t.num_rows
            if many >= QUERIES:
                yield from scanned()
                many = 0
        if held:
            yield from scanned()
        yield from out.flush()

    parts = rows.select("block", "rest", "word", "n", (F.length("word") > F.col("m")).alias("longer"))
    return parts.repartition("block").sortWithinPartitions("block", "rest").mapInArrow(work, "word string, near string, near_n long")


def near_words(vocabulary: DataFrame, crowded: int | None = None) -> DataFrame:
    """(word, near, near_n) for each ordered pair of words one edit apart. vocabulary: (word, n), each word once and of 2 code points or more."""
    crowded = crowded or CROWDED
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = _halves(vocabulary.select(F.explode(lengths).alias("m"), F.lit(0).alias("p"), F.lit(0).alias("s"), "word", "n"))
    links = None
    while True:
        rows = rows.withColumn("block", _block())
        left = F.col("m") - F.col("p") - F.col("s")
        full = settle(rows.where(left > 1).groupBy("block").agg(F.count("*").alias("many")).where(F.col("many") > crowded), "variant-blocks")
        some = not full.isEmpty()
        ready = rows.join(full, "block", "left_anti") if some else rows
        found = _links_of_blocks(ready.withColumn("rest", F.expr("substring(word, p + 1, length(word) - p - s)")))
        links = found if links is None else links.unionByName(found)
        if not some:
            return links.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))
        rows = settle(_halves(rows.join(full, "block", "left_semi").select("m", "p", "s", "word", "n")), "variant-halves")


def group_variants(vocabulary: DataFrame, times: float = 5, crowded: int | None = None) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n.

    form: the near word of largest n, the first in code-point order of those, if its n is at least
    `times` the word's. root: the last form of forms. A form has a greater n than its word for times > 1,
    so there are no circles, and each round doubles how far all words have followed.
    """
    vocabulary = settle(vocabulary, "variant-words")
    best = F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))
    found = near_words(vocabulary, crowded).groupBy("word").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    d = vocabulary.join(found, "word", "left").withColumn("best", F.when(-F.col("best.minus") >= times * F.col("n"), F.col("best")))
    d = settle(d.select("word", F.col("best.near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.minus")).alias("form_n")), "variant-forms")
    up = settle(d.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        far = settle(up.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        done = far.where("moved").isEmpty()
        discard(up)
        up = far.select("word", "root")
        if done:
            return d.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
