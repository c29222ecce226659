"""Text samples, skip markers, chunks and prompt packing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MOST_CHARACTERS, java_pattern, strip

CHUNK, OVERLAP, SEEK = 2500, 300, 200


def _position(text: Column, pattern: str, is_regex: bool) -> Column:
    """Characters before the first match, whatever the case; null without one."""
    if is_regex:
        p = java_pattern(pattern)
        if p is None:
            return F.lit(None).cast("int")
        return F.when(text.rlike(p), F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{p})", 1)))
    at = F.locate(pattern.lower(), F.lower(text))
    return F.when(at > 0, at - 1)


def cut_at_marker(text: Column, markers: list[tuple[str, bool]]) -> Column:
    """STRUCT<text, marker, position>: cut before the earliest match of any marker; of equals the first in order."""
    found = [F.struct(_position(text, p, r).alias("at"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, (p, r) in enumerate(markers)]
    first = F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull() & (x["at"] < F.length(text)))) if found else F.lit(None)
    if not found:
        return F.struct(text.alias("text"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("int").alias("position"))
    return F.struct(F.when(first.isNotNull(), strip(F.substring(text, F.lit(1), first["at"]))).otherwise(text).alias("text"), first["p"].alias("marker"), first["at"].alias("position"))


def cut_for_training(text: Column, markers: list[tuple[str, bool]]) -> Column:
    """The training variant: markers in sorted order, and the first that matches cuts, wherever it stands."""
    at = F.coalesce(*[_position(text, p, r) for p, r in sorted(markers)], F.lit(-1))
    return F.when(at >= 0, strip(F.substring(text, F.lit(1), at))).otherwise(text)


def sample(text: Column, markers: list[tuple[str, bool]], most: int = 6000) -> Column:
    """What a model sees of a text: one line of at most `most` characters, cut at the markers.

    All blanks are single spaces by then, so there is one line: a short one is followed by a line end
    unless it leaves no room, a longer one is cut.
    """
    one = strip(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, MOST_CHARACTERS), r"(?U)\s+", " "))
    t = cut_at_marker(one, markers)["text"]
    n = F.length(t)
    return F.when(n > most, F.substring(t, 1, most)).when(n >= most - 1, t).otherwise(F.concat(t, F.lit("\n")))


def chunk_spans(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of a text's chunks; a break is taken after the last line end, full stop or space near a chunk's end."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            at = max(text.rfind(c, max(start, end - SEEK) + 1, end) for c in "\n. ")
            end = at + 1 if at >= 0 else end
        out.append((start, min(end, len(text))))
        start = end - overlap
    return out


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Rows (doc_id, part, start, chunk), part from 0. Each break depends on the one before, so a text is walked in its task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for k, (s, e) in enumerate(chunk_spans(t, size, overlap))]
            for at in range(0, len(rows), 2000):
                ids, parts, starts, texts = zip(*rows[at : at + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "part", "start", "chunk"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(work, "doc_id long, part int, start int, chunk string")


def table_like(text: Column) -> Column:
    """At least two lines that have columns, or three words and a number."""
    lines = F.split(text, "\n")
    row = lambda x: x.rlike(r"\t|\||\S {2,}\S") | ((F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")) >= 3) & x.rlike(r"\d"))
    return F.size(F.filter(lines, row)) >= 2


def words_near(words: Column, wanted: Column, window: int = 10) -> Column:
    """Two or more wanted words all occur, their first places no more than the window apart."""
    at = F.transform(wanted, lambda w: F.array_position(words, w))
    return (F.size(wanted) >= 2) & F.coalesce((F.array_min(at) > 0) & (F.array_max(at) - F.array_min(at) <= window), F.lit(False))
