"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII blanks, for translate().
BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    """Array of words; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; in local mode, where it is unset, one of this machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="paperlane-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    It cuts the lineage, so a lost executor costs no more than the files' readers, and lets the
    next join start from a scan, whose exchange Spark may split where a key is hot.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again. What cannot be reached from here stays."""
    for t in tables:
        files = t.inputFiles()
        if files:
            folder = files[0].rpartition("/")[0]
            try:
                fs, path = pa.fs.FileSystem.from_uri(folder.replace("file:///", "/"))
                fs.delete_dir(path)
            except (OSError, ValueError, NotImplementedError):  # left behind, as it would be without this
                continue


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 25) -> None:
    """Keep Arrow batches small, by rows and bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Rows:
    """Gathers output columns and gives record batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 100_000):
        self.schema, self.most, self.parts, self.n = schema, most, [], 0

    def add(self, *columns) -> Iterator[pa.RecordBatch]:
        """columns: equally long sequences, one for each field."""
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            cols = []
            for i, field in enumerate(self.schema):
                pieces = [p[i] for p in self.parts]
                if all(isinstance(x, np.ndarray) for x in pieces):
                    cols.append(pa.array(np.concatenate(pieces)).cast(field.type))
                else:
                    cols.append(pa.array([v for x in pieces for v in x], field.type))
            yield pa.RecordBatch.from_arrays(cols, schema=self.schema)
        self.parts, self.n = [], 0


def runs(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of the rows that share the key columns, from batches sorted by them; runs of fewer than least rows are passed over."""
    held: list[pa.RecordBatch] = []
    last = None

    def ended() -> Iterator[pa.Table]:
        if sum(h.num_rows for h in held) >= least:
            yield pa.Table.from_batches(held)
        held.clear()

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and tuple(c[0] for c in cols) != last
        starts = np.append(np.flatnonzero(change), n)
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield from ended()
            if e - s >= least or e == n:
                held.append(batch.slice(s, e - s))
        last = tuple(c[-1] for c in cols)
    yield from ended()
