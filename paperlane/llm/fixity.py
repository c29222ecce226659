"""Merkle fixity audit of WARC replicas.

Each record of an archive file is a leaf: its WARC-Record-ID, its offset and length in the file and
the digest of its bytes. Every replica has offsets of its own, so a record lost or grown shifts all
that lie behind it. Ordered offset ranges are hashed into the nodes above. A range begins at a
record whose id hashes to zero modulo SPAN, SPAN ** 2 and so on upwards, and places inside it count
from its begin, so a shift ends with the range it happens in. Above all ranges is a root per file.
Two replicas are compared at their roots; below, only the children of mismatching nodes are joined,
level by level, until the damaged records are found. Digests travel, records do not.

A range holds SPAN records or nodes on average, so no group is larger than that but for chance; a
file is one window, as large as files are. A null url or page counts as empty, a null id goes to a
file chosen by url and page. Repeated rows are records of their own. An empty archive has no
damage. A record that only one replica has is lost or extra; one that has merely moved is sound.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle

#: Records or nodes to a range, and the levels between records and root.
SPAN, LEVELS = 16, 2
DATE = "2024-01-01T00:00:00Z"


def record_id(name: Column) -> Column:
    """A UUID made of a record's name."""
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def record(rid: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC resource record with its mandatory fields."""
    b = F.coalesce(body, F.lit(""))
    head = (F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(b).cast("string"), F.lit("\r\n\r\n"), b, F.lit("\r\n\r\n"))


def file_of(key: Column, url: Column, body: Column, per_file: int = 1000) -> Column:
    """The archive file of a record: per_file neighbouring ids share one."""
    return F.coalesce(F.floor(key / F.lit(per_file)).cast("long"), -1 - F.pmod(F.xxhash64(url, body), F.lit(1 << 20)))


def with_offsets(records: DataFrame, order: list[str]) -> DataFrame:
    """Adds each record's offset in its file, from columns file and length."""
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def ranged(leaves: DataFrame) -> DataFrame:
    """Adds to leaves (file, rid, offset, length, digest) the ranges they lie in: n1, n2, ... name a range by the record it begins with, s1 is where the narrowest one begins."""
    upto = Window.partitionBy("file").orderBy("offset", "rid").rowsBetween(Window.unboundedPreceding, 0)
    h = F.xxhash64("rid")
    for level in range(1, LEVELS + 1):
        first = F.pmod(h, F.lit(SPAN**level)) == 0
        leaves = leaves.withColumn(f"n{level}", F.coalesce(F.last(F.when(first, F.col("rid")), ignorenulls=True).over(upto), F.lit("")))
        if level == 1:
            leaves = leaves.withColumn("s1", F.coalesce(F.last(F.when(first, F.col("offset")), ignorenulls=True).over(upto), F.lit(0).cast("long")))
    return leaves


def tree(leaves: DataFrame) -> list[DataFrame]:
    """From ranged leaves: tables (file, n1, n2, ..., hash) of the nodes, from the narrowest ranges to the root (file, hash)."""
    names = [f"n{k}" for k in range(1, LEVELS + 1)]
    leaf = F.sha2(F.concat_ws(":", "rid", F.col("offset") - F.col("s1"), "length", "digest"), 256)
    rows = leaves.select("file", *names, F.col("offset").alias("at"), leaf.alias("hash"))
    out = []
    for level in range(1, LEVELS + 2):
        above = names[level - 1 :]
        parts = F.array_sort(F.collect_list(F.struct("at", "hash")))
        made = rows.groupBy("file", *above).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["hash"]), ""), 256).alias("hash"), F.min("at").alias("at"))
        if level == 1:  # a row for each range; the levels above are made of it
            made = settle(made, "fixity-ranges")
        out.append(made.drop("at"))
        rows = made
    return out


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys at which two tables of hashes disagree."""
    keys = [c for c in a.columns if c != "hash"]
    both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), keys, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """From two tables of leaves: the damaged records (file, rid, offset_a, offset_b, length_a, length_b, digest_a, digest_b, status)."""
    leaves = [settle(ranged(t.select("file", "rid", "offset", "length", "digest")), "fixity-leaves") for t in (ours, theirs)]
    trees = [tree(t) for t in leaves]
    bad = settle(_differ(trees[0][-1], trees[1][-1]), "fixity-bad")
    for level in range(LEVELS, 0, -1):
        keys = bad.columns
        bad = settle(_differ(*[t[level - 1].join(bad, keys, "left_semi") for t in trees]), "fixity-bad")
    here = [t.join(bad, bad.columns, "left_semi").select("file", "rid", *[F.col(c).alias(f"{c}_{x}") for c in ("offset", "length", "digest")]) for t, x in zip(leaves, "ab", strict=True)]
    both = here[0].join(here[1], ["file", "rid"], "full").where(~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))))
    status = F.when(F.col("digest_b").isNull(), "lost").when(F.col("digest_a").isNull(), "extra").otherwise("changed")
    return both.select("file", "rid", "offset_a", "offset_b", "length_a", "length_b", "digest_a", "digest_b", status.alias("status"))


def replica_body(key: Column, url: Column, body: Column) -> tuple[Column, Column]:
    """What a worn replica derived from the pages holds: the body, and whether the record is there.

    By a hash of id and url about one record in 256 has a character changed (which may change its
    length in bytes) and one in 512 is lost.
    """
    h = F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    byte = F.substring(h, 1, 2)
    b = F.coalesce(body, F.lit(""))
    worn = F.when(byte == "00", F.concat(F.substring(b, 1, 40), F.lit("\u0001"), F.substr(b, F.lit(42)))).otherwise(b)
    return worn, ~((byte == "01") & (F.substring(h, 3, 1) < "8"))


def audit_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Audits the pages' archive against its worn replica, which is laid out on its own: the damaged records with their page's id."""
    key, url, body = F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)
    worn, there = replica_body(key, url, body)
    # Repeated rows get a number, so that each is a record with an id of its own.
    name = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.sha2(F.coalesce(body, F.lit("")), 256))
    rows = pages.select(key.alias("id"), file_of(key, url, body).alias("file"), name.alias("name"), url.alias("url"), F.coalesce(body, F.lit("")).alias("body"), F.when(there, worn).alias("worn"))
    # The record's id has a fixed length, so length and digest can be taken before rows are numbered; the digest is of the record without its id.
    free = F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>")
    facts = lambda b: (F.octet_length(record(free, F.col("url"), b)).cast("long"), F.sha2(record(free, F.col("url"), b), 256))
    (length, digest), (worn_length, worn_digest) = facts(F.col("body")), facts(F.col("worn"))
    rows = rows.select("id", "file", F.md5("name").alias("name"), length.alias("length"), digest.alias("digest"), F.when(F.col("worn").isNotNull(), worn_length).alias("worn_length"), F.when(F.col("worn").isNotNull(), worn_digest).alias("worn_digest"))
    nth = F.row_number().over(Window.partitionBy("file", "name").orderBy("id"))
    rows = settle(rows.withColumn("rid", record_id(F.concat_ws("|", "name", nth.cast("string")))), "fixity-records")
    ours = with_offsets(rows.select("file", "id", "rid", "length", "digest"), ["id", "rid"])
    theirs = rows.where("worn_digest is not null").select("file", "id", "rid", F.col("worn_length").alias("length"), F.col("worn_digest").alias("digest"))
    found = audit(ours, with_offsets(theirs, ["id", "rid"]))
    return found.join(rows.select(F.col("id").alias(id_col), "file", "rid"), ["file", "rid"]).select(id_col, *found.columns)


# Archives as files.


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Writes records (file, rid, url, body) to <folder>/<file>.warc, by rid; gives (file, path) of the files once it is run.

    The folder must be one that all executors share. A file is written by one task under another
    name and then renamed, so a task that is run again leaves whole files.
    """
    rows = records.select(F.col("file").cast("long").alias("file"), "rid", F.encode(record(F.col("rid"), F.col("url"), F.col("body")), "utf-8").alias("bytes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, made = None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{folder}/{now}.warc")
                made.append(now)

        for b in batches:
            for f, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if f != now:
                    close()
                    now, out = f, open(f"{folder}/.{f}-{os.getpid()}", "wb")
                out.write(data)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.int64()), pa.array([f"{folder}/{f}.warc" for f in made], pa.string())], ["file", "path"])

    return rows.repartition("file").sortWithinPartitions("file", "rid").mapInArrow(work, "file long, path string")


def _members(path: str, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and bytes of each record of a file; those of a .gz file are members of their own."""
    with open(path, "rb") as f:
        if not path.endswith(".gz"):
            at, held = 0, b""
            while True:
                while b"\r\n\r\n" not in held and (more := f.read(block)):
                    held += more
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                size = next((int(x.split(b":", 1)[1]) for x in held[:head].split(b"\r\n") if x.lower().startswith(b"content-length:") and x.split(b":", 1)[1].strip().isdigit()), 0)
                need = head + 4 + size + 4
                if len(held) < need:
                    held += f.read(max(block, need - len(held)))
                yield at, min(need, len(held)), held[:need]
                at, held = at + min(need, len(held)), held[need:]
            if held:
                yield at, len(held), held
            return
        at, held = 0, f.read(block)
        while held:
            unpack, parts, size = zlib.decompressobj(31), [], 0
            while held and not unpack.eof:
                size += len(held)
                try:
                    parts.append(unpack.decompress(held))
                except zlib.error:  # a broken member spoils what is left of the file
                    parts, size = [held, f.read()], size
                    size, held = size + len(parts[1]), b""
                    break
                held = unpack.unused_data or f.read(block)
                size -= len(unpack.unused_data)
            yield at, size, b"".join(parts)
            at += size


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves (file, rid, offset, length, digest, type, url) of the .warc and .warc.gz files of a folder, one task a file.

    file is the file's name without its endings. What has no WARC-Record-ID gets its offset as rid,
    so bytes that are no record are told as well. The digest is of the record's bytes, unpacked.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                path = path.removeprefix("file:")
                name = os.path.basename(path).removesuffix(".gz").removesuffix(".warc")
                for at, size, data in _members(path):
                    head = data.partition(b"\r\n\r\n")[0].decode("utf-8", "replace").split("\r\n")
                    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
                    row = (name, fields.get("warc-record-id", f"at {at}"), at, size, hashlib.sha256(data).hexdigest(), fields.get("warc-type"), fields.get("warc-target-uri"))
                    yield pa.RecordBatch.from_arrays([pa.array([v]) if v is not None else pa.array([None], pa.string()) for v in row], ["file", "rid", "offset", "length", "digest", "type", "url"])

    n = max(1, paths.count())
    return paths.repartition(n, "path").mapInArrow(work, "file string, rid string, offset long, length long, digest string, type string, url string")


def _sql_record(body: str) -> str:
    parts = ["'WARC/1.1'", "'WARC-Type: resource'", "'WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000000>'", f"'WARC-Date: {DATE}'", "'WARC-Target-URI: '", "'Content-Length: '"]
    line = "chr(13), chr(10)"
    return f"concat({parts[0]}, {line}, {parts[1]}, {line}, {parts[2]}, {line}, {parts[3]}, {line}, {parts[4]}, url, {line}, {parts[5]}, strlen({body}), {line}, {line}, {body}, {line}, {line})"


OP10_SQL = rf"""
WITH p AS (SELECT page_id, floor(page_id / 1000)::BIGINT AS file, coalesce(url, '') AS url, coalesce(html, '') AS b, substr(md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''))), 1, 3) AS h FROM pages),
w AS (SELECT *, md5(concat_ws('|', coalesce(CAST(page_id AS VARCHAR), ''), url, sha256(b))) AS name, CASE WHEN h LIKE '00%' THEN concat(substr(b, 1, 40), chr(1), substr(b, 42)) WHEN h LIKE '01%' AND substr(h, 3, 1) < '8' THEN NULL ELSE b END AS worn FROM p),
r AS (SELECT *, md5(concat_ws('|', name, CAST(row_number() OVER (PARTITION BY file, name ORDER BY page_id) AS VARCHAR))) AS x, {_sql_record('b')} AS ra, CASE WHEN worn IS NOT NULL THEN {_sql_record('worn')} END AS rb FROM w),
u AS (SELECT *, concat('<urn:uuid:', substr(x, 1, 8), '-', substr(x, 9, 4), '-', substr(x, 13, 4), '-', substr(x, 17, 4), '-', substr(x, 21, 12), '>') AS rid FROM r),
o AS (SELECT *, coalesce(sum(strlen(ra)) OVER s, 0)::BIGINT AS offset_a, coalesce(sum(strlen(rb)) OVER s, 0)::BIGINT AS offset_b FROM u WINDOW s AS (PARTITION BY file ORDER BY page_id, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, file, rid, offset_a, CASE WHEN rb IS NOT NULL THEN offset_b END AS offset_b, strlen(ra)::BIGINT AS length_a, strlen(rb)::BIGINT AS length_b, sha256(ra) AS digest_a, sha256(rb) AS digest_b,
  CASE WHEN rb IS NULL THEN 'lost' ELSE 'changed' END AS status
FROM o WHERE rb IS NULL OR sha256(ra) <> sha256(rb)
"""
