"""Models outside: questions sent and answers taken by a client that the caller gives, one for each worker.

The work around the call is Spark's: budgets of tokens are columns, a batch of rows is asked at a
time, and whatever goes wrong is told in the row. A task that runs again asks again, so what costs
money should be written once (checkpoint or table) before it is used twice.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import answers as A
from . import dialogue as D

#: Fixed value: how a server tells that a request exceeds its context.
_TOO_LONG = re.compile(r"maximum context length is (\d+) tokens and your request has (\d+) input tokens")

#: send(messages, most_tokens) gives the answer's text; messages are (role, text) pairs.
Send = Callable[[list[tuple[str, str]], int], str]


class Refused(Exception):
    """A server's answer that is none: its status and body."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"{status}: {body}")
        self.status, self.body = status, body


class Caller:
    """Asks with patience: a wait of `pause` seconds between attempts, and a smaller answer where the server says what fits.

    A model that is not there (404) and other refusals of the request (400) end it at once. The
    context that a server names holds for all later calls of this worker.
    """

    def __init__(self, send: Send, retries: int = 3, pause: float = 1.0):
        self.send, self.retries, self.pause, self.context = send, retries, pause, None

    def ask(self, messages: list[tuple[str, str]], most: int, used: int) -> tuple[str | None, str | None, int, int]:
        """Answer, error, attempts and the tokens asked for at last."""
        if self.context is not None:
            most = min(most, max(20, self.context - used - 50))
        for attempt in range(1, self.retries + 1):
            last = attempt == self.retries
            try:
                return self.send(messages, most), None, attempt, most
            except Refused as e:
                told = _TOO_LONG.search(e.body) if e.status == 400 else None
                if told and not last:
                    self.context = int(told[1])
                    most = max(20, self.context - int(told[2]) - 50)
                    continue
                if e.status in (400, 404) or last:
                    return None, f"status {e.status}", attempt, most
            except TimeoutError:
                if last:
                    return None, "timeout", attempt, most
            except OSError:
                if last:
                    return None, "connection", attempt, most
            time.sleep(self.pause)
        return None, "no attempt", 0, most


def ask(requests: DataFrame, client: Callable[[], Send], retries: int = 3, pause: float = 1.0, together: int = 1, context: int = 4096, wanted: int = 2048) -> DataFrame:
    """Adds answer, error, attempts and most_tokens to rows with `messages`, an array of (role, text).

    client: makes the function that sends, once in each worker; it must be picklable. together: so
    many requests of a worker are under way at once, for servers that batch; then nothing is tried
    again. Without messages a row has the error "no messages". The other columns stay.
    """
    n = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(F.coalesce(m["text"], F.lit(""))))
    used = F.coalesce(D.tokens(n, F.size("messages")), F.lit(0))
    limit = D.vllm_limit if together > 1 else D.safe_limit
    rows = requests.withColumns({"_used": used, "_most": limit(used, context, wanted)})
    schema = StructType([*requests.schema.fields]).add("answer", "string").add("error", "string").add("attempts", "integer").add("most_tokens", "integer")
    names = requests.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(client(), 1 if together > 1 else retries, 0 if together > 1 else pause)

        def one(row: tuple) -> tuple:
            messages, most, used = row
            if not messages:
                return None, "no messages", 0, most
            return caller.ask([(m["role"], m["text"] or "") for m in messages], most, used)

        with ThreadPoolExecutor(together) as pool:
            for b in batches:
                todo = zip(*(b.column(c).to_pylist() for c in ("messages", "_most", "_used")), strict=True)
                got = list(pool.map(one, todo) if together > 1 else map(one, todo))
                out = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out], [*names, "answer", "error", "attempts", "most_tokens"])

    return rows.mapInArrow(work, schema)


def words_encoder(size: int = 1 << 14) -> Callable[[list[str]], np.ndarray]:
    """An encoder without a model: counts of words, lower-cased, in `size` hashed places."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for k, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                out[k, zlib.crc32(w.encode()) % size] += 1
        return out

    return encode


def sentence_evidence(texts: DataFrame, values: DataFrame, encoder: Callable[[], Callable[[list[str]], np.ndarray]], least: float = 0.45, most_lines: int = 500) -> DataFrame:
    """For values (doc_id, field, label, value) without evidence the line of their document's text that is nearest to "label: value": snippet and score.

    Lines of 20 to 300 characters count, the first 500 of a text; the first of equals wins. Both
    are null below `least`, for a null value and where a text has no such line. texts: (doc_id,
    text). A document's values meet its lines in one row, and its lines are encoded once.
    """
    lines = F.slice(F.filter(F.transform(F.split("text", "\n"), lambda t: F.trim(t)), lambda t: F.length(t).between(20, 300)), 1, most_lines)
    asked = values.groupBy("doc_id").agg(F.collect_list(F.struct("field", F.coalesce(F.nullif("label", F.lit("")), "field").alias("label"), "value")).alias("asked"))
    rows = asked.join(texts.select("doc_id", lines.alias("lines")), "doc_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()

        def unit(x: list[str]) -> np.ndarray:
            v = np.asarray(encode(x), np.float64)
            return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

        for b in batches:
            out: list[tuple] = []
            for doc, asked, lines in zip(*(b.column(c).to_pylist() for c in ("doc_id", "asked", "lines")), strict=True):
                known = [a for a in asked if a["value"] is not None] if lines else []
                scores = unit([f"{a['label']}: {a['value']}" for a in known]) @ unit(lines).T if known else np.zeros((0, 1))
                best = {(a["field"], a["value"]): (lines[int(s.argmax())], float(s.max())) for a, s in zip(known, scores, strict=True) if s.max() >= least}
                out += [(doc, a["field"], a["value"], *best.get((a["field"], a["value"]), (None, None))) for a in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (b.schema.field("doc_id").type, pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], ["doc_id", "field", "value", "snippet", "score"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", b.schema.field("doc_id").type), ("field", pa.string()), ("value", pa.string()), ("snippet", pa.string()), ("score", pa.float64())]))

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, field string, value string, snippet string, score double")


def messages(*pairs: tuple[str, Column]) -> Column:
    """An array of messages from roles and texts; those with a null text are left out."""
    return F.filter(F.array(*[F.struct(F.lit(r).alias("role"), t.alias("text")) for r, t in pairs]), lambda m: m["text"].isNotNull())


def plain_answer(answer: Column) -> Column:
    """A text answer without the quotes or the fence around it."""
    t = F.trim(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    quoted = F.when(t.rlike('(?s)^".*"$') | t.rlike("(?s)^'.*'$"), F.substr(t, F.lit(2), F.greatest(F.lit(0), F.length(t) - 2))).otherwise(t)
    return F.when(quoted.rlike("(?s)^```.*```$"), F.trim(F.regexp_replace(quoted, r"(?s)^```[^\n]*\n?|\n?[^\n]*```$", ""))).otherwise(quoted)


def in_plain_words(signals: DataFrame, texts: DataFrame, client: Callable[[], Send], **how) -> DataFrame:
    """Risk signals whose description a model has put in plain words; the rest of the row stays, with original_description.

    signals: (doc_id, name, description, risk_level, confidence, evidence array<string>, ...). Signals
    of pictures' error levels are not asked about; without an answer a description stays. category
    and recommendation become null where a description is new. The model sees the first 500
    characters of the document's text (doc_id, text), the feature's own limit.
    """
    start = texts.select("doc_id", F.substring("text", 1, 500).alias("_start"))
    d = signals.join(start, "doc_id", "left")
    prompt = F.concat_ws(
        "\n",
        F.lit("Leg deze bevinding in hoogstens twee zinnen uit, in gewone woorden en zonder vaktermen. Geef alleen de uitleg."),
        F.concat(F.lit("Signaal: "), "name"),
        F.concat(F.lit("Beschrijving: "), "description"),
        F.concat(F.lit("Risico: "), "risk_level", F.lit(", zekerheid "), F.floor(F.col("confidence") * 100).cast("string"), F.lit("%")),
        F.concat(F.lit("Bewijs: "), F.coalesce(F.nullif(F.array_join("evidence", " | "), F.lit("")), F.lit("geen"))),
        F.concat(F.lit("Tekst: "), F.coalesce("_start", F.lit("geen"))),
    )
    asked = F.when(F.col("name") != "ela_manipulation_detected", messages(("user", prompt))).otherwise(F.array().cast("array<struct<role: string, text: string>>"))
    d = ask(d.withColumn("messages", asked).drop("_start"), client, **how)
    new = plain_answer(F.col("answer"))
    good = F.col("answer").isNotNull() & (F.trim("answer") != "")
    d = d.withColumns({"original_description": F.when(good, F.col("description")), "description": F.when(good, new).otherwise(F.col("description"))})
    lost = {c: F.when(~F.coalesce(good, F.lit(False)), F.col(c)) for c in ("category", "recommendation") if c in signals.columns}
    return d.withColumns(lost).select(*signals.columns, "original_description") if lost else d.select(*signals.columns, "original_description")


def drafted_types(types: DataFrame, client: Callable[[], Send], **how) -> DataFrame:
    """Document types (name, keywords, ...) with the description and the extraction preamble that a model drafts; empty where it fails."""
    prompt = F.concat_ws(
        "\n",
        F.lit('Stel voor dit documenttype een beschrijving van een of twee zinnen en aanwijzingen voor het uitlezen op. Antwoord in JSON: {"description": "...", "extraction_prompt_preamble": "..."}'),
        F.concat(F.lit("Naam: "), "name"),
        F.concat(F.lit("Kernwoorden: "), F.coalesce("keywords", F.lit(""))),
    )
    d = ask(types.withColumn("messages", messages(("user", prompt))), client, **how)
    told = A.parsed(F.col("answer"))
    d = d.withColumn("_told", told)
    part = lambda k: F.coalesce(F.get_json_object("_told", f"$.{k}"), F.lit(""))
    return d.select(*types.columns, part("description").alias("description"), part("extraction_prompt_preamble").alias("extraction_prompt_preamble"))
