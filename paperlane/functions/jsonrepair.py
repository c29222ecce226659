"""Repair of JSON that a language model left unfinished, as column functions over Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

_FENCE = re.compile(r"```(?:json)?")
_COMMA = re.compile(r",\s*(?=[}\]])")


def objects(text: str) -> list[str]:
    """Balanced top-level objects, braces inside strings aside."""
    out, depth, start, quoted, escaped = [], 0, -1, False, False
    for i, c in enumerate(text):
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = depth > 0
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def closed(text: str) -> str:
    """The text from its first brace on with strings, brackets and braces closed; a value that is cut off becomes null."""
    at = text.find("{")
    if at < 0:
        return ""
    stack, quoted, escaped = [], False, False
    body = text[at:]
    for c in body:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    if quoted:
        key = re.search(r'[{,]\s*"[^"]*$', body) and stack and stack[-1] == "}"
        body = body[: body.rfind('"')] if key else body[:-1] + '"' if escaped else body + '"'
    body = re.sub(r'"(?:[^"\\]|\\.)*"\s*$', "", body) if re.search(r'[{,]\s*"(?:[^"\\]|\\.)*"\s*$', body) and stack and stack[-1] == "}" else body
    body = re.sub(r":\s*[a-zA-Z0-9.+-]*$", lambda m: m[0] if re.fullmatch(r":\s*(?:-?\d+(?:\.\d+)?|true|false|null)", m[0]) else ": null", body)
    return _COMMA.sub("", re.sub(r",\s*$", "", body) + "".join(reversed(stack)))


def loose(text: str):
    """A JSON value, trailing commas forgiven; None if it is none."""
    for t in (text, _COMMA.sub("", text)):
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def all_objects(text: str) -> list[dict]:
    """The objects of an answer that can be read, one after another; what is left open at the end is tried as it stands."""
    found = objects(text)
    end = text.rfind(found[-1]) + len(found[-1]) if found else 0
    at = text.find("{", end)
    return [o for o in map(loose, [*found, *([text[at:]] if at >= 0 else [])]) if isinstance(o, dict)]


def merge(found: list[dict]) -> dict | None:
    """Several answers as one.

    Of a field's values the first that is not null stays, but an empty one gives way to one that is
    not; lists of evidence are joined, empty ones passed over, and other evidence stays as it came
    first. Where no answer has either, two are put together: the data of one and the evidence of the
    other, or all keys, the second before the first; else the first answer stands.
    """
    if not found:
        return None
    data: dict = {}
    evidence: dict = {}
    for o in found:
        for k, v in (o.get("data") if isinstance(o.get("data"), dict) else {}).items():
            if v is not None and (k not in data or (v and not data[k])):
                data[k] = v
        for k, v in (o.get("evidence") if isinstance(o.get("evidence"), dict) else {}).items():
            if v is None or v == []:
                continue
            if k not in evidence:
                evidence[k] = list(v) if isinstance(v, list) else v
            elif isinstance(v, list) and isinstance(evidence[k], list):
                evidence[k] += v
    if data or evidence:
        return {k: v for k, v in (("data", data), ("evidence", evidence)) if v}
    if len(found) == 2:
        a, b = found
        if "data" in a and "evidence" in b:
            return {"data": a["data"], "evidence": b["evidence"]}
        if "evidence" in a and "data" in b:
            return {"data": b["data"], "evidence": a["evidence"]}
        return a | b or a
    return found[0]


def repair(text: str | None) -> str | None:
    """The answer's object as JSON: as it stands, without fences, the first balanced object, several merged, or closed; null if nothing helps."""
    if not text:
        return None
    bare = _FENCE.sub("", text).strip()
    tries = [bare, *objects(bare)]
    several = []
    for o in objects(bare):
        try:
            several.append(json.loads(o))
        except ValueError:
            several = []
            break
    if len(several) > 1 and all(isinstance(o, dict) and ("data" in o or "evidence" in o) for o in several):
        return json.dumps(merge(several), ensure_ascii=False, sort_keys=True)
    for t in [*tries, *(_COMMA.sub("", t) for t in tries), closed(bare)]:
        try:
            o = json.loads(t)
        except ValueError:
            continue
        if isinstance(o, dict):
            return json.dumps(o, ensure_ascii=False, sort_keys=True)
    return None


@F.pandas_udf(StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(repair)


@F.pandas_udf(IntegerType())
def object_count(text: pd.Series) -> pd.Series:
    return text.fillna("").map(lambda t: len(objects(t))).astype("int32")


def null_strings(data: Column) -> Column:
    """A map whose "null" and "NULL" are null."""
    return F.transform_values(data, lambda k, v: F.when(~v.isin("null", "NULL"), v))
