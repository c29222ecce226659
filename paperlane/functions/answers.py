"""Answers of language models as JSON: read whatever surrounds them, brought into one shape, held against a schema.

Column functions take whole batches; a null or empty answer gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import jsonrepair as J
from . import patterns as P

#: Instructions that answers repeat, and beginnings of explanations.
ECHOES = (re.compile(r'"evidence"\s+field\s+MUST\s+be\s+[^"]*', re.I), re.compile(r'field\s+MUST\s+be\s+[^"]*(?=\s*"evidence"|$)', re.I))
EXPLAINS = ("- ", "* ", "• ", "If you", "Example", "Note:", "IMPORTANT:", "Here")
_NESTED = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.S)
#: What a schema's types admit. A truth value is a whole number, and that a number.
KINDS = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "array": list, "object": dict}


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def without_echoes(text: str) -> str:
    """The answer without repeated instructions; where there were any, from its first brace on."""
    out = text
    for p in ECHOES:
        out = p.sub("", out)
    return out[max(0, out.find("{")) :] if out != text else text


def _by_braces(text: str):
    """The object that begins at the first brace, after some preamble: to where braces, quoted ones too, are balanced."""
    at, depth = text.find("{"), 0
    if at <= 0:
        return None
    for i in range(at, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return _json(text[at : i + 1])
    return None


def _largest(text: str):
    """In an explanation, the longest object that has data or evidence."""
    if not text.strip().startswith(EXPLAINS):
        return None
    found = [(len(m), _json(m)) for m in _NESTED.findall(text)]
    sound = [(n, o) for n, o in found if isinstance(o, dict) and ("data" in o or "evidence" in o)]
    return max(sound, key=lambda x: x[0])[1] if sound else None


def parse(text: str | None):
    """An answer's value: without echoes, as it stands, after a preamble, out of an explanation, or repaired; None if nothing helps."""
    if not text:
        return None
    for way in (lambda t: _json(without_echoes(t)), _json, _by_braces, _largest, lambda t: _json(J.repair(t) or "")):
        found = way(text)
        if found is not None:
            return found
    return None


def finished(answer):
    """An answer in its usual shape: "null" is null, evidence is no part of data but beside it, an object of lists by field, empty without any."""
    if not isinstance(answer, dict):
        return answer
    out = dict(answer)
    if isinstance(out.get("data"), dict):
        data = {k: None if v in ("null", "NULL") else v for k, v in out["data"].items()}
        if "evidence" in data and "evidence" not in out:
            out["evidence"] = data.pop("evidence")
        out["data"] = data
    if out.get("evidence") is None or out["evidence"] == "null":
        out["evidence"] = {}
    if isinstance(out["evidence"], list):
        out["evidence"] = dealt(out.get("data") or {}, out["evidence"])
    return out


def dealt(data: dict, items: list) -> dict:
    """One list of evidence for all fields: each takes the items not taken yet whose quote holds its value or is held by it."""
    left, out = list(items), {}
    for key, value in data.items():
        v = "" if value is None else str(value).strip().lower()
        fits = lambda i: isinstance(i, dict) and (v in (q := str(i.get("quote") or "").strip().lower()) or q in v)  # noqa: B023, E731
        out[key] = [] if value is None else [i for i in left if fits(i)]
        left = [i for i in left if not any(i is x for x in out[key])]
    return out


def schema_error(answer, schema: dict) -> str | None:
    """Why an answer does not meet a schema: no object, missing:<key> or type:<key>; None if it does. Only its own level is looked at."""
    if not isinstance(answer, dict):
        return "no_object"
    missing = [k for k in schema.get("required", []) if k not in answer]
    if missing:
        return f"missing:{missing[0]}"
    for k, v in answer.items():
        kind = schema.get("properties", {}).get(k, {}).get("type")
        if isinstance(kind, str) and kind in KINDS and not isinstance(v, KINDS[kind]):
            return f"type:{k}"
    return None


def _of_text(f: Callable[[str], object]) -> Callable[[Column], Column]:
    @F.pandas_udf(StringType())
    def work(text: pd.Series) -> pd.Series:
        def one(t):
            out = f(t) if t else None
            return out if out is None or isinstance(out, str) else json.dumps(out, ensure_ascii=False, sort_keys=True)

        return text.map(one)

    return work


#: The answer as JSON with sorted keys, null if it cannot be read.
parsed = _of_text(parse)
#: The same in its usual shape.
finished_json = _of_text(lambda t: finished(parse(t)))
#: All objects of an answer as one, null without any.
merged = _of_text(lambda t: J.merge(J.all_objects(t)))


def checked(answer: Column, schema: dict) -> Column:
    """schema_error() of answers given as JSON; no_object for a null."""

    @F.pandas_udf("string")
    def work(text: pd.Series) -> pd.Series:
        return text.map(lambda t: schema_error(J.loose(t or ""), schema))

    return work(answer)


def _object(properties: dict, required: list[str]) -> dict:
    return {"type": "object", "properties": properties, "required": required}


def schema_of(fields: list) -> dict:
    """The JSON schema of an extraction: data with a value for each field, and evidence with spans for each."""
    kinds = {"number": {"type": "number"}, "date": {"type": "string", "format": "date"}}
    one = lambda f: {"type": "string", "description": f.label} | kinds.get(f.field_type, {}) | ({"enum": list(f.enum_values)} if f.field_type == "enum" and f.enum_values else {})
    count = {"type": "integer", "minimum": 0}
    span = _object({"page": count, "start": count, "end": count, "quote": {"type": "string"}}, ["page", "start", "end", "quote"])
    keys = [f.key for f in fields]
    data = _object({f.key: one(f) for f in fields}, [f.key for f in fields if f.required])
    return _object({"data": data, "evidence": _object({k: {"type": "array", "items": span} for k in keys}, keys)}, ["data", "evidence"])


def candidate_schema(fields: list) -> dict:
    """The JSON schema of candidates: for each field a list of values with evidence, kind of evidence and role."""
    text = {"type": "string"}
    one = {"value": text, "normalized_value": text, "unit": {"type": ["string", "null"]}, "evidence": text, "chunk_index": {"type": "integer"}, "confidence": {"type": "number"}}
    one |= {"evidence_type": text | {"enum": list(P.EVIDENCE_SCORES)}, "record_role": text | {"enum": list(P.ROLE_SCORES)}}
    keys = [P.ALIASES.get(f.key, f.key) for f in fields]
    return _object({"candidates": _object({k: {"type": "array", "items": _object(one, list(one))} for k in keys}, keys)}, ["candidates"])


CANDIDATE = "struct<field_key: string, value: string, normalized_value: string, unit: string, evidence: string, confidence: double, evidence_type: string, record_role: string>"


def _text(value) -> str | None:
    """A value as text: true and false in lower case, objects and lists as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _quote(evidence) -> str:
    """The quote of evidence of any shape: itself, the first of a list, or an object's."""
    first = evidence[0] if isinstance(evidence, list) and evidence else evidence
    return (_text(first.get("quote")) if isinstance(first, dict) else _text(first) if first else "") or ""


def candidates_in(answer, keys: list[str]) -> list[dict]:
    """Candidates of an answer, in the order of the keys; those without a value are left out.

    Under `candidates` a field has a list, one object or a bare value, which counts as ambiguous with
    a confidence of 50 and its own evidence. Answers in the older shape, data and evidence, give one
    for each value, semantic with a confidence of 55. Aliases stand for their keys.
    """
    if not isinstance(answer, dict):
        return []
    aliases = {v: k for k, v in P.ALIASES.items()}
    told = lambda d, k: d.get(k) or (d.get(aliases[k]) if k in aliases else d.get(k))
    row = lambda k, value, normal, unit, evidence, confidence, kind, role: {"field_key": k, "value": _text(value), "normalized_value": _text(normal), "unit": _text(unit), "evidence": evidence, "confidence": confidence, "evidence_type": _text(kind), "record_role": _text(role)}
    number = lambda x: float(x) if isinstance(x, (int, float)) else 0.0
    out = []
    if isinstance(answer.get("candidates"), dict):
        for k in keys:
            raw = told(answer["candidates"], k)
            for c in [] if raw is None else raw if isinstance(raw, list) else [raw]:
                if isinstance(c, dict):
                    out.append(row(k, c.get("value"), c.get("normalized_value"), c.get("unit"), _text(c.get("evidence") or ""), number(c.get("confidence", 0)), c.get("evidence_type", "ambiguous"), c.get("record_role", "unknown")))
                else:
                    out.append(row(k, c, c, None, _text(c) or "", 50.0, "ambiguous", "unknown"))
    elif isinstance(answer.get("data"), dict):
        spans = answer["evidence"] if isinstance(answer.get("evidence"), dict) else {}
        for k in keys:
            value = answer["data"].get(k)
            alias = aliases.get(k) if value is None else None
            value, quote = (answer["data"].get(alias), _quote(spans.get(alias))) if alias else (value, _quote(spans.get(k)))
            out.append(row(k, value, value, None, quote or _text(value) or "", 55.0, "semantic", "unknown"))
    return [c for c in out if c["value"] is not None and c["value"].strip() and c["value"].strip().lower() not in P.PLACEHOLDERS]


def candidates(answer: Column, keys: list[str]) -> Column:
    """candidates_in() of answers of any text, an empty list where there are none."""

    @F.pandas_udf(f"array<{CANDIDATE}>")
    def work(text: pd.Series) -> pd.Series:
        return text.map(lambda t: candidates_in(parse(t), keys))

    return work(answer)
