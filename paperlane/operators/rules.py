"""Classification by keyword and pattern rules.

Rules are lines of a type's hints: `kw:` a required keyword, `re:` a pattern, `not:` a veto, and a
bare line an optional keyword. They are parsed on the driver and compiled into one struct column
per type, so that a text is read once for all types and never exploded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_pattern


@dataclass
class Hints:
    slug: str
    required: list[str] = field(default_factory=list)
    patterns: list[str] = field(default_factory=list)
    vetoes: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)


def parse_hints(slug: str, text: str | None) -> Hints:
    """A type's hints, one rule a line."""
    h = Hints(slug)
    for line in (text or "").split("\n"):
        line = line.strip()
        low = line.lower()
        if low.startswith("kw:") and low[3:].strip():
            h.required.append(low[3:].strip())
        elif low.startswith("re:") and line[3:].strip():
            h.patterns.append(line[3:].strip())
        elif low.startswith("not:") and low[4:].strip():
            h.vetoes.append(low[4:].strip())
        elif line and not low.startswith(("kw:", "re:", "not:")):
            h.optional.append(low)
    return h


def hint_rows(types: DataFrame) -> DataFrame:
    """Hints held in a table (slug, hints) as rows (slug, ord, kind, pattern)."""
    d = types.select("slug", F.posexplode(F.split("hints", "\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    low = F.lower("line")
    kind = F.when(low.startswith("kw:"), "kw").when(low.startswith("re:"), "re").when(low.startswith("not:"), "not").otherwise("opt")
    body = F.when(kind == "opt", low).when(kind == "re", F.trim(F.substr("line", F.lit(4)))).when(kind == "kw", F.trim(F.substr(low, F.lit(4)))).otherwise(F.trim(F.substr(low, F.lit(5))))
    return d.select("slug", "ord", kind.alias("kind"), body.alias("pattern"))


def _hits(text: Column, words: list[str]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def _matches(text: Column, found: list[str]) -> Column:
    return sum((text.rlike(p).cast("int") for p in map(java_pattern, found) if p), F.lit(0))


def _first(options: list[tuple[Column, Column, Column]]) -> Column:
    """The best of (usable, score, slug) structs by score, the first of equals."""
    rows = [F.when(ok, F.struct(score.alias("score"), F.lit(-i).alias("turn"), slug.alias("slug"))) for i, (ok, score, slug) in enumerate(options)]
    return F.array_max(F.array_compact(F.array(*rows)))


def strong(text: Column, types: list[Hints]) -> Column:
    """The type all of whose required keywords occur and none of whose vetoes, with the most keywords; the first of equals."""
    low = F.lower(text)
    return _first([((_hits(low, h.required) == len(h.required)) & (_hits(low, h.vetoes) == 0), F.lit(len(h.required)), F.lit(h.slug)) for h in types if h.required])["slug"]


def veto_reason(text: Column, predicted: Column, types: list[Hints], check_keywords: bool = False) -> Column:
    """Why a predicted type is refused: the first veto that occurs, or no required keyword; null if it stands."""
    low = F.lower(text)
    out = F.when(F.lit(False), F.lit(""))
    for h in types:
        for v in h.vetoes:
            out = out.when((predicted == h.slug) & low.contains(v), f"not:{v}")
        if check_keywords and h.required:
            out = out.when((predicted == h.slug) & (_hits(low, h.required) == 0), "no keyword")
    return out


def field_detected(text: Column, key: str, label: str, regex: str | None = None) -> Column:
    """Whether a field may be found in a text: by its names, its pattern, or the shape its key suggests."""
    low, k = F.lower(text), key.lower()
    out = low.contains(k) | low.contains(label.lower())
    if regex and (p := java_pattern(regex)):
        out = out | text.rlike(p)
    shapes = (
        (("iban",), [r"(?i)\bNL\d{2}[A-Z0-9]{10,}\b"]),
        (("rekening", "account"), [r"\b\d{8,}\b", r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{10,}\b"]),
        (("datum", "date"), [r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b"]),
        (("bedrag", "amount", "saldo"), [r"\b\d+[.,]\d{2}\b", r"€\s*\d+", r"(?i)EUR\s*\d+"]),
        (("naam", "name"), [r"(?U)\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"]),
        (("adres", "address"), [r"(?U)\b\d{4}\s*[A-Z]{2}\b", r"(?U)\b[A-Z][a-z]+\s+\d+[a-z]?\b"]),
    )
    for keys, found in shapes:
        if any(x in k for x in keys):
            for p in found:
                out = out | text.rlike(p)
            break
    return out


def _unique_best(options: list[tuple[Column, Column, str]]) -> Column:
    """The slug of the greatest score of at least 1, if no other reaches it."""
    scores = F.array_compact(F.array(*[F.when(ok & (s >= 1), F.struct(s.alias("score"), F.lit(slug).alias("slug"))) for ok, s, slug in options]))
    alone = lambda x: F.get(x, F.lit(0))["score"] > F.coalesce(F.get(x, F.lit(1))["score"], F.lit(0))
    # Bound to a name, so that each score is worked out once.
    return F.transform(F.array(F.sort_array(scores, False)), lambda x: F.when(alone(x), F.get(x, F.lit(0))["slug"]))[0]


def _with_low(text: Column, of: Callable[[Column, Column], Column]) -> Column:
    """A function of a text and the text in lower case, which is made once."""
    return F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), lambda x: of(x["text"], x["low"]))[0]


def deterministic(text: Column, types: list[Hints], required_fields: dict[str, list[tuple]] | None = None) -> Column:
    """Keywords count 1, patterns 3, required fields 2. All required keywords and fields must be there, and no veto; a unique best wins."""

    def of(text: Column, low: Column) -> Column:
        options = []
        for h in types:
            ok = (_hits(low, h.required) == len(h.required)) & (_hits(low, h.vetoes) == 0)
            score = F.lit(len(h.required)) + 3 * _matches(text, h.patterns) + _hits(low, h.optional)
            for f in (required_fields or {}).get(h.slug, []):
                ok, score = ok & field_detected(text, *f), score + 2
            options.append((ok, score, h.slug))
        return _unique_best(options)

    return _with_low(text, of)


def pure_deterministic(text: Column, types: list[Hints]) -> Column:
    """The variant in which not every keyword need occur."""
    return _with_low(text, lambda text, low: _unique_best([(_hits(low, h.vetoes) == 0, _hits(low, h.required) + 3 * _matches(text, h.patterns) + _hits(low, h.optional), h.slug) for h in types]))


def matched_hints(text: Column, winner: Column, types: list[Hints]) -> Column:
    """The winner's keywords that occur, ten at most."""
    low = F.lower(text)
    out = F.array().cast("array<string>")
    for h in types:
        words = h.required + h.optional
        if words:
            out = F.when(winner == h.slug, F.slice(F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words])), 1, 10)).otherwise(out)
    return out


def evidence_supported(evidence: Column, sample: Column) -> Column:
    """Whether a quoted piece of evidence is borne out by the text: as it stands, without punctuation, or by half its words or codes."""
    e = F.trim(F.lower(evidence))
    e = F.when(e.startswith('"') & e.endswith('"') & (F.length(e) > 1), F.substr(e, F.lit(2), F.length(e) - 2)).when(e.startswith('"'), F.substr(e, F.lit(2))).otherwise(e)
    s = F.lower(sample)
    tight = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\b[a-zA-Z]{3,}\b"), F.lit(0)))
    codes = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?U)\b[A-Z0-9]{4,}\b"), F.lit(0)))
    half = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)) >= 0.5
    by_words = F.when(F.size(words(e)) > 0, half(words(e), words(s))).otherwise((F.size(codes(evidence)) > 0) & half(codes(evidence), codes(sample)))
    given = (F.length(F.coalesce(evidence, F.lit(""))) > 0) & (F.length(F.coalesce(sample, F.lit(""))) > 0)
    return given & (s.contains(e) | ((F.length(tight(e)) >= 8) & tight(s).contains(tight(e))) | by_words)


def validate_llm(slug: Column, confidence: Column, evidence: Column, sample: Column) -> Column:
    """A model's answer as STRUCT<slug, confidence>: unknown at 0 unless its evidence is given and supported and it is at least half sure."""
    ok = (slug == "unknown") | ((F.trim(F.coalesce(evidence, F.lit(""))) != "") & evidence_supported(F.trim(evidence), sample) & (confidence >= 0.5))
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, slug).otherwise("unknown").alias("slug"), F.when(ok, confidence).otherwise(0.0).alias("confidence"))


def stage(forced: Column, strong_: Column, nb: Column, nb_confidence: Column, nb_refused: Column, fallback: Column) -> Column:
    """The live order: a forced type, strong rules, an accepted Naive Bayes, the deterministic rules, unknown. As STRUCT<slug, confidence, method>."""
    of = lambda s, c, m: F.struct(s.alias("slug"), c.cast("double").alias("confidence"), F.lit(m).alias("method"))
    return F.when(forced.isNotNull(), of(forced, F.lit(1.0), "forced")).when(strong_.isNotNull(), of(strong_, F.lit(1.0), "strong")).when(nb.isNotNull() & nb_refused.isNull(), of(nb, nb_confidence, "naive_bayes")).when(fallback.isNotNull(), of(fallback, F.lit(0.95), "deterministic")).otherwise(of(F.lit("unknown"), F.lit(0.0), "unknown"))
