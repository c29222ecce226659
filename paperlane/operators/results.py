"""Results of extraction brought into one shape: values by field, and spans of evidence for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<page: int, start: int, end: int, quote: string>"
FIELD = "struct<key: string, value: string>"
EVIDENCE = "array<struct<key: string, spans: array<" + SPAN + ">>>"


def fields_of(data: Column) -> Column:
    """An object's entries in their order, as an array of (key, value)."""
    entries = F.map_entries(F.from_json(data, "map<string, string>"))
    return F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), F.array().cast(f"array<{FIELD}>"))


def _span(item: Column) -> Column:
    """One item (a variant) of evidence: an object with a quote, or the quote itself; null for anything else."""
    kind = F.schema_of_variant(item)
    o = F.from_json(F.to_json(item), "struct<page: int, start: int, end: int, quote: string>")
    quote = F.coalesce(o["quote"], F.lit(""))
    start = F.coalesce(o["start"], F.lit(0))
    whole = F.struct(F.coalesce(o["page"], F.lit(0)).alias("page"), start.alias("start"), F.coalesce(o["end"], start + F.length(quote)).alias("end"), quote.alias("quote"))
    text = F.try_variant_get(item, "$", "string")
    bare = F.struct(F.lit(0).alias("page"), F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("quote"))
    return F.when(kind.startswith("OBJECT"), whole.cast(SPAN)).when(kind == "STRING", bare.cast(SPAN))


def spans_of(items: Column) -> Column:
    """A JSON list of evidence as spans; what is neither object nor string is left out."""
    each = F.try_variant_get(F.try_parse_json(items), "$", "array<variant>")
    return F.coalesce(F.filter(F.transform(F.filter(each, lambda v: v.isNotNull()), _span), lambda s: s.isNotNull()), F.array().cast(f"array<{SPAN}>"))


def match_evidence(data: Column, items: Column) -> Column:
    """Evidence given as one list, dealt to fields in their order: a field takes every item not taken yet whose quote holds its value or is held by it."""
    none = F.array().cast("array<int>")
    numbered = F.transform(items, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    start = F.struct(none.alias("used"), F.array().cast(EVIDENCE).alias("out"))

    def take(a: Column, f: Column) -> Column:
        value = F.lower(F.trim(f["value"]))
        fits = lambda q: q.contains(value) | value.contains(q)
        mine = F.when(value.isNull(), F.filter(numbered, lambda x: F.lit(False))).otherwise(F.filter(numbered, lambda x: ~F.array_contains(a["used"], x["i"]) & fits(F.lower(F.trim(x["s"]["quote"])))))
        one = F.struct(f["key"].alias("key"), F.transform(mine, lambda x: x["s"]).alias("spans"))
        return F.struct(F.concat(a["used"], F.transform(mine, lambda x: x["i"])).alias("used"), F.concat(a["out"], F.array(one)).cast(EVIDENCE).alias("out"))

    return F.aggregate(data, start, take, lambda a: a["out"])


def spread_evidence(data: Column, items: Column) -> Column:
    """Evidence given as one list, each item to the first field whose value it holds, is held by, or shares a word over three letters with; to the first field if there is none."""

    def key_of(s: Column) -> Column:
        quote = F.lower(s["quote"])
        value = lambda f: F.lower(f["value"])
        word = lambda f: F.exists(F.split(value(f), r"\s+"), lambda w: (F.length(w) > 3) & quote.contains(w))
        fits = F.filter(data, lambda f: f["value"].isNotNull() & (quote.contains(value(f)) | value(f).contains(quote) | word(f)))
        return F.coalesce(F.get(fits, F.lit(0))["key"], F.get(data, F.lit(0))["key"])

    keyed = F.transform(items, lambda s: F.struct(key_of(s).alias("key"), s.alias("s")))
    return F.transform(data, lambda f: F.struct(f["key"].alias("key"), F.transform(F.filter(keyed, lambda x: x["key"] == f["key"]), lambda x: x["s"]).alias("spans")))


def normalized(raw: Column, expected: list[str] | None = None) -> Column:
    """STRUCT<data, evidence> of an extraction's JSON: unexpected fields dropped, evidence of any shape as spans by field.

    Evidence of a field may be null, a string, a span, an object that holds a list, or a list of
    spans and strings. One list for all fields is spread over them.
    """
    data = fields_of(F.get_json_object(raw, "$.data"))
    keep = lambda xs: xs if expected is None else F.filter(xs, lambda f: f["key"].isin(expected))
    data = keep(data)
    text = F.get_json_object(raw, "$.evidence")

    def shaped(v: Column) -> Column:
        inner = F.filter(F.map_values(F.from_json(v, "map<string, string>")), lambda x: x.startswith("["))
        # A single span must have all its parts.
        o = F.from_json(v, SPAN)
        whole = o["page"].isNotNull() & o["start"].isNotNull() & o["end"].isNotNull() & o["quote"].isNotNull()
        lone = F.when(whole, F.array(o)).otherwise(F.array().cast(f"array<{SPAN}>"))
        held = F.when(F.size(inner) > 0, spans_of(F.get(inner, F.lit(0)))).otherwise(lone)
        return F.when(v.startswith("["), spans_of(v)).when(v.startswith("{"), held).otherwise(spans_of(F.to_json(F.array(v))))

    by_field = F.transform(keep(fields_of(text)), lambda f: F.struct(f["key"].alias("key"), F.when(f["value"].isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(shaped(f["value"])).alias("spans")))
    evidence = F.when(text.startswith("["), spread_evidence(data, spans_of(text)).cast(EVIDENCE)).otherwise(by_field.cast(EVIDENCE))
    return F.struct(data.alias("data"), F.coalesce(evidence, F.array().cast(EVIDENCE)).alias("evidence"))
