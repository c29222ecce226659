"""Queries over results of extraction and their evidence. Events stand for answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as X
from ..sources.corpus import table


def _told(evidence):
    one = lambda f: F.concat(f["key"], F.lit("="), F.array_join(F.transform(f["spans"], lambda s: s["quote"]), "+"))
    return F.array_join(F.transform(evidence, one), ";")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))


def js_evidence_array_match(spark, sf_dir):
    """One list of evidence dealt to the fields; every other answer has an item that two fields could take."""
    e = _events(spark, sf_dir)
    field = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    data = F.array(field("soort", F.col("event_type")), field("niets", F.lit(None).cast("string")), field("waarde", F.concat(F.lit("x"), F.col("k"))))
    quotes = F.array(F.concat(F.lit("Soort "), F.upper("event_type")), F.concat(F.lit("x"), "k"), F.lit("zz"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x"), "k", F.lit(" "), "event_type")).otherwise("yy"))
    items = F.transform(quotes, lambda q: F.struct(F.lit(0).alias("page"), F.lit(0).alias("start"), F.length(q).alias("end"), q.alias("quote")))
    return e.select("event_id", _told(X.match_evidence(data, items)).alias("evidence"))


def fx_normalize_result(spark, sf_dir):
    """Answers whose evidence comes in seven shapes."""
    e = _events(spark, sf_dir)
    shapes = (
        '"X@"', "null", '{"page": 1, "start": 2, "end": 4, "quote": "X@"}', '{"page": 1, "quote": "X@"}', '{"deel": [{"quote": "X@"}, "los", 5]}', '[{"quote": "X@", "page": 2}, null, "los"]',
    )
    text = F.get(F.array(*map(F.lit, shapes)), (F.col("event_id") % 7).cast("int"))
    by_field = F.concat(F.lit('{"data": {"a": "v@", "b": null, "weg": 1}, "evidence": {"a": '), text, F.lit(', "weg": "w"}}'))
    listed = F.lit('{"data": {"a": "v@", "b": "lange woorden", "weg": 1}, "evidence": [{"quote": "is v@ ja"}, {"quote": "bij WOORDEN"}, {"quote": "elders"}, "v@"]}')
    raw = F.replace(F.coalesce(by_field, listed), F.lit("@"), F.col("k"))
    n = F.col("n")
    e = e.withColumn("n", X.normalized(raw, ["a", "b"]))
    place = F.array_join(F.transform(F.flatten(F.transform(n["evidence"], lambda f: f["spans"])), lambda s: F.concat_ws("-", s["page"], s["start"], s["end"])), ",")
    return e.select("event_id", F.array_join(F.transform(n["data"], lambda f: f["key"]), ",").alias("fields"), _told(n["evidence"]).alias("evidence"), place.alias("places"))


_NAMES = "js_evidence_array_match fx_normalize_result"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    return {
        "js_evidence_array_match": "SELECT event_id, concat('soort=Soort ', upper(event_type), CASE WHEN event_id % 2 = 0 THEN concat('+x', props->>'$.k', ' ', event_type) ELSE '' END, ';niets=;waarde=x', props->>'$.k') AS evidence FROM events",
        "fx_normalize_result": """WITH e AS (SELECT event_id, event_id % 7 AS s, props->>'$.k' AS k, length(props->>'$.k') AS n FROM events)
 SELECT event_id, 'a,b' AS fields, CASE s WHEN 0 THEN concat('a=X', k) WHEN 1 THEN 'a=' WHEN 2 THEN concat('a=X', k) WHEN 3 THEN 'a=' WHEN 4 THEN concat('a=X', k, '+los') WHEN 5 THEN concat('a=X', k, '+los') ELSE concat('a=is v', k, ' ja+elders+v', k, ';b=bij WOORDEN') END AS evidence,
  CASE s WHEN 0 THEN concat('0-0-', n + 1) WHEN 1 THEN '' WHEN 2 THEN '1-2-4' WHEN 3 THEN '' WHEN 4 THEN concat('0-0-', n + 1, ',0-0-3') WHEN 5 THEN concat('2-0-', n + 1, ',0-0-3') ELSE concat('0-0-', n + 7, ',0-0-6,0-0-', n + 1, ',0-0-11') END AS places FROM e""",
    }
