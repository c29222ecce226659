"""Queries over models' answers: what is read from them, their schema, their candidates, and how decisions are told. Events stand for answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import candidates as C
from ..operators import decisions as M
from ..operators.relevance import Field
from ..sources.corpus import table


def _shaped(spark, sf_dir, shapes: tuple):
    """Events with an answer in one of the shapes by their id; @ is the event's k, ~ its type."""
    e = table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k"), "kind": (F.col("event_id") % len(shapes)).cast("int")})
    raw = F.get(F.array(*map(F.lit, shapes)), F.col("kind"))
    return e.withColumn("raw", F.replace(F.replace(raw, F.lit("@"), F.col("k")), F.lit("~"), F.col("event_type")))


MERGES = (
    '{"data": {"a": null, "b": ""}, "evidence": {"a": [], "b": [{"quote": "~"}]}} dan {"data": {"a": "~", "b": "x@", "c": 1,}, "evidence": {"a": [{"quote": "@"}], "b": [{"quote": "@"}]}}',
    '{"data": {"a": @}}\n{"evidence": {"a": "~"}} {"evidence": {"a": [1]}}',
    '{"evidence": "~"} {"data": [@]}',
    '{"x": @} {"x": 0, "y": "{~}"}',
    '{"x": @} {"y": 1} {"z": 2}',
    "geen ~",
)


def js_merge(spark, sf_dir):
    """Answers of several objects as one."""
    return _shaped(spark, sf_dir, MERGES).select("event_id", A.merged(F.col("raw")).alias("json"))


CASCADES = (
    '{"data": {"k": @}}',
    'Het antwoord is: {"data": {"k": @, "t": "~"}} klaar',
    '- eerst {"a": 1} dan {"data": {"k": @}, "evidence": {}} of {"data": {}}',
    '{"data": {"k": @, "t": "~',
    '```json\n{"data": {"k": @,},}\n```',
    '"evidence" field MUST be an object {"data": {"k": @}}',
    "~ zonder antwoord",
)


def js_parse_cascade(spark, sf_dir):
    """Answers read whatever surrounds them: as they stand, after a preamble, in an explanation, cut off, fenced, behind instructions; or not at all."""
    return _shaped(spark, sf_dir, CASCADES).select("event_id", A.parsed(F.col("raw")).alias("json"))


SCHEMA = {"required": ["k", "t"], "properties": {"k": {"type": "integer"}, "t": {"type": "string"}, "n": {"type": "number"}, "l": {"type": "array"}, "o": {"type": "object"}, "b": {"type": "boolean"}}}
CHECKS = (
    '{"k": @, "t": "~", "n": 1.5, "l": [], "o": {}, "b": false, "more": null}', '{"k": "@", "t": "~"}', '{"k": @}', '{"k": @, "t": 1}', '{"k": true, "t": "~", "b": 1}', '{"k": @, "t": "~", "n": null}', '["~"]', "{~",
)


def js_schema_check(spark, sf_dir):
    """Required keys, then the kinds of all keys: whole numbers, where true counts as one, numbers, texts, lists, objects, truth values."""
    return _shaped(spark, sf_dir, CHECKS).select("event_id", A.checked(F.col("raw"), SCHEMA).alias("error"))


KEYS = ["energielabel", "soort", "waarde"]
CANDIDATES = (
    '{"candidates": {"energylabel": [{"value": "~", "normalized_value": "@", "evidence": "Label: ~", "confidence": 80, "evidence_type": "exact_label", "record_role": "primary"}, "A@", null, {"value": "n/a"}], "soort": {"value": true, "confidence": 10}, "waarde": null, "weg": ["x"]}}',
    'Hier: {"data": {"energylabel": "@", "soort": "onbekend", "waarde": "~"}, "evidence": {"energylabel": [{"quote": "Label @"}], "waarde": "zie ~"}}',
    '{"data": {"soort": "~", "waarde": "@"}, "evidence": [1]}',
    '{"iets": "~"}',
)


def fx_candidate_normalize(spark, sf_dir):
    """Candidates of answers in both shapes, with aliases, bare values and placeholders; evidence repaired from the chunk."""
    d = _shaped(spark, sf_dir, CANDIDATES).select(F.col("event_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("raw").alias("answer"), F.concat(F.lit("In dit stuk staat A"), "k", F.lit(" vermeld.")).alias("chunk"))
    c = C.from_answers(d, KEYS)
    return c.select(F.col("doc_id").alias("event_id"), "ord", "field_key", "value", "normalized_value", "evidence", "confidence", "evidence_type", "record_role")


FIELDS = [Field("soort", "Soort", "enum", ("open", "dicht"), None, True), Field("datum", "Datum", "date"), Field("bedrag", "Bedrag", "number", (), None, True), Field("energylabel", "Energielabel")]


def fx_prompt_schema(spark, sf_dir):
    """Answers held against the schema of a field list: the parts there must be, and each field's own kind."""
    shape = A.schema_of(FIELDS)
    inner = shape["properties"]["data"]
    parts = ('{"data": {"soort": "~", "bedrag": @}, "evidence": {}}', '{"data": {"soort": "~"}, "evidence": {}}', '{"data": {"bedrag": "@", "soort": 1}}', '{"evidence": {}, "data": {"bedrag": "x@", "soort": "~"}}')
    d = _shaped(spark, sf_dir, parts)
    d = d.withColumn("outer", A.checked(F.col("raw"), shape))
    return d.select("event_id", "outer", A.checked(F.get_json_object("raw", "$.data"), inner).alias("inner"))


def _predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    nb = M.model_record(F.when(i % 7 != 0, F.col("event_type")), F.when(i % 7 != 0, (i % 100) / 100.0), F.lit(0.85), F.when(F.col("event_type") == "error", "not: fout"), F.when(i % 14 == 0, "model stuk"))
    scores = F.create_map(F.lit("a"), (F.col("user_id") % 10) / 10.0, F.lit("b"), F.lit(0.5))
    embedding = M.model_record(F.when(F.col("user_id") % 3 > 0, F.lit("a")), F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 10) / 10.0), scores=scores)
    return e.select("event_id", "event_type", nb.alias("nb"), embedding.alias("bert"))


def cls_scores_record(spark, sf_dir):
    """What became of each model's prediction, with its reason and margin."""
    return _predictions(spark, sf_dir).select("event_id", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m, own in (("nb", ("status", "label", "confidence", "reason")), ("bert", ("status", "margin"))) for c in own])


def cls_rationale(spark, sf_dir):
    """The reason given for a label by each method."""
    method = F.when(F.col("event_id") % 5 == 0, "deterministic_strong").when(F.col("event_id") % 5 < 3, "nb").otherwise("deterministic")
    matched = F.array(F.col("event_type"), F.lit("iban"))
    why = M.rationale(method, F.lit(0.95), matched, F.col("nb"), F.col("bert"), F.when(F.col("event_id") % 2 == 0, "klein"))
    return _predictions(spark, sf_dir).select("event_id", why.alias("rationale"))


_NAMES = "js_merge js_parse_cascade js_schema_check fx_candidate_normalize fx_prompt_schema cls_scores_record cls_rationale"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    e = lambda n: f"WITH e AS (SELECT event_id, event_id % {n} AS s, props->>'$.k' AS k, event_type AS t, user_id FROM events)"
    nb = "CASE WHEN event_id % 7 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END"
    pred = f"WITH p AS (SELECT event_id, event_type, {nb} AS c, user_id % 3 > 0 AS has, (user_id % 10) / 10.0::DOUBLE AS b FROM events), q AS (SELECT *, CASE WHEN c < 0.85 THEN 'below_threshold' WHEN c IS NOT NULL AND event_type = 'error' THEN 'rejected' WHEN c IS NOT NULL THEN 'accepted' WHEN event_id % 14 = 0 THEN 'failed' ELSE 'no_result' END AS st FROM p)"
    return {
        "js_merge": f"""{e(6)} SELECT event_id, CASE s WHEN 0 THEN concat('{{"data": {{"a": "', t, '", "b": "x', k, '", "c": 1}}, "evidence": {{"a": [{{"quote": "', k, '"}}], "b": [{{"quote": "', t, '"}}, {{"quote": "', k, '"}}]}}}}')
 WHEN 1 THEN concat('{{"data": {{"a": ', k, '}}, "evidence": {{"a": "', t, '"}}}}') WHEN 2 THEN concat('{{"data": [', k, '], "evidence": "', t, '"}}') WHEN 3 THEN concat('{{"x": 0, "y": "{{', t, '}}"}}') WHEN 4 THEN concat('{{"x": ', k, '}}') END AS json FROM e""",
        "js_parse_cascade": f"""{e(7)} SELECT event_id, CASE s WHEN 0 THEN concat('{{"data": {{"k": ', k, '}}}}') WHEN 1 THEN concat('{{"data": {{"k": ', k, ', "t": "', t, '"}}}}') WHEN 2 THEN '{{"a": 1}}'
 WHEN 3 THEN concat('{{"data": {{"k": ', k, ', "t": "', t, '"}}}}') WHEN 4 THEN concat('{{"data": {{"k": ', k, '}}}}') WHEN 5 THEN concat('{{"data": {{"k": ', k, '}}}}') END AS json FROM e""",
        "js_schema_check": f"{e(8)} SELECT event_id, CASE s WHEN 1 THEN 'type:k' WHEN 2 THEN 'missing:t' WHEN 3 THEN 'type:t' WHEN 4 THEN 'type:b' WHEN 5 THEN 'type:n' WHEN 6 THEN 'no_object' WHEN 7 THEN 'no_object' END AS error FROM e",
        "fx_candidate_normalize": f"""{e(4)}, c AS (
 SELECT event_id, 0 AS ord, 'energielabel' AS field_key, t AS value, k AS normalized_value, concat('Label: ', t) AS evidence, 80.0::DOUBLE AS confidence, 'exact_label' AS evidence_type, 'primary' AS record_role FROM e WHERE s = 0
 UNION ALL SELECT event_id, 1, 'energielabel', concat('A', k), concat('A', k), concat('A', k), 50.0, 'ambiguous', 'unknown' FROM e WHERE s = 0
 UNION ALL SELECT event_id, 2, 'soort', 'true', NULL, '', 10.0, 'ambiguous', 'unknown' FROM e WHERE s = 0
 UNION ALL SELECT event_id, 0, 'energielabel', k, k, concat('Label ', k), 55.0, 'semantic', 'unknown' FROM e WHERE s = 1
 UNION ALL SELECT event_id, 1, 'waarde', t, t, concat('zie ', t), 55.0, 'semantic', 'unknown' FROM e WHERE s = 1
 UNION ALL SELECT event_id, 0, 'soort', t, t, t, 55.0, 'semantic', 'unknown' FROM e WHERE s = 2
 UNION ALL SELECT event_id, 1, 'waarde', k, k, k, 55.0, 'semantic', 'unknown' FROM e WHERE s = 2) SELECT * FROM c""",
        "fx_prompt_schema": f"""{e(4)} SELECT event_id, CASE s WHEN 2 THEN 'missing:evidence' END AS "outer", CASE s WHEN 1 THEN 'missing:bedrag' WHEN 2 THEN 'type:bedrag' WHEN 3 THEN 'type:bedrag' END AS "inner" FROM e""",
        "cls_scores_record": f"""{pred} SELECT event_id, st AS nb_status, CASE WHEN c IS NOT NULL THEN event_type END AS nb_label, c AS nb_confidence, CASE st WHEN 'below_threshold' THEN concat('Confidence ', printf('%.2f', c), ' < threshold 0.85') WHEN 'rejected' THEN 'not: fout' WHEN 'failed' THEN 'model stuk' WHEN 'no_result' THEN 'No model available or no prediction generated' END AS nb_reason,
 CASE WHEN has THEN 'accepted' ELSE 'no_result' END AS bert_status, abs(b - 0.5) AS bert_margin FROM q""",
        "cls_rationale": f"""{pred} SELECT event_id, concat(concat_ws(' | ', CASE WHEN event_id % 5 = 0 THEN concat('STRONG keyword match (100% confidence) - matched keywords: ', event_type, ', iban') WHEN event_id % 5 < 3 THEN 'NB classifier (p=0.95)' ELSE 'DETERMINISTIC classifier (p=0.95)' END,
 nullif(concat_ws(', ', CASE WHEN st IN ('accepted', 'rejected') THEN concat('NB: ', event_type, ' (', printf('%.2f', c), ')') END, CASE WHEN has THEN concat('BERT: a (', printf('%.2f', b), ')') END), '')), ' (model=', CASE WHEN event_id % 2 = 0 THEN 'klein' ELSE 'default' END, ')') AS rationale FROM q""",
    }
