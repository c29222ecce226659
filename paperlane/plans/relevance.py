"""Queries over search terms, label places, and the chunks that speak of fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import relevance as L
from ..sources.corpus import STATEMENTS_SQL, statements, table
from .fields import YEAR

FIELDS = [L.Field("boeking", "Boeking"), L.Field("part", "Part", "number"), L.Field("rekening", "Rekeningafschrift", "number"), L.Field("ref", "Kenmerk", regex=r"\d{2}-\d{2}-\d{4}")]
BUDGET = 700


def _lines(spark, sf_dir):
    """A statement's lines as its chunks."""
    return statements(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("part", "chunk"))


def fx_search_terms(spark, sf_dir):
    """Terms of fields; parts stand for fields, every other one with a name that calls for synonyms."""
    p = table(spark, sf_dir, "part")
    name = F.get(F.array(*map(F.lit, ("Bouwjaar", "Energie-label", "Oppervlakte (m²)", "Type vastgoed"))), (F.col("p_partkey") % 8).cast("int"))
    label = F.concat_ws(" ", name, F.col("p_name"), F.concat(F.lit("("), "p_brand", F.lit(")")))
    return p.select("p_partkey", F.array_join(L.search_terms(F.concat(F.lit("veld_"), F.col("p_type")), label), "|").alias("terms"))


def fx_label_positions(spark, sf_dir):
    """Where a label stands in a text, whatever the case: all offsets in characters."""
    at = L.places(F.col("text"), L.place_pattern(["Part"]))
    return statements(spark, sf_dir).select("doc_id", F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("at"))


def fx_near_value(spark, sf_dir):
    """Numbers around each place of a label."""
    s = statements(spark, sf_dir).select("doc_id", "text", F.explode(L.places(F.col("text"), L.place_pattern(["Part"]))).alias("at"))
    return s.select("doc_id", "at", F.array_join(L.near_values(F.col("text"), F.col("at"), FIELDS[1], YEAR, 15, 30), " ").alias("near"))


def fx_chunk_score(spark, sf_dir):
    d = L.scored(_lines(spark, sf_dir), FIELDS, YEAR)
    told = F.transform("matches", lambda m: F.concat_ws(":", m["field"], m["label_score"], m["value_score"], m["regex_only"]))
    return d.select("doc_id", "part", "score", F.array_join(told, ",").alias("matches"))


def fx_chunk_select(spark, sf_dir):
    return L.select(_lines(spark, sf_dir), FIELDS, YEAR, budget=BUDGET)


def fx_neighbor_rule(spark, sf_dir):
    """Whether a text's neighbour would be wanted: it ends inside a sentence or table, or its label stands near an edge."""
    d = L.scored(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("chunk")), [L.Field("license", "License")], YEAR)
    return d.select("doc_id", L.wants_neighbours(F.col("chunk"), F.col("matches")).alias("wanted"))


def fx_label_context(spark, sf_dir):
    """Whether evidence has its field's label, its key, or its label's words close together."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.col("l_partkey").cast("string")
    far = "stuks " + "woord " * 11 + "aantal"
    e = F.get(F.array(F.concat(F.lit("Aantal stuks: "), n), F.concat(F.lit("hoeveelheid "), n), F.concat(F.lit("Stuks in "), n, F.lit(" ("), F.lit("aantal)")), F.lit(far), F.concat(F.lit("niets "), n), F.lit("")), (F.col("l_suppkey") % 6).cast("int"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", V.label_context(F.lit("hoeveelheid"), F.lit("Aantal stuks"), e).alias("context"))


def fx_value_in_evidence(spark, sf_dir):
    """Whether a value or its normal form stands in its evidence, as it is or without punctuation."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.col("l_partkey").cast("string")
    kind = (F.col("l_suppkey") % 6).cast("int")
    value = F.get(F.array(n, F.concat(F.lit("NR "), n), F.concat(n, F.lit(" stuks")), n, F.lit("n/a"), F.lit("--")), kind)
    normal = F.when(kind == 2, n)
    e = F.get(F.array(F.concat(F.lit("Aantal: "), n), F.concat(F.lit("zie nr-"), n), F.concat(F.lit("Aantal: "), n), F.lit("elders"), F.lit("n/a"), F.lit(None).cast("string")), kind)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", V.in_evidence(value, normal, e).alias("found"))


LINE_FIELDS = [L.Field("aantal", "Aantal", "number"), L.Field("status", "Status", "enum", ("A", "N")), L.Field("datum", "Datum", "date"), L.Field("kenmerk", "Kenmerk", "string", (), "^[1-4]")]


def fx_same_line(spark, sf_dir):
    """Labels and values on the lines of orders."""
    l = table(spark, sf_dir, "lineitem")
    t = F.concat(F.lit("Aantal: "), F.col("l_quantity").cast("int"), F.lit(" Status : "), "l_returnflag", F.lit("; Datum - "), F.when(F.col("l_linenumber") == 1, F.lit("gisteren")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit(" Kenmerk: "), F.col("l_partkey"), F.when(F.col("l_suppkey") % 5 == 0, F.lit(" een twee drie vier vijf zes")).otherwise(""))
    return L.same_line(l.select("l_orderkey", "l_linenumber", "l_partkey", t.alias("t")), LINE_FIELDS, YEAR).drop("t")


_NAMES = "fx_search_terms fx_label_positions fx_near_value fx_chunk_score fx_chunk_select fx_neighbor_rule fx_label_context fx_value_in_evidence fx_same_line"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    stmt = f"WITH {STATEMENTS_SQL}"
    n = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    lines = "ln AS (SELECT doc_id, unnest(range(0, len(l))) AS part, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM stmt)), k AS (SELECT *, CASE WHEN part = 0 THEN 'head' WHEN part = 1 THEN 'iban' WHEN starts_with(t, 'Boeking') THEN 'booking' ELSE 'dated' END AS kind, length(CAST(doc_id AS VARCHAR)) <= 5 AS near FROM ln)"
    places = "p AS (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM stmt), pl AS (SELECT * FROM p WHERE substr(text, i, 5) = 'Part ')"
    given = {
        0: "['bouw jaar', 'bouwjaar', 'construction year', 'built', 'built year']",
        1: "['energielabel', 'energie label', 'energieklasse', 'energieprestatie', 'energie certificaat', 'epc', 'duurzaamheid', 'energieprestatie-indicatoren', 'nta 8800', 'energieklasse woning']",
        2: "['m2', 'm 2', 'oppervlakte', 'vloeroppervlak', 'gebruiksoppervlakte', 'floor area', 'area']",
        3: "['vastgoedtype', 'type vastgoed', 'bedrijfsruimte', 'gebruik', 'bestemming', 'object type', 'soort vastgoed', 'bedrijfsverzamelgebouw', 'appartementsrecht']",
    }
    more = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in given.items()) + " ELSE [] END"
    named = "CASE p_partkey % 8 WHEN 0 THEN 'bouwjaar ' WHEN 1 THEN 'energie label ' WHEN 2 THEN 'oppervlakte m2 ' WHEN 3 THEN 'type vastgoed ' ELSE '' END"
    bare = "CASE p_partkey % 8 WHEN 0 THEN 'bouwjaar ' WHEN 1 THEN 'energie label ' WHEN 2 THEN 'oppervlakte ' WHEN 3 THEN 'type vastgoed ' ELSE '' END"
    return {
        "fx_search_terms": f"WITH t AS (SELECT p_partkey, list_distinct(list_concat([{n(chr(39) + 'veld_' + chr(39) + ' || p_type')}, {n(f'{named} || p_name || {chr(39)} {chr(39)} || p_brand')}, {n(f'{bare} || p_name')}], {more})) AS l FROM part), u AS (SELECT p_partkey, unnest(l) AS term FROM t) SELECT p_partkey, string_agg(term, '|' ORDER BY length(term) DESC, term) AS terms FROM u GROUP BY p_partkey",
        "fx_label_positions": f"{stmt}, {places} SELECT stmt.doc_id, coalesce(string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i), '') AS at FROM stmt LEFT JOIN pl USING (doc_id) GROUP BY stmt.doc_id",
        "fx_near_value": rf"{stmt}, {places} SELECT doc_id, (i - 1)::INT AS at, array_to_string(list_transform(regexp_extract_all(substr(text, greatest(1, i - 15), least(i - 1, 15) + 30), '\b\d{{1,5}}(?:[.,]\d{{1,3}})?\b'), lambda x: CASE WHEN regexp_full_match(x, '\d{{1,3}}\.\d{{3}}') THEN replace(x, '.', '') ELSE replace(x, ',', '.') END), ' ') AS near FROM pl",
        "fx_chunk_score": f"{stmt}, {lines} SELECT doc_id, part, CASE kind WHEN 'head' THEN CASE WHEN near THEN 250 ELSE 150 END WHEN 'iban' THEN -20 WHEN 'booking' THEN 440 ELSE 425 END AS score, CASE kind WHEN 'head' THEN CASE WHEN near THEN 'rekening:150:120:false' ELSE 'rekening:170:0:false' END WHEN 'iban' THEN '' WHEN 'booking' THEN 'boeking:170:0:false,part:150:120:false' ELSE 'part:150:120:false,ref:0:5:true' END AS matches FROM k",
        "fx_chunk_select": f"""{stmt}, {lines}, m AS (SELECT *, min(part) FILTER (kind = 'booking') OVER (PARTITION BY doc_id) AS b, min(part) FILTER (kind = 'dated') OVER (PARTITION BY doc_id) AS f FROM k),
 w AS (SELECT *, CASE WHEN part = b THEN 'label_only_fallback_for_field:boeking' WHEN part IN (2, 3) THEN 'best_for_field:part' WHEN part = 0 THEN CASE WHEN near THEN 'best_for_field:rekening' ELSE 'label_only_fallback_for_field:rekening' END WHEN part = f THEN 'regex_fallback_for_field:ref' END AS own FROM m),
 x AS (SELECT *, lag(own) OVER (PARTITION BY doc_id ORDER BY part) IS NOT NULL OR lead(own) OVER (PARTITION BY doc_id ORDER BY part) IS NOT NULL AS beside FROM w)
 SELECT doc_id, part, CASE kind WHEN 'head' THEN CASE WHEN near THEN 250 ELSE 150 END WHEN 'iban' THEN -20 WHEN 'booking' THEN 440 ELSE 425 END AS score, coalesce(own, 'context_neighbor') AS reason FROM x WHERE own IS NOT NULL OR beside""",
        "fx_neighbor_rule": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+$', '') AS t, text FROM documents WHERE text IS NOT NULL), e AS (SELECT *, length(t) AS n FROM d)
 SELECT doc_id, CASE WHEN n = 0 THEN FALSE ELSE substr(t, n, 1) NOT IN ('.', '!', '?', ':', ';') OR regexp_matches(substr(t, greatest(1, n - 239)), '(?s)(\s{2,}|\t|\|)\S*$') OR regexp_matches(substr(text, 1, 809), '(?i)\blicense\b') OR regexp_matches(substr(text, greatest(1, n - 150)), '(?is).\blicense\b') END AS wanted FROM e""",
        "fx_label_context": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 6 < 3 AS context FROM lineitem",
        "fx_value_in_evidence": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 6 < 3 AS found FROM lineitem",
        "fx_same_line": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, l_returnflag AS s, strftime(l_shipdate, '%Y-%m-%d') AS d, CAST(l_partkey AS VARCHAR) AS p FROM lineitem),
 v AS (SELECT *, 'aantal' AS field, q AS value FROM x UNION ALL SELECT *, 'status', s FROM x WHERE s <> 'R' UNION ALL SELECT *, 'datum', d FROM x WHERE l_linenumber <> 1 UNION ALL SELECT *, 'kenmerk', p FROM x WHERE p SIMILAR TO '[1-4].*' AND l_suppkey % 5 <> 0)
 SELECT l_orderkey, l_linenumber, l_partkey, field, value, 95 AS confidence, 'exact_label' AS evidence_type FROM v""",
    }
