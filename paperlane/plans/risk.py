"""Queries over risk signals and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fraud as R
from ..sources.corpus import table
from .fields import _AMOUNTS, _pick, _pick_sql

AS_OF = "1998-01-01"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def fr_unicode(spark, sf_dir):
    """Invisible characters, put into texts by number and kind so that there are some."""
    t = F.concat(F.substring("text", 1, 5), F.repeat(F.lit("\u200b"), (F.col("doc_id") % 3).cast("int")), F.when(F.col("doc_id") % 4 == 0, F.lit("\u00ad")).otherwise(""), F.substr("text", F.lit(6)))
    level, conf = R.doubtful_text((F.col("doc_id") % 10) / 10.0, F.lit(False))
    d = _docs(spark, sf_dir).select("doc_id", R.invisible_count(t).alias("count"), F.array_join(R.invisible_kinds(t), ",").alias("kinds"), level.alias("risk_level"), conf.alias("confidence"))
    return d.where("count > 0")


def fr_repetition(spark, sf_dir):
    return R.repetition(_docs(spark, sf_dir)).select("doc_id", "word", "count", "total")


def fr_legacy_anomaly(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(R.anomaly(F.col("text")), 6).alias("score"))


def fr_low_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", R.low_confidence((F.col("event_id") % 100) / 100.0)).where("s is not null")
    return e.select("event_id", F.col("s.risk_level").alias("risk_level"), F.round("s.confidence", 6).alias("confidence"))


def fr_semantic(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    s = R.semantic(label, F.lit("click"), (F.col("event_id") % 100) / 100.0, (F.col("user_id") % 20) / 100.0)
    return e.withColumn("s", s).where("s is not null").select("event_id", "s.name", "s.risk_level", F.round("s.confidence", 6).alias("confidence"))


def fr_existing(spark, sf_dir):
    """Flags of an earlier run as signals."""
    e = table(spark, sf_dir, "events")
    s = F.array_compact(F.array(R.signal(F.col("event_type") == "error", "fpdf_detected", "MEDIUM", 0.9, ""), R.signal(F.col("value") > 10, "unicode_anomalies_processed", "MEDIUM", 0.8, ""), R.signal(F.col("user_id") % 2 == 0, "repetition_patterns_processed", "LOW", 0.6, "")))
    return e.select("event_id", F.array_join(F.transform(s, lambda x: x["name"]), ",").alias("signals"))


_TOOLS = ["Adobe Acrobat", "FPDF 1.8", "wkhtmltopdf", "iLovePDF", "Python reportlab", None, "LibreOffice"]


def _pdf(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", _pick(_TOOLS).alias("producer"), F.date_format("l_shipdate", "yyyyMMdd").alias("created"), F.when(F.col("l_quantity") > 25, F.date_format("l_shipdate", "yyyyMMdd")).otherwise("19990101").alias("modified"), F.when(F.col("l_returnflag") == "A", "iemand").alias("author"))


_PDF = f"p AS (SELECT l_orderkey, l_linenumber, l_partkey, {_pick_sql(_TOOLS)} AS producer, strftime(l_shipdate, '%Y%m%d') AS created, CASE WHEN l_quantity > 25 THEN strftime(l_shipdate, '%Y%m%d') ELSE '19990101' END AS modified, CASE WHEN l_returnflag = 'A' THEN 'iemand' END AS author FROM lineitem)"


def fr_pdf_metadata(spark, sf_dir):
    p = _pdf(spark, sf_dir)
    s = R.pdf_signals(F.lit(None).cast("string"), F.col("producer"), F.col("created"), F.col("modified"), F.col("author"), F.lit(""))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform(s, lambda x: x["name"]), ",").alias("signals"))


def fr_pdf_producer_legacy(spark, sf_dir):
    return _pdf(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", R.producer_verdict(F.col("producer")).alias("verdict"))


def fr_legacy_score(spark, sf_dir):
    p = _pdf(spark, sf_dir)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", R.legacy_score(F.col("producer"), (F.col("l_partkey") % 100) / 100.0, F.col("created") != F.col("modified"), F.col("author").isNotNull()).alias("score"))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 500).cast("int").alias("size"), (F.col("l_returnflag") != "A").alias("jpeg"), (F.col("l_quantity") / 2).alias("std"), (F.col("l_tax") * 1000).alias("most"), F.col("l_discount").alias("bright"))


def fr_ela(spark, sf_dir):
    i = _images(spark, sf_dir)
    return i.withColumn("s", R.ela(F.col("size"), F.col("jpeg"), F.lit(0.0), F.col("std"), F.col("most"), F.col("bright"))).where("s is not null").select("l_orderkey", "l_linenumber", "l_partkey", "s.name", "s.category", "s.risk_level", F.round("s.confidence", 6).alias("confidence"))


def fr_pdf_image_pick(spark, sf_dir):
    """Of each file's images of at least 150 the largest JPEG, else the largest."""
    i = _images(spark, sf_dir).where("size >= 150")
    best = i.groupBy("l_orderkey").agg(F.max(F.struct("jpeg", "size", (-F.col("l_partkey")).alias("turn"))).alias("b"))
    return best.select("l_orderkey", F.col("b.jpeg").alias("jpeg"), F.col("b.size").alias("size"), (-F.col("b.turn")).alias("part"))


#: Software tags, and what each is to give.
_SOFT = {
    "Adobe Photoshop 24": ("HIGH", 0.9),
    "GIMP 2.10": ("HIGH", 0.85),
    "Canon firmware": None,
    None: None,
    "Lightroom Classic": ("HIGH", 0.85),
    "Adobe Illustrator": ("HIGH", 0.85),
    "Affinity Photo 2": ("HIGH", 0.8),
    "Affinity Designer": None,
    "Inkscape 1.2": ("MEDIUM", 0.7),
    "Paint.NET 5": ("MEDIUM", 0.7),
    "Pixelmator Pro": ("MEDIUM", 0.65),
    "Canva": ("MEDIUM", 0.65),
    "Snapseed": ("MEDIUM", 0.6),
    "MS Paint 11": ("MEDIUM", 0.65),
    "MS Paint": None,
    "Adobe Acrobat Pro": ("MEDIUM", 0.55),
    "IrfanView 4": ("LOW", 0.5),
    "Preview": ("LOW", 0.4),
    "Photoshop via Preview": ("HIGH", 0.9),
}


def fr_exif(spark, sf_dir):
    """Signals of pictures' tags, one row for each; lines of orders stand for pictures."""
    l = table(spark, sf_dir, "lineitem")
    at = lambda days: F.concat(F.date_format(F.date_add(F.to_date("l_shipdate"), days), "yyyy:MM:dd"), F.lit(" 12:00:00"))
    taken = F.when(F.col("l_linenumber") % 3 == 0, at((F.col("l_partkey") % 45).cast("int"))).when(F.col("l_linenumber") % 3 == 1, F.lit("geen datum"))
    digitized = F.when(F.col("l_suppkey") % 2 == 0, at(-(F.col("l_partkey") % 5).cast("int")))
    soft = list(_SOFT)
    s = R.exif(_pick(soft), F.when(F.col("l_suppkey") % 7 == 0, _pick(soft, "l_linenumber * 5")), at(F.lit(0)), taken, digitized, F.col("l_suppkey") % 5 == 0, F.when(F.col("l_tax") > 0.05, "Canon "), F.when(F.col("l_returnflag") == "A", "EOS").when(F.col("l_returnflag") == "N", " "))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(s).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.*")


def _rules(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    amount = F.concat(F.lit("€ "), F.regexp_replace(F.format_number(F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), 0), ",", "."), F.lit(",00"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", amount.alias("amount"), F.col("l_quantity").cast("int").cast("string").alias("other"), F.date_format("l_shipdate", "d-M-yyyy").alias("day"))


_RULES = "x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS a, CAST(l_quantity AS INT) AS b, CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def _one(spark, sf_dir, s):
    return _rules(spark, sf_dir).withColumn("s", s).where("s is not null").select("l_orderkey", "l_linenumber", "l_partkey", "s.name", "s.risk_level", "s.confidence")


def _as_of():
    return F.lit(AS_OF).cast("date")


def fr_rule_amount_range(spark, sf_dir):
    return _one(spark, sf_dir, R.amount_range("bedrag", F.col("amount"), 10000.0, 50000.0))


def fr_rule_date_max_age(spark, sf_dir):
    return _one(spark, sf_dir, R.date_max_age("datum", F.col("day"), 700, _as_of()))


def fr_rule_ratio(spark, sf_dir):
    return _one(spark, sf_dir, R.cross_field_ratio("bedrag", F.col("amount"), F.col("other"), 1000.0, 1900.0))


def fr_rule_not_expired(spark, sf_dir):
    return _one(spark, sf_dir, R.not_expired("geldig_tot", F.col("day"), _as_of()))


def fr_amount_inconsistency(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("s", R.amount_inconsistency(_pick(_AMOUNTS), F.lit("10"), F.lit("2,5")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.col("s").isNotNull().alias("inconsistent"))


def _reports(spark, sf_dir):
    """Each order's lines as its signals."""
    l = table(spark, sf_dir, "lineitem")
    level = F.when(F.col("l_quantity") > 48, "CRITICAL").when(F.col("l_quantity") > 40, "HIGH").when(F.col("l_quantity") > 20, "MEDIUM").otherwise("LOW")
    name = F.when(F.col("l_returnflag") == "A", "amount_ratio_too_low").when(F.col("l_returnflag") == "N", "geldig_tot_expired").otherwise("pdf_check")
    cat = F.when(F.col("l_returnflag") == "A", "context_mismatch").when(F.col("l_returnflag") == "N", "document_expired").otherwise("metadata")
    s = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(name.alias("name"), level.alias("risk_level"), F.round(F.col("l_discount") * 10, 2).alias("confidence"), cat.alias("category")).alias("s"))
    return l.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["s"]).alias("signals"))


_REP = """sg AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS pk, l_suppkey AS sk, CASE l_returnflag WHEN 'A' THEN 'amount_ratio_too_low' WHEN 'N' THEN 'geldig_tot_expired' ELSE 'pdf_check' END AS name,
 CASE WHEN l_quantity > 48 THEN 'CRITICAL' WHEN l_quantity > 40 THEN 'HIGH' WHEN l_quantity > 20 THEN 'MEDIUM' ELSE 'LOW' END AS lv, round(l_discount * 10, 2) AS c, l_returnflag AS f FROM lineitem),
sc AS (SELECT doc_id, least(100.0::DOUBLE, 2 * sum(CASE lv WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 30 WHEN 'HIGH' THEN 60 ELSE 100 END * c) / count(*)) AS score, count(*) AS all_n, count(*) FILTER (lv <> 'LOW') AS above, bool_or(lv = 'CRITICAL') AS crit, bool_or(lv = 'HIGH') AS high,
 string_agg(replace(name, '_', ' '), ', ' ORDER BY n, pk, sk, name) FILTER (g <= 3) AS grave FROM (SELECT *, CASE WHEN lv IN ('HIGH', 'CRITICAL') THEN row_number() OVER (PARTITION BY doc_id, lv IN ('HIGH', 'CRITICAL') ORDER BY n, pk, sk, name) END AS g FROM sg) GROUP BY doc_id),
lv AS (SELECT *, CASE WHEN score >= 70 OR crit THEN 'CRITICAL' WHEN score >= 50 OR high THEN 'HIGH' WHEN score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM sc)"""


def fr_score(spark, sf_dir):
    return R.report(_reports(spark, sf_dir)).select("doc_id", F.round("risk_score", 6).alias("risk_score"))


def fr_level(spark, sf_dir):
    return R.report(_reports(spark, sf_dir)).select("doc_id", "overall_risk")


def fr_summary(spark, sf_dir):
    return R.report(_reports(spark, sf_dir)).select("doc_id", "summary")


def fr_risk_dict(spark, sf_dir):
    r = R.report(_reports(spark, sf_dir))
    return r.select("doc_id", F.bround(F.round("risk_score", 6), 0).cast("int").alias("score"), F.array_join(F.transform("signals", lambda s: s["name"]), "; ").alias("evidence"))


def fr_advice(spark, sf_dir):
    r = _reports(spark, sf_dir)
    return r.select("doc_id", F.array_join(F.transform(R.advice(F.col("signals")), lambda a: F.concat(a["priority"], F.lit(":"), a["category"])), ",").alias("advice"))


_ADV = """a AS (SELECT *, CASE WHEN lv IN ('HIGH', 'CRITICAL') THEN 0 WHEN lv = 'MEDIUM' THEN 1 ELSE 2 END AS t FROM sg), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, f ORDER BY t, n, pk, sk, name) AS k FROM a),
c AS (SELECT doc_id, t, n, pk, sk, name, CASE f WHEN 'N' THEN CASE WHEN t = 0 THEN 'high' ELSE 'medium' END || ':document_verlopen' WHEN 'A' THEN CASE WHEN lv = 'HIGH' THEN 'high' ELSE 'medium' END || ':waarde_afwijking' ELSE CASE WHEN k = 1 THEN 'medium:pdf_metadata' END END AS card FROM b)"""


def fr_rule_load(spark, sf_dir):
    """Rules of the documents' types, from JSON; malformed ones are passed over."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slug"))
    j = F.when(F.col("slug") == "1-URGENT", '[{"validation_type":"amount_range","params":{"min":"1"}},{"validation_type":"date_not_expired"}]').when(F.col("slug") == "2-HIGH", "[{broken")
    rules = o.select("slug").distinct().select("slug", F.explode(F.from_json(j, "array<struct<validation_type: string, params: map<string, string>>>")).alias("r")).where("r.validation_type is not null")
    return o.join(F.broadcast(rules), "slug").select("o_orderkey", "r.validation_type", F.try_element_at(F.col("r.params"), F.lit("min")).alias("min"))


def ui_actionable_signals(spark, sf_dir):
    s = F.slice(F.filter("signals", lambda x: x["risk_level"] != "LOW"), 1, 5)
    return _reports(spark, sf_dir).select("doc_id", F.array_join(F.transform(s, lambda x: x["name"]), ",").alias("names"))


def ui_advice_filter(spark, sf_dir):
    a = F.filter(R.advice(F.col("signals")), lambda x: x["priority"].isin("high", "medium"))
    return _reports(spark, sf_dir).select("doc_id", F.size(a).alias("n"))


_NAMES = "fr_unicode fr_repetition fr_legacy_anomaly fr_low_confidence fr_semantic fr_existing fr_pdf_metadata fr_pdf_producer_legacy fr_legacy_score fr_ela fr_pdf_image_pick fr_exif fr_rule_amount_range fr_rule_date_max_age fr_rule_ratio fr_rule_not_expired fr_rule_load fr_amount_inconsistency fr_score fr_level fr_summary fr_advice fr_risk_dict ui_actionable_signals ui_advice_filter"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    key = "l_orderkey, l_linenumber, l_partkey"
    verdict = "CASE WHEN producer IN ('Adobe Acrobat', 'LibreOffice') THEN 'legitimate' WHEN producer IN ('FPDF 1.8', 'Python reportlab') THEN 'programmatic' WHEN producer = 'iLovePDF' THEN 'suspicious' END"
    word = r"[\p{L}\p{M}\p{N}_]"
    bad = [a for a in _AMOUNTS if a in ("99", "1.500")]
    soft = ", ".join(f"('{k}', '{v[0]}', {v[1]}::DOUBLE)" for k, v in _SOFT.items() if v)
    return {
        "fr_unicode": "SELECT * FROM (SELECT doc_id, (doc_id % 3 + (doc_id % 4 = 0)::INT)::INT AS count, concat_ws(',', CASE WHEN doc_id % 3 > 0 THEN 'Zero-width karakters' END, CASE WHEN doc_id % 4 = 0 THEN 'Soft hyphen (onzichtbaar)' END) AS kinds, CASE WHEN doc_id % 10 < 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, CASE WHEN doc_id % 10 < 6 THEN 0.6::DOUBLE ELSE 0.4 END AS confidence FROM documents WHERE text IS NOT NULL) WHERE count > 0",
        "fr_repetition": rf"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{word}{{4,}}')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS count FROM w GROUP BY ALL), t AS (SELECT *, (sum(count) OVER (PARTITION BY doc_id))::BIGINT AS total FROM c) SELECT * FROM t WHERE count > 10 AND count / total > 0.05",
        "fr_legacy_anomaly": rf"SELECT doc_id, round(CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0 ELSE len(regexp_extract_all(text, '[^\x00-\x7F]')) / length(text) * 0.6::DOUBLE + CASE WHEN len(w) > 0 THEN 1 - len(list_distinct(w)) / len(w) ELSE 0 END * 0.4::DOUBLE END, 6) AS score FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '{word}+') AS w FROM documents)",
        "fr_low_confidence": "SELECT event_id, 'MEDIUM' AS risk_level, round(1.0::DOUBLE - (event_id % 100) / 100.0::DOUBLE, 6) AS confidence FROM events WHERE event_id % 100 < 60",
        "fr_semantic": "WITH e AS (SELECT *, event_id % 5 = 0 AS u, (event_id % 100) / 100.0::DOUBLE AS c, (user_id % 20) / 100.0::DOUBLE AS m FROM events) SELECT event_id, CASE WHEN u THEN 'semantic_context_available' ELSE 'semantic_context_mismatch' END AS name, CASE WHEN NOT u AND c >= 0.75 AND m >= 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, round(CASE WHEN u THEN least(c, 0.6) ELSE least(c, 0.85) END, 6) AS confidence FROM e WHERE u OR event_type <> 'click'",
        "fr_existing": "SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'fpdf_detected' END, CASE WHEN value > 10 THEN 'unicode_anomalies_processed' END, CASE WHEN user_id % 2 = 0 THEN 'repetition_patterns_processed' END) AS signals FROM events",
        "fr_pdf_metadata": f"WITH {_PDF} SELECT {key}, concat_ws(',', CASE WHEN producer IN ('FPDF 1.8', 'wkhtmltopdf') THEN 'suspicious_pdf_creator' END, CASE WHEN created <> modified THEN 'pdf_date_mismatch' END, CASE WHEN author IS NULL THEN 'missing_metadata' END) AS signals FROM p",
        "fr_pdf_producer_legacy": f"WITH {_PDF} SELECT {key}, {verdict} AS verdict FROM p",
        "fr_legacy_score": f"WITH {_PDF} SELECT {key}, least(100, CASE WHEN {verdict} IN ('programmatic', 'suspicious') THEN 30 ELSE 0 END + CASE WHEN l_partkey % 100 > 30 THEN floor((l_partkey % 100) / 100.0::DOUBLE * 40) ELSE 0 END + CASE WHEN created <> modified THEN 20 ELSE 0 END + CASE WHEN author IS NOT NULL THEN 50 ELSE 0 END)::INT AS score FROM p",
        "fr_ela": f"""WITH i AS (SELECT {key}, l_partkey % 500 AS size, l_quantity / 2 AS std, l_tax * 1000 AS most, l_discount AS bright FROM lineitem WHERE l_returnflag <> 'A'),
 c AS (SELECT *, greatest(0.5::DOUBLE, least(0.95::DOUBLE, greatest((std - 2) / 20, (most - 10) / 40 * 0.8::DOUBLE, CASE WHEN bright > 0.01 THEN least(1.0::DOUBLE, bright / 0.1::DOUBLE) * 0.7::DOUBLE ELSE 0 END))) AS base FROM i WHERE size >= 150 AND (std > 2 OR most > 10 OR bright > 0.01))
 SELECT {key}, 'ela_manipulation_detected' AS name, 'manipulation' AS category, CASE WHEN std > 20 OR most > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, round(CASE WHEN size < 300 THEN base * 0.8::DOUBLE ELSE base END, 6) AS confidence FROM c""",
        "fr_pdf_image_pick": "WITH i AS (SELECT l_orderkey, l_returnflag <> 'A' AS jpeg, l_partkey % 500 AS size, l_partkey FROM lineitem WHERE l_partkey % 500 >= 150) SELECT l_orderkey, jpeg, size, l_partkey AS part FROM i QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY jpeg DESC, size DESC, l_partkey) = 1",
        "fr_exif": f"""WITH t(tag, level, conf) AS (VALUES {soft}),
 x AS (SELECT *, {_pick_sql(list(_SOFT))} AS s1, CASE WHEN l_suppkey % 7 = 0 THEN {_pick_sql(list(_SOFT), 'l_linenumber * 5')} END AS s2,
  CASE WHEN l_linenumber % 3 = 0 THEN l_partkey % 45 WHEN l_suppkey % 2 = 0 THEN l_partkey % 5 END AS days, trim(concat_ws(' ', CASE WHEN l_tax > 0.05 THEN 'Canon' END, CASE WHEN l_returnflag = 'A' THEN 'EOS' END)) AS camera FROM lineitem)
 SELECT {key}, 'image_editing_software' AS name, level AS risk_level, conf AS confidence, 'manipulation' AS category, tag AS detail FROM (SELECT * FROM x JOIN t ON s1 = tag UNION ALL SELECT * FROM x JOIN t ON s2 = tag)
 UNION ALL SELECT {key}, 'exif_date_mismatch', CASE WHEN days > 30 THEN 'HIGH' ELSE 'MEDIUM' END, 0.8, 'manipulation', CAST(days AS VARCHAR) FROM x WHERE days > 1
 UNION ALL SELECT {key}, 'exif_gps_present', 'LOW', 0.5, 'metadata', 'gps' FROM x WHERE l_suppkey % 5 = 0
 UNION ALL SELECT {key}, 'exif_camera_metadata', 'LOW', 0.4, 'metadata', camera FROM x WHERE camera <> ''""",
        "fr_rule_amount_range": f"WITH {_RULES} SELECT {key}, CASE WHEN a < 10000 THEN 'bedrag_below_minimum' ELSE 'bedrag_above_maximum' END AS name, 'MEDIUM' AS risk_level, 0.8::DOUBLE AS confidence FROM x WHERE a < 10000 OR a > 50000",
        "fr_rule_date_max_age": f"WITH {_RULES}, y AS (SELECT *, date_diff('day', d, DATE '{AS_OF}') AS o FROM x) SELECT {key}, 'datum_too_old' AS name, CASE WHEN o > 1400 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, 0.9::DOUBLE AS confidence FROM y WHERE o > 700",
        "fr_rule_ratio": f"WITH {_RULES}, y AS (SELECT *, a::DOUBLE / b AS r FROM x WHERE b <> 0) SELECT {key}, CASE WHEN r < 1000 THEN 'bedrag_ratio_too_low' ELSE 'bedrag_ratio_too_high' END AS name, CASE WHEN r < 1000 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, CASE WHEN r < 1000 THEN 0.85::DOUBLE ELSE 0.75 END AS confidence FROM y WHERE r < 1000 OR r > 1900",
        "fr_rule_not_expired": f"WITH {_RULES}, y AS (SELECT *, date_diff('day', d, DATE '{AS_OF}') AS o FROM x) SELECT {key}, 'geldig_tot_expired' AS name, CASE WHEN o > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, 0.95::DOUBLE AS confidence FROM y WHERE o > 0",
        "fr_rule_load": "SELECT o_orderkey, t AS validation_type, CASE WHEN t = 'amount_range' THEN '1' END AS min FROM orders, (VALUES ('amount_range'), ('date_not_expired')) v(t) WHERE o_orderpriority = '1-URGENT'",
        "fr_amount_inconsistency": f"SELECT {key}, coalesce(v IN ({', '.join(repr(b) for b in bad)}), FALSE) AS inconsistent FROM (SELECT *, {_pick_sql(_AMOUNTS)} AS v FROM lineitem)",
        "fr_score": f"WITH {_REP} SELECT doc_id, round(score, 6) AS risk_score FROM sc",
        "fr_level": f"WITH {_REP} SELECT doc_id, level AS overall_risk FROM lv",
        "fr_summary": f"WITH {_REP}, z AS (SELECT *, CASE WHEN above > 0 THEN above ELSE all_n END AS k FROM lv) SELECT doc_id, concat(CASE level WHEN 'LOW' THEN 'Laag risico' WHEN 'MEDIUM' THEN 'Gemiddeld risico' WHEN 'HIGH' THEN 'Hoog risico' ELSE 'Kritiek risico' END, ': ', k, ' signaal', CASE WHEN k <> 1 THEN 'en' ELSE '' END, ' gedetecteerd.', CASE WHEN grave IS NOT NULL THEN concat(' Belangrijkste: ', grave) ELSE '' END) AS summary FROM z",
        "fr_risk_dict": f"WITH {_REP}, g AS (SELECT doc_id, string_agg(name, '; ' ORDER BY n, pk, sk, name) AS evidence FROM sg GROUP BY doc_id) SELECT doc_id, round_even(round(score, 6), 0)::INT AS score, evidence FROM sc JOIN g USING (doc_id)",
        "fr_advice": f"WITH {_REP}, {_ADV} SELECT doc_id, coalesce(string_agg(card, ',' ORDER BY t, n, pk, sk, name), '') AS advice FROM c GROUP BY doc_id",
        "ui_actionable_signals": f"WITH {_REP}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, pk, sk, name) AS k FROM sg WHERE lv <> 'LOW'), a AS (SELECT doc_id, string_agg(name, ',' ORDER BY k) AS names FROM r WHERE k <= 5 GROUP BY doc_id) SELECT doc_id, coalesce(names, '') AS names FROM sc LEFT JOIN a USING (doc_id)",
        "ui_advice_filter": f"WITH {_REP}, {_ADV} SELECT doc_id, count(card) AS n FROM c GROUP BY doc_id",
    }
