"""Queries over stored results and states: what validation found, which report is read, which model is used, what becomes of jobs and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import access
from ..operators import artifacts as A
from ..operators import bayes as B
from ..operators import fraud as R
from ..sources.corpus import STATEMENTS_SQL, statements, table
from ..streaming import ingest as I
from .risk import _REP, _reports


def metadata_artifacts(spark, sf_dir) -> DataFrame:
    """What the stages leave behind for each order's statement.

    The result has the statement's own account, a contra account read as of the customer's number and nation, and the last day
    shipped. Validation checks both accounts and looks for the day in the text. Orders in progress (P) have no validation yet, those
    of low priority are not verified.
    """
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    day = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.date_format(F.max("l_shipdate"), "dd-MM-yyyy").alias("datum"))
    s = statements(spark, sf_dir).select("doc_id", F.regexp_extract("text", r"IBAN: (\S+)", 1).alias("iban"), "text")
    d = o.join(s, "doc_id").join(day, "doc_id").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    contra = F.concat(F.lit("NL"), F.col("c_nationkey") + 10, F.lit("BANK"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    d = d.select("doc_id", "o_orderstatus", "o_orderpriority", "iban", contra.alias("tegenrekening"), "datum", F.col("text").contains(F.col("datum")).alias("seen"))
    wrong = [F.when(~V.iban_valid(F.col(c)), f"invalid_iban:{c}") for c in ("iban", "tegenrekening")]
    errors = F.array_compact(F.array(*wrong, F.when(~F.col("seen"), "missing_verified_required_field:datum")))
    mark = lambda c: F.struct(c.alias("verified"))
    bodies = F.array(
        F.struct(F.lit("result").alias("kind"), F.to_json(F.struct("iban", "tegenrekening", "datum")).alias("body")),
        F.struct(F.lit("validation").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.to_json(F.struct(errors.alias("errors")))).alias("body")),
        F.struct(F.lit("verified").alias("kind"), F.when(F.col("o_orderpriority") != "5-LOW", F.to_json(F.struct(mark(F.lit(True)).alias("iban"), mark(F.col("seen")).alias("datum")))).alias("body")),
    )
    return d.select("doc_id", F.explode(bodies).alias("a")).select("doc_id", "a.kind", "a.body")


def _findings(spark, sf_dir) -> DataFrame:
    return A.metadata_findings(metadata_artifacts(spark, sf_dir)).withColumnRenamed("doc_id", "o_orderkey")


def fr_invalid_iban(spark, sf_dir):
    """Accounts that validation found wrong, and required fields without evidence."""
    return _findings(spark, sf_dir).select("o_orderkey", F.array_join("invalid_ibans", ", ").alias("iban_fields"), F.array_join("unverified", ", ").alias("unverified"))


def fr_missing_verified(spark, sf_dir):
    """Required fields in the result that have no evidence."""
    s = F.explode(F.filter("signals", lambda x: x["name"] == "missing_verified_required_fields")).alias("s")
    return _findings(spark, sf_dir).select("o_orderkey", s).select("o_orderkey", "s.risk_level", "s.confidence")


def fx_rule_gate(spark, sf_dir):
    """Rules run only for documents that have verified and validation results and some data."""
    return _findings(spark, sf_dir).where("ready").select("o_orderkey")


def fr_read_fallback(spark, sf_dir):
    """The cached report, else the stored one, else the database's: urgent orders that are filled have a cache, filled ones an artifact, open ones a row."""
    report = R.report(_reports(spark, sf_dir)).select("doc_id", "risk_score", "signals")
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_orderpriority").join(report, "doc_id", "left")
    body, filled = F.to_json(F.struct("risk_score", "signals")), (F.col("o_orderstatus") == "F") & F.col("signals").isNotNull()
    kinds = F.array(F.struct(F.lit("risk").alias("kind"), body.alias("body")), F.struct(F.lit("fraud").alias("kind"), F.when(F.col("o_orderpriority") == "1-URGENT", body).alias("body")))
    kept = d.where(filled).select("doc_id", F.explode(kinds).alias("a")).select("doc_id", "a.kind", "a.body")
    rows = d.select("doc_id", "risk_score", F.when(F.col("o_orderstatus") == "O", F.to_json("signals")).alias("signals_json"))
    return A.stored_reports(rows, kept).select(F.col("doc_id").alias("o_orderkey"), "origin", F.round("risk_score", 6).alias("risk_score"), "n_signals")


def nb_model_lookup(spark, sf_dir):
    """The model for each document by its source's name, else the default one. Sources with labelled documents have models; their labels are the languages of good ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    labels = F.count_distinct(F.when(F.col("quality") == 1, F.col("lang"))).alias("labels")
    models = known.rollup("source").agg(labels, F.grouping("source").alias("all"))
    models = models.select(F.when(F.col("all") == 1, "default").otherwise(F.col("source")).alias("model"), "labels")
    return B.looked_up(d.select("doc_id", "source"), models, "source").select("doc_id", "model")


def _after_requests(spark, sf_dir) -> DataFrame:
    """Orders as documents, events as requests for the one whose number is the event's value in cents."""
    o, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "events")
    of = lambda p, f: F.when(F.col("o_orderstatus") == "P", p).when(F.col("o_orderstatus") == "F", f)
    d = o.select(F.col("o_orderkey").alias("doc_id"), of("processing", "done").otherwise("queued").alias("status"), of(45, 100).otherwise(0).alias("progress"), of("classifying", "done").alias("stage"), F.lit(None).cast("string").alias("error_message"), of(None, F.col("o_orderpriority")).alias("doc_type_slug"))
    action = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "signup", "analyse").when(F.col("event_type") == "click", "reprocess")
    return I.after_requests(d, e.select(F.col("event_id").alias("request_id"), F.round(F.col("value") * 100).cast("long").alias("doc_id"), action.alias("action"), F.col("ts").alias("at")))


def st_reprocess(spark, sf_dir):
    """Every document after all requests for it."""
    return _after_requests(spark, sf_dir).select(F.col("doc_id").alias("o_orderkey"), "status", "progress", "stage", "doc_type_slug", "queued")


def st_cancel(spark, sf_dir):
    """Documents whose last request took them out of the queue."""
    return _after_requests(spark, sf_dir).where(F.col("error_message") == I.CANCELLED).select(F.col("doc_id").alias("o_orderkey"), "status", F.col("error_message").alias("error"))


def st_job(spark, sf_dir):
    """The jobs of all statements but the cancelled ones: those without an amount fail, and urgent orders are called back."""
    s = statements(spark, sf_dir).select("doc_id", F.when(~F.col("text").contains("€"), F.concat(F.lit("geen bedrag in "), "text")).alias("failure"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "done").alias("status"), F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("https://"), "o_custkey", F.lit(".voorbeeld.nl"))).alias("callback_url"))
    gone = _after_requests(spark, sf_dir).where(F.col("error_message") == I.CANCELLED)
    return I.finished(o.join(s, "doc_id"), gone).select("doc_id", "status", F.col("error_message").alias("error"), "event", "calls_back")


def rel_api_key_check(spark, sf_dir):
    """Each order's customer shows a secret; customers' keys are active with a balance, and expire that many days after 1990 but for the first five nations."""
    c = table(spark, sf_dir, "customer")
    until = F.when(F.col("c_nationkey") >= 5, F.date_add(F.lit("1990-01-01").cast("date"), F.floor("c_acctbal").cast("int")).cast("timestamp"))
    keys = c.select(F.col("c_custkey").alias("key_id"), F.col("c_custkey").alias("user_id"), F.sha2("c_name", 256).alias("secret_hash"), (F.col("c_acctbal") > 0).alias("is_active"), until.alias("expires_at"))
    o = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    shown = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lower("c_name")).otherwise(F.col("c_name")).alias("secret"))
    d = access.checked_keys(shown, keys, F.lit("1998-01-01").cast("timestamp"))
    return d.select("o_orderkey", "owner", F.col("key_id").isNotNull().alias("valid"))


_NAMES = "fr_invalid_iban fr_missing_verified fx_rule_gate fr_read_fallback nb_model_lookup st_reprocess st_cancel st_job rel_api_key_check"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    art = f"""WITH {STATEMENTS_SQL}, shipped AS (SELECT l_orderkey AS doc_id, strftime(max(l_shipdate), '%d-%m-%Y') AS datum FROM lineitem GROUP BY l_orderkey),
art AS (SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AS ready, contains(text, datum) AS seen,
 CAST(concat('11102320', lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '2321', c_nationkey + 10) AS HUGEINT) % 97 = 1 AS valid
 FROM orders JOIN stmt ON doc_id = o_orderkey JOIN shipped USING (doc_id) JOIN customer ON c_custkey = o_custkey)"""
    after = f"""WITH {STATEMENTS_SQL}, q AS (SELECT CAST(round(value * 100) AS BIGINT) AS k, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'signup' THEN 'analyse' WHEN 'click' THEN 'reprocess' END AS a, ts, event_id FROM events),
r AS (SELECT k, arg_max(a, (ts, event_id)) AS a, bool_or(a <> 'cancel') AS again, bool_or(a = 'analyse') AS anew FROM q WHERE a IS NOT NULL GROUP BY k),
d AS (SELECT o.*, a, coalesce(again, false) AS again, coalesce(anew, false) AS anew, coalesce(a = 'cancel', false) AS gone FROM orders AS o LEFT JOIN r ON k = o_orderkey)"""
    status = "CASE WHEN gone THEN 'error' WHEN a IS NOT NULL THEN 'queued' WHEN o_orderstatus = 'P' THEN 'processing' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END"
    return {
        "st_reprocess": f"""{after} SELECT o_orderkey, {status} AS status, CASE WHEN again THEN 0 WHEN o_orderstatus = 'P' THEN 45 WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS progress,
 CASE WHEN NOT again THEN CASE o_orderstatus WHEN 'P' THEN 'classifying' WHEN 'F' THEN 'done' END END AS stage, CASE WHEN NOT anew AND o_orderstatus = 'F' THEN o_orderpriority END AS doc_type_slug, a IS NOT NULL AND NOT gone AS queued FROM d""",
        "st_cancel": f"{after} SELECT o_orderkey, 'error' AS status, '{I.CANCELLED}' AS error FROM d WHERE gone",
        "st_job": f"""{after}, j AS (SELECT doc_id, o_orderstatus = 'F' AS done, NOT contains(text, '€') AS bad, text, o_orderpriority = '1-URGENT' AS calls_back FROM d JOIN stmt ON doc_id = o_orderkey WHERE NOT gone)
SELECT doc_id, CASE WHEN bad AND NOT done THEN 'error' ELSE 'done' END AS status, CASE WHEN bad AND NOT done THEN substr(concat('geen bedrag in ', text), 1, 1000) END AS error, CASE WHEN bad THEN 'error' ELSE 'result' END AS event, calls_back FROM j""",
        "rel_api_key_check": """WITH k AS (SELECT min(c_custkey) AS owner, c_name FROM customer WHERE c_acctbal > 0 AND (c_nationkey < 5 OR DATE '1990-01-01' + CAST(floor(c_acctbal) AS INT) > DATE '1998-01-01') GROUP BY c_name)
SELECT o_orderkey, owner, owner IS NOT NULL AS valid FROM orders JOIN customer AS c ON c_custkey = o_custkey LEFT JOIN k ON k.c_name = CASE WHEN o_orderstatus = 'P' THEN lower(c.c_name) ELSE c.c_name END""",
        "fr_invalid_iban": f"{art} SELECT o_orderkey, CASE WHEN ready AND NOT valid THEN 'tegenrekening' ELSE '' END AS iban_fields, CASE WHEN ready AND NOT seen THEN 'datum' ELSE '' END AS unverified FROM art",
        "fr_missing_verified": f"{art} SELECT o_orderkey, 'MEDIUM' AS risk_level, 0.6::DOUBLE AS confidence FROM art WHERE ready AND NOT seen",
        "fx_rule_gate": f"{art} SELECT o_orderkey FROM art WHERE ready",
        "fr_read_fallback": f"""WITH {_REP}, r AS (SELECT o_orderkey, all_n, score, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'cache' WHEN o_orderstatus = 'F' THEN 'artifact' WHEN o_orderstatus = 'O' THEN 'database' END AS o FROM orders LEFT JOIN sc ON doc_id = o_orderkey)
SELECT o_orderkey, CASE WHEN all_n > 0 THEN o END AS origin, CASE WHEN all_n > 0 AND o IS NOT NULL THEN round(score, 6) END AS risk_score, CASE WHEN o IS NULL THEN 0 ELSE coalesce(all_n, 0) END AS n_signals FROM r""",
        "nb_model_lookup": """WITH k AS (SELECT source, CASE WHEN quality = 1 THEN lang END AS lang FROM documents JOIN labels USING (doc_id)), m AS (SELECT source, count(DISTINCT lang) AS n FROM k GROUP BY source), a AS (SELECT count(DISTINCT lang) AS n FROM k)
SELECT doc_id, CASE WHEN m.n > 0 THEN d.source WHEN m.n IS NULL AND (SELECT n FROM a) > 0 THEN 'default' END AS model FROM documents AS d LEFT JOIN m ON m.source = d.source""",
    }
