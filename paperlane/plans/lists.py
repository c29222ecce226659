"""Queries of the relational surface. Customers stand for subjects, orders for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access
from ..operators import catalog as C
from ..sources.corpus import table


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_normalized"), F.col("c_mktsegment").alias("context"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("doc_type"), F.expr("cast(floor(o_totalprice) as bigint) % 101").alias("risk"), F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"))


_S = "s AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) AS name_normalized, c_mktsegment AS context FROM customer)"
_D = "d AS (SELECT o_orderkey AS id, o_custkey AS subject_id, o_orderstatus AS status, o_orderdate AS created_at, o_orderpriority AS doc_type, CAST(floor(o_totalprice) AS BIGINT) % 101 AS risk, concat('order-', o_orderkey, '.pdf') AS filename FROM orders)"


def rel_list_documents(spark, sf_dir):
    d = C.page(documents(spark, sf_dir), subjects(spark, sf_dir), {"status": "O", "subject_id": None}, 50, 20)
    return d.select("id", "subject_id", "subject_name", "status", "created_at")


def rel_list_count(spark, sf_dir):
    return documents(spark, sf_dir).where("status = 'O'").agg(F.count("*").alias("total"))


def rel_by_reference(spark, sf_dir):
    d = documents(spark, sf_dir).where("doc_type = '1-URGENT'")
    return C.page(d, subjects(spark, sf_dir), {}, 20).select("id", "subject_name", "created_at")


def _typed(spark, sf_dir):
    d = documents(spark, sf_dir)
    meta = F.create_map(F.lit("total"), F.col("risk").cast("string"), F.lit("status"), F.when(F.col("status") == "O", F.col("status")))
    return d.select("id", F.col("doc_type").alias("slug"), F.when(F.col("risk") % 10 != 0, meta).alias("metadata"))


def _fields(spark, sf_dir):
    """Required fields of each type seen: total and status, and for urgent ones iban."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("slug")).distinct()
    keys = F.when(F.col("slug") == "1-URGENT", F.array(F.lit("total"), F.lit("status"), F.lit("iban"))).otherwise(F.array(F.lit("total"), F.lit("status")))
    return t.select("slug", F.explode(keys).alias("key"), F.lit(True).alias("required"))


def rel_missing_required(spark, sf_dir):
    return C.missing_required(_typed(spark, sf_dir), _fields(spark, sf_dir)).select("id", F.array_join("missing", ",").alias("missing"))


_MISSING = "SELECT o_orderkey AS id, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 101 % 10 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderpriority = '1-URGENT' THEN 'iban' END, CASE WHEN o_orderstatus <> 'O' THEN 'status' END) END AS missing FROM orders"


def _hashed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))


def rel_duplicate_of(spark, sf_dir):
    return C.duplicate_of(_hashed(spark, sf_dir)).select("id", "duplicate_of")


_DUP = "SELECT doc_id AS id, CASE WHEN count(*) OVER w > 1 THEN CASE WHEN doc_id = min(doc_id) OVER w THEN (SELECT min(b.doc_id) FROM documents b WHERE b.text = a.text AND b.doc_id <> a.doc_id) ELSE min(doc_id) OVER w END END AS duplicate_of FROM documents a WINDOW w AS (PARTITION BY text)"


def rel_get_document(spark, sf_dir):
    """One document's view: status, risk, missing fields, and the oldest other one with the same content; orders stand for files, equal in customer and type."""
    d = documents(spark, sf_dir)
    m = rel_missing_required(spark, sf_dir)
    twins = C.duplicate_of(d.select("id", F.sha2(F.concat_ws("|", "subject_id", "doc_type"), 256).alias("sha256"))).select("id", "duplicate_of")
    return d.join(m, "id").join(twins, "id", "left").select("id", "status", "risk", "missing", "duplicate_of", C.risk_band(F.col("risk")).alias("level"))


def rel_subject_search(spark, sf_dir):
    return C.search_subjects(subjects(spark, sf_dir), "customer#0000001_", "BUILDING", 20).select("id", "name", "context")


def rel_subject_by_name_grouped(spark, sf_dir):
    s = C.subjects_by_context(subjects(spark, sf_dir), "9")
    return s.select("context", F.size("subjects").alias("n"), F.array_join(F.transform("subjects", lambda x: x["name"]), ",").alias("names"))


def rel_subject_documents(spark, sf_dir):
    s = subjects(spark, sf_dir).agg(F.min("id").alias("subject_id"))
    d = documents(spark, sf_dir).join(F.broadcast(s), "subject_id")
    return C.page(d, subjects(spark, sf_dir), {}, 50).select("id", "subject_name", "created_at")


def _events_as_subjects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("name_normalized"), F.when(F.col("event_id") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("context"), F.col("event_id").alias("id"))


def rel_subject_create_unique(spark, sf_dir):
    return C.create_unique(subjects(spark, sf_dir), _events_as_subjects(spark, sf_dir), ["name_normalized", "context"]).select("name_normalized", "context", "id")


def rel_mcp_list_documents(spark, sf_dir):
    return documents(spark, sf_dir).where("doc_type = '2-HIGH' and status = 'F'").orderBy(F.desc("created_at"), F.desc("id")).limit(30).select("id", "filename", "status")


def rel_mcp_list_references(spark, sf_dir):
    return subjects(spark, sf_dir).where(F.col("name").ilike("%CUSTOMER%7") & (F.col("context") == "BUILDING")).select("id", "name")


def rel_mcp_search_documents(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.search_documents(documents(spark, sf_dir), texts, "THE ", min_risk=10, max_risk=90, limit=100).select("id", "risk", "created_at")


def rel_high_risk(spark, sf_dir):
    return C.high_risk(documents(spark, sf_dir), level="HIGH", limit=100).select("id", "risk", "level")


def rel_high_risk_default(spark, sf_dir):
    return C.high_risk(documents(spark, sf_dir), limit=100).select("id", "risk", "level")


def risk_band(spark, sf_dir):
    return documents(spark, sf_dir).select("id", C.risk_band(F.when(F.col("risk") != 7, F.col("risk"))).alias("band"))


def rel_list_signals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    source = F.coalesce(F.when(F.col("event_type").isin("click", "view"), "builtin"), F.lit("user"))
    return e.groupBy(source.alias("source"), F.col("event_type").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("n_large")).orderBy(F.desc("source"), "key")


def rel_list_types_policy(spark, sf_dir):
    """The list of types asked for all, with and without a policy; a type's name gives its policy: none, an empty one or a real one."""
    f = _fields(spark, sf_dir).groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("fields"))
    n = documents(spark, sf_dir).groupBy(F.col("doc_type").alias("slug")).agg(F.count("*").alias("n_documents"))
    policy = F.when(F.col("slug").startswith("1") | F.col("slug").startswith("3"), '{"requirements": []}').when(F.col("slug").startswith("2"), "{}")
    types = f.join(n, "slug", "left").withColumns({"name": F.substr("slug", F.lit(3)), "policy": policy})
    asked = [C.types_by_policy(types, has).withColumn("asked", F.lit(word)) for has, word in ((None, "all"), (True, "with"), (False, "without"))]
    return asked[0].unionByName(asked[1]).unionByName(asked[2]).select("asked", "slug", "name", "fields", "n_documents", "with_policy")


def rel_unique_checks(spark, sf_dir):
    """Names as they would be checked on writing: how many other types bear them. Customers stand for types, their segments for names."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slug"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string"))).alias("name"))
    checks = t.select(F.upper("name").alias("name"), F.when(F.col("slug") % 3 != 0, F.col("slug")).alias("except_slug"))
    return C.taken(checks, t)


def rel_delete_guard(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    used = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).groupBy("key").agg(F.count("*").alias("used"))
    return n.join(used, "key", "left").select("name", F.coalesce("used", F.lit(0)).alias("used"), F.col("used").isNull().alias("may_delete"))


def _versions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("weight"), (F.col("c_custkey") % 5 == 0).alias("builtin"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 == 0, F.upper("c_name")).alias("label"), F.lit(1.0).alias("weight"))
    return old, new


def rel_signals_crud(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return C.upsert(old, new, ["key"], "builtin").select("key", "label", "weight", F.coalesce("builtin", F.lit(False)).alias("builtin"))


_UPSERT = """WITH o AS (SELECT c_custkey AS key, c_name AS label, c_acctbal AS weight, c_custkey % 5 = 0 AS builtin FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) END AS label, 1.0::DOUBLE AS weight FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.key, n.key) AS key, CASE WHEN builtin THEN o.label ELSE coalesce(n.label, o.label) END AS label, CASE WHEN builtin THEN o.weight ELSE coalesce(n.weight, o.weight) END AS weight, coalesce(builtin, FALSE) AS builtin FROM o FULL JOIN n ON o.key = n.key"""


def cfg_import(spark, sf_dir):
    """The rows an import refuses because a built-in has their key."""
    old, new = _versions(spark, sf_dir)
    return new.join(old.where("builtin").select("key"), "key", "left_semi").select("key")


def cfg_export(spark, sf_dir):
    old, _ = _versions(spark, sf_dir)
    return old.where("not builtin").select("key", F.to_json(F.struct("key", "label")).alias("entry"))


def cfg_settings(spark, sf_dir):
    """Typed settings: a stored value, where it parses, over the default."""
    e = table(spark, sf_dir, "events")
    v = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    on = F.lower(F.col("event_type")).isin("true", "1", "yes", "on", "click")
    return e.select("event_id", F.coalesce(F.when(v > 50, v), F.lit(180)).alias("timeout"), on.alias("enabled"))


def rel_queue_backlog(spark, sf_dir):
    return documents(spark, sf_dir).where("status = 'P'").orderBy("id").select("id", "created_at")


def _feedback(spark, sf_dir):
    d = documents(spark, sf_dir)
    fb = F.when(F.col("risk") % 3 == 0, "confirmed").when(F.col("risk") % 3 == 1, "rejected")
    return d.select("id", F.when(F.col("status") == "F", "done").otherwise("queued").alias("status"), fb.alias("feedback"), F.when(F.col("risk") % 5 == 0, "unknown").otherwise(F.col("doc_type")).alias("predicted"), F.when(F.col("risk") % 2 == 0, "3-MEDIUM").alias("corrected"))


def rel_feedback(spark, sf_dir):
    return C.training_feedback(_feedback(spark, sf_dir)).select("id", "label")


def _users(spark, sf_dir):
    role = F.get(F.array(*map(F.lit, ("user", "admin", "super_admin", "user"))), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), "c_custkey", F.lit("@voorbeeld.nl")).alias("email"), F.col("c_name").alias("name"), role.alias("role"), (F.col("c_custkey") % 11 > 0).alias("is_active"))


def _requests(spark, sf_dir):
    """A request for each order: by its customer, of a kind, for a user and with values that follow from its number."""
    k = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    return table(spark, sf_dir, "orders").select(
        k.alias("request_id"),
        F.col("o_custkey").alias("actor_id"),
        pick(("create", "update", "delete", "reset", "block"), k).alias("action"),
        F.when(F.expr("o_orderkey div 5 % 6 = 0"), F.col("o_custkey")).otherwise(F.expr("o_orderkey div 8")).alias("target_id"),
        F.concat(F.lit(" C"), F.expr("o_orderkey div 7"), F.lit("@Voorbeeld.nl")).alias("email"),
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("name"),
        pick((None, "user", "user", "user", "user", "user", "admin", "super_admin", "boss"), k).alias("role"),
        (k % 2 == 0).alias("is_active"),
        F.repeat(F.lit("x"), (6 + k % 8).cast("int")).alias("password"),
    )


def rel_users(spark, sf_dir):
    """What becomes of each request to make, change, delete or reset a user."""
    return access.judged_requests(_requests(spark, sf_dir), _users(spark, sf_dir)).select("request_id", "action", "reason")


def rel_users_after(spark, sf_dir):
    """The users once the accepted requests are carried out."""
    u = _users(spark, sf_dir)
    return access.changed_users(u, access.judged_requests(_requests(spark, sf_dir), u))


def rel_row_level_access(spark, sf_dir):
    """Keys that user 7 sees, and that user 8, an admin, sees."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    seen = lambda viewer, role: access.visible(e, viewer, role).select(F.lit(viewer).alias("viewer"), "event_id", "user_id")
    return seen(7, "user").unionByName(seen(8, "admin"))


def ui_merge_latest(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "status", "risk")
    second = d.where("risk > 50").withColumn("status", F.lit("seen"))
    return C.latest_by_id(d, second)


def ui_recent_done(spark, sf_dir):
    return documents(spark, sf_dir).where("status = 'F'").orderBy(F.desc("created_at"), F.desc("id")).limit(6).select("id")


def src_cache_index(spark, sf_dir):
    """Files whose text must be read anew: not cached with the same hash."""
    h = _hashed(spark, sf_dir)
    cached = h.where("id % 3 <> 0").select("id", F.when(F.col("id") % 7 == 0, F.lit("stale")).otherwise(F.col("sha256")).alias("old"))
    j = h.join(cached, "id", "left")
    return j.select("id", (F.coalesce(F.col("old") == F.col("sha256"), F.lit(False))).alias("reuse"))


def queries() -> dict:
    names = "rel_list_documents rel_list_count rel_by_reference rel_missing_required rel_duplicate_of rel_get_document rel_subject_search rel_subject_by_name_grouped rel_subject_documents rel_subject_create_unique rel_mcp_list_documents rel_mcp_list_references rel_mcp_search_documents rel_high_risk rel_high_risk_default risk_band rel_list_signals rel_list_types_policy rel_unique_checks rel_delete_guard rel_signals_crud cfg_import cfg_export cfg_settings rel_queue_backlog rel_feedback rel_users rel_users_after rel_row_level_access ui_merge_latest ui_recent_done src_cache_index"
    return {n: globals()[n] for n in names.split()}


_BAND = "CASE WHEN {0} >= 70 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' WHEN {0} IS NOT NULL THEN 'LOW' END"


_JUDGED_SQL = """u AS (SELECT c_custkey AS id, concat('c', c_custkey, '@voorbeeld.nl') AS email, c_name AS name, CASE c_custkey % 4 WHEN 1 THEN 'admin' WHEN 2 THEN 'super_admin' ELSE 'user' END AS role, c_custkey % 11 > 0 AS is_active FROM customer),
 q AS (SELECT o_orderkey AS request_id, o_custkey AS actor_id, CASE o_orderkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'reset' ELSE 'block' END AS action, CASE WHEN o_orderkey // 5 % 6 = 0 THEN o_custkey ELSE o_orderkey // 8 END AS target_id,
   concat('c', o_orderkey // 7, '@voorbeeld.nl') AS email, o_orderpriority AS name, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 6 THEN 'admin' WHEN 7 THEN 'super_admin' WHEN 8 THEN 'boss' ELSE 'user' END AS role, o_orderkey % 2 = 0 AS is_active, 6 + o_orderkey % 8 AS n FROM orders),
 j AS (SELECT q.*, CASE WHEN a.id IS NULL OR (action = 'delete' AND a.role = 'admin') THEN 'actor' WHEN action IN ('create', 'update') AND q.role = 'boss' THEN 'role' WHEN action IN ('create', 'reset') AND n < 8 THEN 'password'
   WHEN action = 'delete' AND target_id = actor_id THEN 'self' WHEN action IN ('update', 'delete', 'reset') AND w.id IS NULL THEN 'target'
   WHEN a.role = 'admin' AND ((action IN ('create', 'update') AND q.role LIKE '%admin') OR (action IN ('update', 'reset') AND w.role LIKE '%admin')) THEN 'rank'
   WHEN action = 'update' AND target_id = actor_id AND q.role <> a.role THEN 'own_role' WHEN action = 'create' AND q.email IN (SELECT email FROM u) THEN 'email' WHEN action = 'block' THEN 'action' END AS said
  FROM q LEFT JOIN u a ON a.id = actor_id AND a.is_active AND a.role LIKE '%admin' LEFT JOIN u w ON w.id = target_id),
 judged AS (SELECT *, CASE WHEN said IS NULL AND action = 'create' AND row_number() OVER (PARTITION BY said, action, email ORDER BY request_id) > 1 THEN 'email' ELSE said END AS reason FROM j)"""


def oracle_sql() -> dict[str, str]:
    band = _BAND.format("risk")
    return {
        "rel_list_documents": f"WITH {_S}, {_D} SELECT d.id, subject_id, name AS subject_name, status, created_at FROM d LEFT JOIN s ON subject_id = s.id WHERE status = 'O' ORDER BY created_at DESC, d.id DESC LIMIT 50 OFFSET 20",
        "rel_list_count": "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'",
        "rel_by_reference": f"WITH {_S}, {_D} SELECT d.id, name AS subject_name, created_at FROM d LEFT JOIN s ON subject_id = s.id WHERE doc_type = '1-URGENT' ORDER BY created_at DESC, d.id DESC LIMIT 20",
        "rel_missing_required": _MISSING,
        "rel_duplicate_of": _DUP,
        "rel_get_document": f"WITH {_D}, m AS ({_MISSING}), t AS (SELECT id, CASE WHEN id > min(id) OVER w THEN min(id) OVER w ELSE min(id) OVER (PARTITION BY subject_id, doc_type ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END AS duplicate_of FROM d WINDOW w AS (PARTITION BY subject_id, doc_type)) SELECT id, status, risk, missing, duplicate_of, {band} AS level FROM d JOIN m USING (id) JOIN t USING (id)",
        "rel_subject_search": f"WITH {_S} SELECT id, name, context FROM s WHERE name_normalized LIKE '%customer#0000001_%' AND context = 'BUILDING' ORDER BY name, id LIMIT 20",
        "rel_subject_by_name_grouped": f"WITH {_S} SELECT context, count(*) AS n, string_agg(name, ',' ORDER BY name, id) AS names FROM s WHERE name_normalized LIKE '%9%' GROUP BY context",
        "rel_subject_documents": f"WITH {_S}, {_D} SELECT d.id, name AS subject_name, created_at FROM d JOIN s ON subject_id = s.id WHERE subject_id = (SELECT min(id) FROM s) ORDER BY created_at DESC, d.id DESC LIMIT 50",
        "rel_subject_create_unique": f"WITH {_S}, e AS (SELECT concat('customer#', lpad(CAST(user_id AS VARCHAR), 9, '0')) AS name_normalized, CASE WHEN event_id % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS context, event_id AS id FROM events) SELECT name_normalized, context, min(id) AS id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.name_normalized = e.name_normalized AND s.context = e.context) GROUP BY ALL",
        "rel_mcp_list_documents": f"WITH {_D} SELECT id, filename, status FROM d WHERE doc_type = '2-HIGH' AND status = 'F' ORDER BY created_at DESC, id DESC LIMIT 30",
        "rel_mcp_list_references": f"WITH {_S} SELECT id, name FROM s WHERE name ILIKE '%CUSTOMER%7' AND context = 'BUILDING'",
        "rel_mcp_search_documents": f"WITH {_D} SELECT id, risk, created_at FROM d LEFT JOIN documents x ON x.doc_id = d.id WHERE risk BETWEEN 10 AND 90 AND (coalesce(contains(lower(text), 'the '), FALSE) OR contains(lower(filename), 'the ')) ORDER BY created_at DESC, id DESC LIMIT 100",
        "rel_high_risk": f"WITH {_D} SELECT id, risk, {band} AS level FROM d WHERE risk >= 50 AND risk < 75 ORDER BY risk DESC, created_at DESC, id DESC LIMIT 100",
        "rel_high_risk_default": f"WITH {_D} SELECT id, risk, {band} AS level FROM d WHERE risk >= 50 ORDER BY risk DESC, created_at DESC, id DESC LIMIT 100",
        "risk_band": f"WITH {_D} SELECT id, {_BAND.format('CASE WHEN risk <> 7 THEN risk END')} AS band FROM d",
        "rel_list_signals": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'builtin' ELSE 'user' END AS source, event_type AS key, count(*) AS n, count(*) FILTER (value > 10) AS n_large FROM events GROUP BY ALL",
        "rel_list_types_policy": "WITH t AS (SELECT o_orderpriority AS slug, substr(o_orderpriority, 3) AS name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'iban,status,total' ELSE 'status,total' END AS fields, count(*) AS n_documents, substr(o_orderpriority, 1, 1) IN ('1', '3') AS with_policy FROM orders GROUP BY ALL) SELECT 'all' AS asked, * FROM t UNION ALL SELECT CASE WHEN with_policy THEN 'with' ELSE 'without' END, * FROM t",
        "rel_unique_checks": "WITH t AS (SELECT c_custkey AS slug, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE concat(c_mktsegment, c_custkey % 50) END AS name FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY lower(name)) AS n FROM t) SELECT upper(name) AS name, CASE WHEN slug % 3 <> 0 THEN slug END AS except_slug, n - CASE WHEN slug % 3 <> 0 THEN 1 ELSE 0 END AS n FROM n",
        "rel_delete_guard": "SELECT n_name AS name, count(s_suppkey) AS used, count(s_suppkey) = 0 AS may_delete FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
        "rel_signals_crud": _UPSERT,
        "cfg_import": "SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 0",
        "cfg_export": "SELECT c_custkey AS key, concat('{\"key\":', c_custkey, ',\"label\":\"', c_name, '\"}') AS entry FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0",
        "cfg_settings": "SELECT event_id, coalesce(CASE WHEN TRY_CAST(props->>'$.k' AS INT) > 50 THEN TRY_CAST(props->>'$.k' AS INT) END, 180) AS timeout, event_type = 'click' AS enabled FROM events",
        "rel_queue_backlog": f"WITH {_D} SELECT id, created_at FROM d WHERE status = 'P'",
        "rel_feedback": f"WITH {_D}, f AS (SELECT id, status, risk % 3 AS k, CASE WHEN risk % 5 = 0 THEN 'unknown' ELSE doc_type END AS predicted, CASE WHEN risk % 2 = 0 THEN '3-MEDIUM' END AS corrected FROM d), g AS (SELECT id, CASE WHEN k = 1 THEN coalesce(corrected, predicted) ELSE predicted END AS label FROM f WHERE status = 'F' AND k IN (0, 1)) SELECT * FROM g WHERE label <> 'unknown'",
        "rel_users": f"WITH {_JUDGED_SQL} SELECT request_id, action, reason FROM judged",
        "rel_users_after": f"""WITH {_JUDGED_SQL}, ok AS (SELECT * FROM judged WHERE reason IS NULL),
 gone AS (SELECT target_id FROM ok WHERE action = 'delete'),
 upd AS (SELECT target_id, arg_max(trim(name), request_id) AS n, arg_max(role, request_id) AS r, arg_max(is_active, request_id) AS a FROM ok WHERE action = 'update' GROUP BY target_id)
 SELECT id, email, coalesce(n, name) AS name, coalesce(r, role) AS role, coalesce(a, is_active) AS is_active, NULL::BIGINT AS made_by FROM u LEFT JOIN upd ON target_id = id WHERE id NOT IN (SELECT target_id FROM gone)
 UNION ALL SELECT NULL, email, trim(name), coalesce(role, 'user'), true, request_id FROM ok WHERE action = 'create'""",
        "rel_row_level_access": "SELECT 7 AS viewer, event_id, user_id FROM events WHERE user_id = 7 UNION ALL SELECT 8, event_id, user_id FROM events",
        "ui_merge_latest": f"WITH {_D} SELECT id, CASE WHEN risk > 50 THEN 'seen' ELSE status END AS status, risk FROM d",
        "ui_recent_done": f"WITH {_D} SELECT id FROM d WHERE status = 'F' ORDER BY created_at DESC, id DESC LIMIT 6",
        "src_cache_index": "SELECT doc_id AS id, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS reuse FROM documents",
    }
