"""Queries over samples, chunks, conversations, model answers, files and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import jsonrepair as J
from ..functions import text as T
from ..operators import dialogue as D
from ..operators import prep as P
from ..sources import files as S
from ..sources.corpus import STATEMENTS_SQL, statements, table
from ..streaming import ingest as I

MARKERS = [("part 5", False), (r"part \d*7\b", True), ("(", True)]


def prep_sample(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", P.sample(F.col("text"), MARKERS, 300).alias("sample"))


def prep_skip_marker(spark, sf_dir):
    m = P.cut_at_marker(F.col("text"), MARKERS)
    return statements(spark, sf_dir).select("doc_id", m["marker"].alias("marker"), m["position"].alias("position"))


def prep_skip_training(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", F.length(P.cut_for_training(F.col("text"), MARKERS)).alias("n"))


def chunk_split(spark, sf_dir):
    return P.chunks(table(spark, sf_dir, "documents")).select("doc_id", "part", "start", F.length("chunk").alias("n"), F.md5("chunk").alias("md5"))


def chunk_pages(spark, sf_dir):
    """Chunks numbered over all of a conversation's pages that are not blank."""
    c = table(spark, sf_dir, "conversations")
    pages = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    one = pages.select("conv_id", F.posexplode(F.filter("p", lambda x: F.trim(x["text"]) != "")).alias("page", "x"))
    parts = P.chunks(one.select((F.col("conv_id") * 100000 + F.col("page")).alias("doc_id"), F.col("x.text").alias("text")), 500, 50)
    w = F.row_number().over(Window.partitionBy("conv_id").orderBy("page", "part"))
    d = parts.select(F.expr("doc_id div 100000").alias("conv_id"), (F.col("doc_id") % 100000).alias("page"), "part", F.length("chunk").alias("n"))
    return d.withColumn("chunk_num", w)


def fx_path_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.when(F.length("text") > P.CHUNK, "chunks").otherwise("whole").alias("route"))


def table_like(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", P.table_like(F.col("text")).alias("table_like"))


def words_within_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", P.words_near(F.split(F.lower("text"), " "), F.array(F.lit("the"), F.lit("of"))).alias("near"))


def norm_search(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.search_text(F.concat(F.lit("Één_m² "), F.col("p_name"), F.lit("--"), F.col("p_brand"))).alias("text"))


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def _used(spark, sf_dir):
    return _messages(spark, sf_dir).groupBy("conv_id").agg(D.tokens(F.sum(F.length("text")), F.count("*")).alias("tokens"))


def llm_tokens(spark, sf_dir):
    return _used(spark, sf_dir)


def llm_safe_max(spark, sf_dir):
    return _used(spark, sf_dir).select("conv_id", D.safe_limit(F.col("tokens")).alias("limit"))


def llm_budget_vllm(spark, sf_dir):
    return _used(spark, sf_dir).select("conv_id", D.vllm_limit(F.col("tokens")).alias("limit"))


def llm_roles(spark, sf_dir):
    m = D.merged_roles(_messages(spark, sf_dir))
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda x: x["text"]), "|")).alias("md5"))


def js_null_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = J.null_strings(F.create_map(F.lit("a"), F.when(F.col("event_id") % 2 == 0, "null").otherwise(F.col("event_type")), F.lit("b"), F.lit("NULL")))
    return e.select("event_id", m["a"].alias("a"), m["b"].alias("b"))


def js_repair(spark, sf_dir):
    """Events' JSON as a model may leave it: fenced, cut off, with a trailing comma."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"data": {"k": '), k, F.lit(', "t": "'), F.substring("event_type", 1, 2))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('Antwoord: {"k": '), k, F.lit(", }"))).otherwise("geen json")
    return e.select("event_id", J.repaired(raw).alias("json"))


def js_extract_objects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", J.object_count(F.concat(F.col("props"), F.lit(' tekst {"a": "}{"} '), F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("{"))).alias("n"))


def st_sse(spark, sf_dir):
    return I.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"))


def st_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stage = F.element_at(F.array(*[F.lit(s) for s in I.STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select("event_id", I.progress(stage, F.col("user_id") % 10, F.lit(10)).alias("progress"))


def st_queue(spark, sf_dir):
    """What the queue runs: each key once, in order of arrival, but for what is cancelled."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    gone = e.where("event_type = 'error' and value > 20").select("user_id").distinct()
    return first.join(gone, "user_id", "left_anti").select("user_id", F.col("f.event_id").alias("event_id"))


def snk_webhook(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", I.webhook_payload(F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("error"), F.col("o_orderpriority"), (F.col("o_orderkey") % 7) / 7.0, F.lit(None).cast("string")).alias("payload"))


def src_dispatch(spark, sf_dir):
    """The reader for each file, by its name; unknown types are errors."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PNG", ".docx", ".xlsx", ".txt", ".bin")]), (F.col("doc_id") % 6 + 1).cast("int")))
    m = S.mime(name)
    return d.select("doc_id", F.when(m == "application/pdf", "pdf").when(m.startswith("image/"), "image").when(m.contains("wordprocessing"), "docx").when(m.contains("spreadsheet"), "xlsx").when(m == "text/plain", "txt").otherwise("error").alias("reader"))


def src_sanitize_filename(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.safe_name(F.concat(F.col("url"), F.lit(".html"))).alias("name"))


def src_train_dir(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("png", "pdf", "docx", "jpg", "txt")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return S.best_version(l.select(F.col("l_orderkey").alias("stem"), ext.alias("ext")).distinct())


def src_combine_pages(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit("\n\n"))), "")).alias("md5"))


def src_artifact_guard(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.element_at(F.array(*[F.lit(x) for x in ("text/", "../text/", "/risk/", "secret/", "metadata/")]), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", S.allowed_path(F.concat(path, F.col("page_id").cast("string"), F.lit(".json"))).alias("allowed"))


def src_image_ocr(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    r = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), ((F.col("l_linenumber") - 1) * 90).alias("angle"), F.col("l_quantity").cast("int").alias("alnum"), (F.col("l_partkey") % 30).cast("int").alias("words"))
    best = r.groupBy("doc_id", "page", "angle").agg(F.max("alnum").alias("alnum"), F.max("words").alias("words"))
    return S.best_rotation(best).select("doc_id", "angle")


def ui_fields_view(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.create_map(F.lit("a"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")), F.lit("b"), F.col("o_orderpriority"))
    return o.select("o_orderkey", F.array_join(F.map_keys(F.map_filter(m, lambda k, v: v.isNotNull())), ",").alias("fields"))


def ui_evidence_by_page(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey", (F.col("l_linenumber") + 1).alias("page")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("first"))


def ui_signal_split(spark, sf_dir):
    from .texts import _signals

    s = _signals(spark, sf_dir)
    half = lambda keep: F.array_join(F.array_sort(F.map_keys(F.map_filter("signals", lambda k, v: keep(v)))), ",")
    return s.select("doc_id", half(lambda v: v > 0).alias("matched"), half(lambda v: v <= 0).alias("other"))


_NAMES = "prep_sample prep_skip_marker prep_skip_training chunk_split chunk_pages fx_path_split table_like words_within_window norm_search llm_tokens llm_safe_max llm_budget_vllm llm_roles js_null_strings js_repair js_extract_objects st_sse st_progress st_queue snk_webhook src_dispatch src_sanitize_filename src_train_dir src_combine_pages src_artifact_guard src_image_ocr ui_fields_view ui_evidence_by_page ui_signal_split"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    stmt = f"WITH {STATEMENTS_SQL}"
    cut = "mk AS (SELECT *, strpos(lower({0}), 'part 5') AS a, CASE WHEN regexp_matches({0}, '(?i)part \\d*7\\b') THEN length(regexp_extract({0}, '(?is)^(.*?)(?:part \\d*7\\b)', 1)) + 1 ELSE 0 END AS b FROM {1}), mp AS (SELECT *, CASE WHEN a = 0 THEN b WHEN b = 0 THEN a ELSE least(a, b) END AS k FROM mk)"
    used = "u AS (SELECT conv_id, CAST(floor(floor(sum(length(text)) / 3.5::DOUBLE + count(*) * 15) * 1.2::DOUBLE) AS INT) AS tokens FROM conversations GROUP BY conv_id)"
    # One step: the end after a start s, by the last break among the 199 characters before s + size.
    end = lambda s, size: f"CASE WHEN {s} + {size} < length(text) THEN CASE WHEN regexp_matches(substr(text, {s} + {size} - 198, 199), '[\\n. ]') THEN {s} + {size} - length(regexp_extract(substr(text, {s} + {size} - 198, 199), '[^\\n. ]*$')) ELSE {s} + {size} END ELSE {s} + {size} END"
    chunk = lambda size, over, src: f"WITH RECURSIVE {src}, ch AS (SELECT doc_id, text, 0 AS part, 0 AS s, CASE WHEN length(text) <= {size} THEN length(text) ELSE {end('0', size)} END AS e FROM src UNION ALL SELECT doc_id, text, part + 1, e - {over}, {end(f'(e - {over})', size)} FROM ch WHERE length(text) > {size} AND e - {over} < length(text))"
    from .texts import oracle_sql as text_sql

    signals = text_sql()["sig_dispatch"]
    return {
        "ui_signal_split": f"SELECT doc_id, coalesce(string_agg(key, ',' ORDER BY key) FILTER (value > 0), '') AS matched, coalesce(string_agg(key, ',' ORDER BY key) FILTER (value <= 0), '') AS other FROM ({signals}) GROUP BY doc_id",
        "snk_webhook": """SELECT o_orderkey, concat('{"document_id":', o_orderkey, ',"status":"', CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'error' END, '","doc_type":"', o_orderpriority, '","confidence":', CAST(round((o_orderkey % 7) / 7.0::DOUBLE, 4) AS VARCHAR), '}') AS payload FROM orders""",
        "llm_roles": """WITH g AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id),
 h AS (SELECT *, coalesce(list_position(list_transform(m, lambda x: x.role <> 'system'), TRUE), 0) AS o FROM g),
 k AS (SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x, i: x.role = 'system' AND (o = 0 OR i < o)), lambda x: x.text), chr(10) || chr(10)) AS head, list_filter(m, lambda x: x.role <> 'system') AS rest FROM h),
 r AS (SELECT conv_id, CASE WHEN coalesce(head, '') = '' THEN rest WHEN len(rest) = 0 THEN [{'role': 'user', 'text': head}] WHEN rest[1].role = 'user' THEN list_concat([{'role': 'user', 'text': concat_ws(chr(10) || chr(10), head, rest[1].text)}], rest[2:]) ELSE list_concat([{'role': 'user', 'text': head}], rest) END AS m FROM k)
 SELECT conv_id, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles, md5(array_to_string(list_transform(m, lambda x: x.text), '|')) AS md5 FROM r""",
        "prep_sample": f"{stmt}, o AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM stmt), {cut.format('t', 'o')}, q AS (SELECT doc_id, CASE WHEN k > 0 THEN trim(substr(t, 1, k - 1)) ELSE t END AS t FROM mp) SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) WHEN length(t) >= 299 THEN t ELSE concat(t, chr(10)) END AS sample FROM q",
        "prep_skip_marker": f"{stmt}, {cut.format('text', 'stmt')} SELECT doc_id, CASE WHEN k = 0 THEN NULL WHEN k = a THEN 'part 5' ELSE 'part \\d*7\\b' END AS marker, CASE WHEN k > 0 THEN k - 1 END AS position FROM mp",
        "prep_skip_training": f"{stmt}, {cut.format('text', 'stmt')} SELECT doc_id, length(CASE WHEN a > 0 THEN regexp_replace(substr(text, 1, a - 1), '\\s+$', '') WHEN b > 0 THEN regexp_replace(substr(text, 1, b - 1), '\\s+$', '') ELSE text END) AS n FROM mp",
        "chunk_split": f"{chunk(2500, 300, 'src AS (SELECT doc_id, text FROM documents)')} SELECT doc_id, part, s AS start, length(substr(text, s + 1, e - s)) AS n, md5(substr(text, s + 1, e - s)) AS md5 FROM ch",
        "chunk_pages": f"{chunk(500, 50, 'pp AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS page FROM conversations WHERE trim(text) <> chr(0) AND trim(text) <> $$$$), src AS (SELECT conv_id * 100000 + page AS doc_id, text FROM pp)')} SELECT doc_id // 100000 AS conv_id, doc_id % 100000 AS page, part, length(substr(text, s + 1, e - s)) AS n, row_number() OVER (PARTITION BY doc_id // 100000 ORDER BY doc_id % 100000, part) AS chunk_num FROM ch",
        "fx_path_split": "SELECT doc_id, CASE WHEN length(text) > 2500 THEN 'chunks' ELSE 'whole' END AS route FROM documents",
        "table_like": f"{stmt} SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\t|\\||\\S {{2,}}\\S') OR (len(regexp_extract_all(x, '\\S+')) >= 3 AND regexp_matches(x, '\\d')))) >= 2 AS table_like FROM stmt",
        "words_within_window": "SELECT doc_id, coalesce(list_position(w, 'the') > 0 AND list_position(w, 'of') > 0 AND abs(list_position(w, 'the') - list_position(w, 'of')) <= 10, FALSE) AS near FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)",
        "norm_search": "SELECT p_partkey, trim(regexp_replace(lower(concat('een m2 ', p_name, '--', p_brand)), '[^a-z0-9]+', ' ', 'g')) AS text FROM part",
        "llm_tokens": f"WITH {used} SELECT * FROM u",
        "llm_safe_max": f"WITH {used}, l AS (SELECT conv_id, 4096 - tokens - 200 AS a FROM u) SELECT conv_id, CASE WHEN a >= 100 THEN least(2048, a) WHEN a > 0 THEN greatest(50, a // 2) ELSE 50 END AS \"limit\" FROM l",
        "llm_budget_vllm": f"WITH {used}, l AS (SELECT conv_id, 4096 - tokens - 100 AS a FROM u) SELECT conv_id, CASE WHEN a <= 0 THEN 50 ELSE greatest(50, least(2048, a)) END AS \"limit\" FROM l",
        "js_null_strings": "SELECT event_id, CASE WHEN event_id % 2 <> 0 THEN event_type END AS a, NULL::VARCHAR AS b FROM events",
        "js_repair": """WITH k AS (SELECT event_id, event_id % 4 AS m, props->>'$.k' AS k, substr(event_type, 1, 2) AS t FROM events) SELECT event_id, CASE m WHEN 0 THEN concat('{"k": ', k, '}') WHEN 1 THEN concat('{"data": {"k": ', k, ', "t": "', t, '"}}') WHEN 2 THEN concat('{"k": ', k, '}') END AS json FROM k""",
        "js_extract_objects": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM events",
        "st_sse": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "st_progress": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN floor(10 + (user_id % 10 + 1) / 10 * 35)::INT WHEN 3 THEN 45 WHEN 4 THEN 60 WHEN 5 THEN 85 ELSE 100 END AS progress FROM events",
        "st_queue": "WITH f AS (SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) SELECT * FROM f WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)",
        "src_dispatch": "SELECT doc_id, (['pdf', 'image', 'docx', 'xlsx', 'txt', 'error'])[doc_id % 6 + 1] AS reader FROM documents",
        "src_train_dir": "WITH f AS (SELECT DISTINCT l_orderkey AS stem, (['png', 'pdf', 'docx', 'jpg', 'txt'])[l_partkey % 5 + 1] AS ext FROM lineitem) SELECT stem, ext FROM f QUALIFY row_number() OVER (PARTITION BY stem ORDER BY list_position(['txt', 'pdf', 'png', 'jpg', 'jpeg', 'docx'], ext)) = 1",
        "src_combine_pages": "SELECT conv_id, md5(string_agg(concat(text, chr(10), chr(10)), '' ORDER BY turn, text)) AS md5 FROM conversations GROUP BY conv_id",
        "src_artifact_guard": "SELECT page_id, page_id % 5 IN (0, 4) AS allowed FROM pages",
        "src_image_ocr": "WITH r AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1) * 90 AS angle, max(CAST(l_quantity AS INT)) AS a, max(l_partkey % 30) AS w FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL) SELECT doc_id, angle FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (angle = 0 AND a >= 50 AND w >= 10) DESC, 2 * a + w DESC, angle) = 1",
        "ui_fields_view": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS fields FROM orders",
        "ui_evidence_by_page": "SELECT l_orderkey, l_linenumber + 1 AS page, count(*) AS n, min(l_partkey) AS first FROM lineitem GROUP BY ALL",
    }
