"""Queries over rules, Naive Bayes and centroids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import bayes as B
from ..operators import centroids as E
from ..operators import rules as R
from ..sources.corpus import STATEMENTS_SQL, statements, table

HINTS = {
    "statement": "kw:rekeningafschrift\nkw:iban\nnot:boeking",
    "bookings": "kw:boeking\nre:part \\d+5\\b\npart 1",
    "amounts": "kw:iban\nre:€\\d+\\.\\d{3}\nnot:part 7",
    "parts": "part 1\npart 2\npart 3\nre:(",
}
TYPES = [R.parse_hints(k, v) for k, v in HINTS.items()]
REQUIRED = {"amounts": [("iban", "IBAN", None), ("bedrag", "Bedrag", None)], "bookings": [("boekdatum", "Boekdatum", None)]}

_L = "t AS (SELECT doc_id, text, lower(text) AS low FROM stmt)"


def _c(words: list[str]) -> str:
    return " + ".join(f"contains(low, '{w}')::INT" for w in words) or "0"


def cls_strong(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", R.strong(F.col("text"), TYPES).alias("slug"))


def hint_parse(spark, sf_dir):
    """Hints that lie in a table: those of the statement types, one type for each nation."""
    n = table(spark, sf_dir, "nation")
    hints = F.concat(F.lit("kw: "), F.col("n_name"), F.lit("\nre:"), F.col("n_name"), F.lit("\\d+\n not:Region\n\n"), F.col("n_name"))
    return R.hint_rows(n.select(F.col("n_name").alias("slug"), hints.alias("hints")))


def cls_validate_not(spark, sf_dir):
    predicted = F.when(F.col("doc_id") % 2 == 0, "statement").otherwise("amounts")
    return statements(spark, sf_dir).select("doc_id", R.veto_reason(F.col("text"), predicted, TYPES, True).alias("reason"))


def cls_deterministic(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", R.deterministic(F.col("text"), TYPES, REQUIRED).alias("slug"))


def cls_engine_deterministic(spark, sf_dir):
    return statements(spark, sf_dir).select("doc_id", R.pure_deterministic(F.col("text"), TYPES).alias("slug"))


def cls_matched_hints(spark, sf_dir):
    s = statements(spark, sf_dir).withColumn("slug", R.pure_deterministic(F.col("text"), TYPES))
    return s.select("doc_id", F.array_join(R.matched_hints(F.col("text"), F.col("slug"), TYPES), ",").alias("words"))


def field_detectable(spark, sf_dir):
    fields = {"iban": "IBAN nummer", "rekening": "Rekeningnr", "datum": "Datumveld", "bedrag": "Bedragveld", "naam": "Naamveld", "adres": "Adresveld"}
    return table(spark, sf_dir, "documents").select("doc_id", *[R.field_detected(F.col("text"), k, v).alias(k) for k, v in fields.items()])


def cls_evidence_supported(spark, sf_dir):
    """Each order's header checked against its own and its neighbour's statement."""
    s = statements(spark, sf_dir)
    e = s.select(F.concat(F.lit('"Rekeningafschrift '), (F.col("doc_id") + 1).cast("string"), F.lit('"')).alias("evidence"), (F.col("doc_id") % 1000).alias("k"), "doc_id", "text")
    return e.select("doc_id", R.evidence_supported(F.col("evidence"), F.col("text")).alias("supported"), R.evidence_supported(F.concat(F.lit("IBAN "), F.col("doc_id").cast("string"), F.lit(" geen bewijs")), F.col("text")).alias("half"))


def cls_llm_validate(spark, sf_dir):
    s = statements(spark, sf_dir)
    evidence = F.when(F.col("doc_id") % 3 == 0, "IBAN: NL").when(F.col("doc_id") % 3 == 1, "nergens te vinden")
    slug = F.when(F.col("doc_id") % 5 == 0, "unknown").otherwise("statement")
    v = R.validate_llm(slug, (F.col("doc_id") % 10) / 10.0, evidence, F.col("text"))
    return s.select("doc_id", v["slug"].alias("slug"), v["confidence"].alias("confidence"))


def cls_llm_label_scope(spark, sf_dir):
    """The labels a language model may choose: those both trained and configured, or all configured if none are."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("configured"))
    trained = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    both = F.array_intersect("configured", trained)
    return o.select("o_custkey", F.array_join(F.when(F.size(both) > 0, both).otherwise(F.col("configured")), ",").alias("labels"))


def cls_stage(spark, sf_dir):
    s, t = statements(spark, sf_dir), F.col("text")
    nb = F.when(F.col("doc_id") % 3 == 0, "amounts")
    out = R.stage(F.when(F.col("doc_id") % 50 == 0, "forced-type"), R.strong(t, TYPES), nb, F.lit(0.9), R.veto_reason(t, nb, TYPES), R.deterministic(t, TYPES, REQUIRED))
    return s.select("doc_id", out["slug"].alias("slug"), out["confidence"].alias("confidence"), out["method"].alias("method"))


_DET = f"""WITH {STATEMENTS_SQL}, {_L}, o AS (SELECT doc_id, text, low, [
 {{'slug': 'statement', 'ok': contains(low, 'rekeningafschrift') AND contains(low, 'iban') AND NOT contains(low, 'boeking'), 'score': 2}},
 {{'slug': 'bookings', 'ok': contains(low, 'boeking') AND (contains(low, 'boekdatum') OR regexp_matches(text, '\\b\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}}\\b')), 'score': 1 + 3 * regexp_matches(text, '(?i)part \\d+5\\b')::INT + contains(low, 'part 1')::INT + 2}},
 {{'slug': 'amounts', 'ok': contains(low, 'iban') AND NOT contains(low, 'part 7') AND (contains(low, 'bedrag') OR regexp_matches(text, '\\b\\d+[.,]\\d{{2}}\\b|€\\s*\\d+|(?i:EUR)\\s*\\d+')), 'score': 1 + 3 * regexp_matches(text, '€\\d+\\.\\d{{3}}')::INT + 4}},
 {{'slug': 'parts', 'ok': TRUE, 'score': {_c(['part 1', 'part 2', 'part 3'])}}}] AS c FROM t), p AS (SELECT *, list_filter(c, lambda x: x.ok AND x.score >= 1) AS u FROM o),
 q AS (SELECT *, list_filter(u, lambda x: x.score = list_max(list_transform(u, lambda y: y.score))) AS b FROM p)"""
_DET_SLUG = "CASE WHEN len(b) = 1 THEN b[1].slug END"
_STRONG = "CASE WHEN contains(low, 'rekeningafschrift') AND contains(low, 'iban') AND NOT contains(low, 'boeking') THEN 'statement' WHEN contains(low, 'boeking') THEN 'bookings' WHEN contains(low, 'iban') AND NOT contains(low, 'part 7') THEN 'amounts' END"
_ENG = f"""WITH {STATEMENTS_SQL}, {_L}, o AS (SELECT doc_id, low, [
 {{'slug': 'statement', 'ok': NOT contains(low, 'boeking'), 'score': {_c(['rekeningafschrift', 'iban'])}}},
 {{'slug': 'bookings', 'ok': TRUE, 'score': {_c(['boeking', 'part 1'])} + 3 * regexp_matches(text, '(?i)part \\d+5\\b')::INT}},
 {{'slug': 'amounts', 'ok': NOT contains(low, 'part 7'), 'score': {_c(['iban'])} + 3 * regexp_matches(text, '€\\d+\\.\\d{{3}}')::INT}},
 {{'slug': 'parts', 'ok': TRUE, 'score': {_c(['part 1', 'part 2', 'part 3'])}}}] AS c FROM t), p AS (SELECT *, list_filter(c, lambda x: x.ok AND x.score >= 1) AS u FROM o),
 q AS (SELECT doc_id, low, list_filter(u, lambda x: x.score = list_max(list_transform(u, lambda y: y.score))) AS b FROM p)"""


# --- Naive Bayes over the documents' languages -----------------------------------------------------


def _model(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tokens = B.token_lists(d, B.tokens(F.col("text")))
    classes, by_token = B.train(tokens, d.select("doc_id", F.col("lang").alias("label")))
    return tokens, classes, by_token


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(P.DUTCH_STOP_WORDS))
_PII = rf"regexp_replace(regexp_replace(regexp_replace(text, '{P.LOOSE_IBAN}', '__IBAN__', 'g'), '{P.DATE}', '__DATE__', 'g'), '{P.EURO_AMOUNT}', '__AMOUNT__', 'g')"
_NB = f"""k AS (SELECT doc_id, lang AS label, unnest(regexp_extract_all(lower({_PII}), '[a-z_]{{3,}}')) AS token FROM documents),
cn AS (SELECT doc_id, label, token, count(*) AS n FROM k WHERE token <> '___' AND token NOT IN ({_STOP}) GROUP BY ALL),
bt AS (SELECT label, token, sum(n)::BIGINT AS c FROM cn GROUP BY ALL),
cl AS (SELECT label, count(DISTINCT doc_id) AS docs, sum(n) AS total FROM cn GROUP BY label),
ln_ AS (SELECT doc_id, sum(n) AS length FROM cn GROUP BY doc_id),
sn AS (SELECT cn.doc_id, bt.label, sum(n * ln(c + 1.0::DOUBLE)) AS seen FROM cn JOIN bt USING (token) GROUP BY ALL),
sc AS (SELECT doc_id, label, coalesce(seen, 0) - length * ln(total + (SELECT count(DISTINCT token) FROM bt)::DOUBLE) + ln((docs + 1.0::DOUBLE) / ((SELECT sum(docs) FROM cl) + (SELECT count(*) FROM cl))) AS s FROM ln_ CROSS JOIN cl LEFT JOIN sn USING (doc_id, label)),
ex AS (SELECT doc_id, label, exp(s - max(s) OVER (PARTITION BY doc_id)) AS e FROM sc),
pr AS (SELECT doc_id, label, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM ex),
pd AS (SELECT doc_id, min(label) AS label, any_value(p) AS p FROM (SELECT *, max(p) OVER (PARTITION BY doc_id) AS top FROM pr) WHERE p = top GROUP BY doc_id)"""


def nb_tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", B.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


def nb_train(spark, sf_dir):
    _, classes, _ = _model(spark, sf_dir)
    return classes


def nb_predict_all(spark, sf_dir):
    return B.predict_all(*_model(spark, sf_dir)).select("doc_id", "label", F.round("p", 6).alias("p"))


def nb_predict(spark, sf_dir):
    return B.predict(B.predict_all(*_model(spark, sf_dir))).select("doc_id", "label", F.round("p", 6).alias("p"))


def nb_threshold(spark, sf_dir):
    p = B.predict(B.predict_all(*_model(spark, sf_dir)))
    return p.select("doc_id", F.when(F.col("p") >= B.THRESHOLD, F.col("label")).alias("label"), F.col("label").alias("raw_label"))


def nb_top_tokens(spark, sf_dir):
    return B.top_tokens(_model(spark, sf_dir)[2], 50).select("label", "token", "c", "rank")


def nb_hints_from_tokens(spark, sf_dir):
    return B.hints_of(B.top_tokens(_model(spark, sf_dir)[2], 10))


def nb_merge_models(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("model"), F.col("lang").alias("label"), F.explode(B.tokens(F.col("text"))).alias("token"))
    models = rows.groupBy("model", "label", "token").agg(F.count("*").alias("c"))
    return B.merged(models, 50).select("label", "token", "c", "rank")


def nb_training_files_by_label(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("files"), F.min("doc_id").alias("first"), F.sum("n_chars").alias("chars"))


def mdl_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat("lang", F.lit("="), F.col("n").cast("string")))), ",").alias("types"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _centred(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return E.scores(v, E.centroids(v))


def emb_train(spark, sf_dir):
    c = E.centroids(_vectors(spark, sf_dir))
    return c.select("label", "samples", F.posexplode("centroid").alias("pos", "x")).select("label", "samples", "pos", F.round("x", 6).alias("x"))


def emb_scores(spark, sf_dir):
    return _centred(spark, sf_dir).select("vec_id", "label", F.round("score", 6).alias("score"))


def emb_predict(spark, sf_dir):
    return E.predict(_centred(spark, sf_dir)).select("vec_id", "label", F.round("confidence", 6).alias("confidence"))


def emb_semantic_context(spark, sf_dir):
    c = E.context(_centred(spark, sf_dir))
    return c.select("vec_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


def emb_model_fallback(spark, sf_dir):
    """The first model, by order, that gives a label: a strict one, then a lenient one."""
    rows = _centred(spark, sf_dir)
    a, b = E.predict(rows, 0.7).select("vec_id", F.col("label").alias("a")), E.predict(rows, 0.6).select("vec_id", F.col("label").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.coalesce("a", "b").alias("label"), F.when(F.col("a").isNotNull(), "strict").when(F.col("b").isNotNull(), "lenient").alias("model"))


_CEN = """c AS (SELECT label, i AS pos, avg(embedding[i + 1]::DOUBLE) AS x, count(*) AS n FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY ALL),
cv AS (SELECT label, list(x ORDER BY pos) AS cen FROM c GROUP BY label),
es AS (SELECT vec_id, cv.label, (list_cosine_similarity(list_transform(embedding, lambda q: q::DOUBLE), cen) + 1) / 2 AS score FROM embeddings CROSS JOIN cv),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM es),
bst AS (SELECT vec_id, max(score) FILTER (r = 1) AS s1, max(score) FILTER (r = 2) AS s2, max(label) FILTER (r = 1) AS l1, string_agg(CAST(label AS VARCHAR), ',' ORDER BY r) FILTER (r <= 3) AS labels FROM rk GROUP BY vec_id)"""

_NAMES = "hint_parse cls_strong cls_validate_not cls_deterministic cls_engine_deterministic cls_matched_hints field_detectable cls_evidence_supported cls_llm_validate cls_llm_label_scope cls_stage nb_tokenize nb_train nb_predict nb_predict_all nb_threshold nb_top_tokens nb_training_files_by_label nb_merge_models nb_hints_from_tokens mdl_list emb_train emb_scores emb_predict emb_semantic_context emb_model_fallback"


def queries() -> dict:
    return {n: globals()[n] for n in _NAMES.split()}


def oracle_sql() -> dict[str, str]:
    words = lambda x: f"list_distinct(regexp_extract_all({x}, '\\b[a-zA-Z]{{3,}}\\b'))"
    top = "SELECT label, token, c, row_number() OVER (PARTITION BY label ORDER BY c DESC, token) AS rank FROM bt QUALIFY rank <= 50"
    return {
        "hint_parse": "SELECT n_name AS slug, 0 AS ord, 'kw' AS kind, lower(n_name) AS pattern FROM nation UNION ALL SELECT n_name, 1, 're', concat(n_name, '\\d+') FROM nation UNION ALL SELECT n_name, 2, 'not', 'region' FROM nation UNION ALL SELECT n_name, 4, 'opt', lower(n_name) FROM nation",
        "cls_strong": f"WITH {STATEMENTS_SQL}, {_L} SELECT doc_id, {_STRONG} AS slug FROM t",
        "cls_validate_not": f"WITH {STATEMENTS_SQL}, {_L} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN contains(low, 'boeking') THEN 'not:boeking' WHEN NOT contains(low, 'rekeningafschrift') AND NOT contains(low, 'iban') THEN 'no keyword' END ELSE CASE WHEN contains(low, 'part 7') THEN 'not:part 7' WHEN NOT contains(low, 'iban') THEN 'no keyword' END END AS reason FROM t",
        "cls_deterministic": f"{_DET} SELECT doc_id, {_DET_SLUG} AS slug FROM q",
        "cls_engine_deterministic": f"{_ENG} SELECT doc_id, {_DET_SLUG} AS slug FROM q",
        "cls_matched_hints": f"{_ENG} SELECT doc_id, coalesce(CASE {_DET_SLUG} WHEN 'statement' THEN concat_ws(',', CASE WHEN contains(low, 'rekeningafschrift') THEN 'rekeningafschrift' END, CASE WHEN contains(low, 'iban') THEN 'iban' END) WHEN 'bookings' THEN concat_ws(',', CASE WHEN contains(low, 'boeking') THEN 'boeking' END, CASE WHEN contains(low, 'part 1') THEN 'part 1' END) WHEN 'amounts' THEN 'iban' WHEN 'parts' THEN concat_ws(',', CASE WHEN contains(low, 'part 1') THEN 'part 1' END, CASE WHEN contains(low, 'part 2') THEN 'part 2' END, CASE WHEN contains(low, 'part 3') THEN 'part 3' END) END, '') AS words FROM q",
        "field_detectable": r"""SELECT doc_id, contains(lower(text), 'iban') OR regexp_matches(text, '(?i)\bNL\d{2}[A-Z0-9]{10,}\b') AS iban, contains(lower(text), 'rekening') OR regexp_matches(text, '\b\d{8,}\b') OR regexp_matches(text, '(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{10,}\b') AS rekening,
 contains(lower(text), 'datum') OR regexp_matches(text, '\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b') AS datum, contains(lower(text), 'bedrag') OR regexp_matches(text, '\b\d+[.,]\d{2}\b|€\s*\d+|(?i:EUR)\s*\d+') AS bedrag,
 contains(lower(text), 'naam') OR regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])[A-Z][a-z]+\s+[A-Z][a-z]+([^\p{L}\p{M}\p{N}_]|$)') AS naam, contains(lower(text), 'adres') OR regexp_matches(text, '(^|[^\p{L}\p{M}\p{N}_])(\d{4}\s*[A-Z]{2}|[A-Z][a-z]+\s+\d+[a-z]?)([^\p{L}\p{M}\p{N}_]|$)') AS adres FROM documents""",
        "cls_evidence_supported": f"WITH {STATEMENTS_SQL} SELECT doc_id, TRUE AS supported, len(list_intersect({words(chr(39) + 'iban geen bewijs' + chr(39))}, {words('lower(text)')})) / 3 >= 0.5 AS half FROM stmt",
        "cls_llm_validate": f"WITH {STATEMENTS_SQL}, z AS (SELECT doc_id, doc_id % 5 = 0 OR (doc_id % 3 = 0 AND doc_id % 10 >= 5) AS ok FROM stmt) SELECT doc_id, CASE WHEN ok AND doc_id % 5 <> 0 THEN 'statement' ELSE 'unknown' END AS slug, CASE WHEN ok THEN (doc_id % 10) / 10.0::DOUBLE ELSE 0.0 END AS confidence FROM z",
        "cls_llm_label_scope": "WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS c FROM orders GROUP BY ALL) SELECT o_custkey, array_to_string(CASE WHEN list_has_any(c, ['1-URGENT', '2-HIGH']) THEN list_filter(c, lambda x: x IN ('1-URGENT', '2-HIGH')) ELSE c END, ',') AS labels FROM g",
        "cls_stage": f"{_DET}, r AS (SELECT doc_id, {_STRONG} AS st, CASE WHEN doc_id % 3 = 0 AND NOT contains(low, 'part 7') THEN 'amounts' END AS nb, {_DET_SLUG} AS dt FROM q) SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'forced-type' ELSE coalesce(st, nb, dt, 'unknown') END AS slug, CASE WHEN doc_id % 50 = 0 OR st IS NOT NULL THEN 1.0::DOUBLE WHEN nb IS NOT NULL THEN 0.9 WHEN dt IS NOT NULL THEN 0.95 ELSE 0.0 END AS confidence, CASE WHEN doc_id % 50 = 0 THEN 'forced' WHEN st IS NOT NULL THEN 'strong' WHEN nb IS NOT NULL THEN 'naive_bayes' WHEN dt IS NOT NULL THEN 'deterministic' ELSE 'unknown' END AS method FROM r",
        "nb_tokenize": f"WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(lower({_PII}), '[a-z_]{{3,}}'), lambda w: w <> '___' AND w NOT IN ({_STOP})) AS t FROM documents) SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM x",
        "nb_train": f"WITH {_NB} SELECT label, total::BIGINT AS total, docs, (SELECT count(DISTINCT token) FROM bt) AS vocabulary, (SELECT sum(docs) FROM cl)::BIGINT AS all_docs FROM cl",
        "nb_predict_all": f"WITH {_NB} SELECT doc_id, label, round(p, 6) AS p FROM pr",
        "nb_predict": f"WITH {_NB} SELECT doc_id, label, round(p, 6) AS p FROM pd",
        "nb_threshold": f"WITH {_NB} SELECT doc_id, CASE WHEN p >= 0.85 THEN label END AS label, label AS raw_label FROM pd",
        "nb_top_tokens": f"WITH {_NB} {top}",
        "nb_training_files_by_label": "SELECT lang, count(*) AS files, min(doc_id) AS first, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang",
        "nb_merge_models": f"WITH {_NB} {top}",
        "nb_hints_from_tokens": f"WITH {_NB}, tt AS ({top}) SELECT label, string_agg(concat('kw:', token), chr(10) ORDER BY rank) AS hints FROM tt WHERE rank <= 10 GROUP BY label",
        "mdl_list": "WITH g AS (SELECT source, concat(lang, '=', count(*)) AS x FROM documents GROUP BY source, lang) SELECT source, string_agg(x, ',' ORDER BY x) AS types FROM g GROUP BY source",
        "emb_train": f"WITH {_CEN} SELECT label, n AS samples, pos, round(x, 6) AS x FROM c",
        "emb_scores": f"WITH {_CEN} SELECT vec_id, label, round(score, 6) AS score FROM es",
        "emb_predict": f"WITH {_CEN} SELECT vec_id, CASE WHEN s1 >= 0.7 THEN l1 END AS label, round(s1, 6) AS confidence FROM bst",
        "emb_semantic_context": f"WITH {_CEN} SELECT vec_id, labels, round(s1, 6) AS confidence, round(s1 - s2, 6) AS margin FROM bst",
        "emb_model_fallback": f"WITH {_CEN} SELECT vec_id, CASE WHEN s1 >= 0.6 THEN l1 END AS label, CASE WHEN s1 >= 0.7 THEN 'strict' WHEN s1 >= 0.6 THEN 'lenient' END AS model FROM bst",
    }
