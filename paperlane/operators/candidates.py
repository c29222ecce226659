"""Field candidates: validation, scoring and resolution, and evidence in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as A
from ..functions import patterns as P
from ..functions import values as V


def judged(candidates: DataFrame, year: int) -> DataFrame:
    """Adds to candidates, which have their fields' columns (field_type, label, enum_values, and regex if fields have patterns): reason, selected and context.

    reason says why a candidate is rejected, in the order of the checks; null if it stands. selected
    is its value as the checks leave it, context whether its evidence has the field's label.
    """
    c = candidates.withColumn("_selected", F.when(V.is_empty(F.col("normalized_value")), F.col("value")).otherwise(F.col("normalized_value")))
    kind = V.field_kind(F.col("field_type"), F.col("field_key"), F.col("label"))
    c = V.checked(c, kind, F.col("_selected"), F.col("evidence"), F.col("unit"), F.col("enum_values"), year, F.col("regex") if "regex" in c.columns else None)
    reason = (
        F.when(V.is_empty(F.col("value")), "empty_value")
        .when(V.is_empty(F.col("normalized_value")), "empty_normalized_value")
        .when(V.evidence_invalid(F.col("evidence")), "invalid_evidence")
        .when(~F.coalesce(F.col("evidence_type").isin(list(P.EVIDENCE_SCORES)), F.lit(False)), "invalid_evidence_type")
        .when(~F.coalesce(F.col("record_role").isin(list(P.ROLE_SCORES)), F.lit(False)), "invalid_record_role")
        .when(F.coalesce(F.col("confidence"), F.lit(0)) <= 0, "non_positive_confidence")
        .when(F.col("check_reason").isNotNull(), F.col("check_reason"))
        .when(~V.in_evidence(F.col("value"), F.col("check_normalized"), F.col("evidence")), "value_not_in_evidence")
    )
    c = c.withColumns({"reason": reason, "selected": F.col("check_normalized")}).drop("_selected", "check_reason", "check_normalized")
    return c.withColumn("context", F.when(F.col("reason").isNull(), V.label_context(F.col("field_key"), F.col("label"), F.col("evidence"))))


def _lookup(values: dict, column: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[column]


def score() -> Column:
    """Of judged candidates: 60, and the points of evidence type, role, label context, confidence and position; null for the rejected."""
    points = F.lit(60.0) + _lookup(P.EVIDENCE_SCORES, F.col("evidence_type")) + _lookup(P.ROLE_SCORES, F.col("record_role")) + F.when(F.col("context"), 60).otherwise(0) + F.least(F.lit(20.0), F.greatest(F.lit(0.0), F.col("confidence") / 5)) + F.greatest(F.lit(0), 5 - F.least(F.col("chunk_index"), F.lit(5)))
    return F.when(F.col("reason").isNull(), points)


def resolve(candidates: DataFrame, year: int, threshold: float = 100) -> DataFrame:
    """Per document and field: the accepted value with its score, the numbers of valid and rejected candidates, and `rejected`.

    The best score wins, then label context, then the earlier chunk, then the order of arrival (ord).
    rejected lists all candidates but the accepted one with their reason, which is null for those
    that only scored less; scored ones come first, the best before, then by chunk and arrival. A
    group holds one document's candidates for one field.
    """
    c = judged(candidates, year).withColumn("score", score())
    turn = F.struct((-F.coalesce("score", F.lit(-1e9))).alias("turn"), (~F.coalesce("context", F.lit(False))).alias("far"), F.col("chunk_index").alias("chunk_index"), F.col("ord").alias("ord"), F.col("selected").alias("selected"), F.col("value").alias("value"), F.col("reason").alias("reason"), F.col("score").alias("score"))
    g = c.groupBy("doc_id", "field_key").agg(F.array_sort(F.collect_list(turn)).alias("all"), F.max("score").alias("score"), F.count("score").alias("n_valid"), F.count("reason").alias("n_rejected"))
    g = g.withColumn("ok", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    others = F.when(F.col("ok"), F.slice("all", 2, F.size("all"))).otherwise(F.col("all"))
    rejected = F.array_sort(F.transform(others, lambda x: F.struct(x["turn"].alias("turn"), x["chunk_index"].alias("chunk_index"), x["ord"].alias("ord"), x["value"].alias("value"), x["reason"].alias("reason"), x["score"].alias("score"))))
    rejected = F.transform(rejected, lambda x: F.struct(x["value"].alias("value"), x["reason"].alias("reason"), x["score"].alias("score"), x["chunk_index"].alias("chunk_index")))
    return g.select("doc_id", "field_key", F.when(F.col("ok"), F.get("all", F.lit(0))["selected"]).alias("value"), "score", "n_valid", "n_rejected", rejected.alias("rejected"))


def find_span(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """Where each quote (doc_id, quote) of at least five characters first stands between word edges: (doc_id, quote, page, start).

    Exact matches on any page come before matches in another case. pages: (doc_id, page, text).
    """
    j = quotes.where(F.length("quote") >= 5).join(pages, "doc_id")
    at = lambda text, quote: F.instr(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), "[^a-zA-Z0-9À-ÿ]", " "), F.concat(F.lit(" "), F.regexp_replace(quote, "[^a-zA-Z0-9À-ÿ]", " "), F.lit(" ")))
    exact = F.when(F.col("text").contains(F.col("quote")), at(F.col("text"), F.col("quote"))).otherwise(0)
    loose = F.when(F.lower("text").contains(F.lower("quote")), at(F.lower("text"), F.lower("quote"))).otherwise(0)
    hit = F.when(exact > 0, F.struct(F.lit(0).alias("way"), "page", (exact - 1).alias("start"))).when(loose > 0, F.struct(F.lit(1).alias("way"), "page", (loose - 1).alias("start")))
    return j.groupBy("doc_id", "quote").agg(F.min(hit).alias("h")).select("doc_id", "quote", F.col("h.page").alias("page"), F.col("h.start").alias("start"))


def evidence_error(value: Column, page: Column, start: Column, end: Column, quote: Column, page_text: Column) -> Column:
    """What is wrong with a span of evidence; null if nothing is."""
    n = F.length(page_text)
    bad_span = (start >= n) | (end > n) | (start >= end)
    return F.when(value.isNull(), F.when(page.isNotNull(), "evidence_for_null")).when(page.isNull(), "no_evidence").when(page_text.isNull(), "invalid_page").when(bad_span, "invalid_span").when(F.substr(page_text, start + 1, end - start) != quote, "quote_mismatch")


def verified(pages: DataFrame, values: DataFrame) -> DataFrame:
    """How each value (doc_id, value, and the first span of its evidence: page, start, end, null without any) is borne out: doc_id, value, method, page, snippet.

    A span that lies within its page is evidence; one that does not leaves the value unverified.
    Without a span the first page wins on which the value is found: as it stands, with blanks
    squeezed, whatever the case, both, or as a number with points between thousands, with a euro
    sign or whole. method is evidence, auto_found, auto_found_normalized, auto_found_number_format
    or none. Pages without text are never sought in. pages: (doc_id, page, text).
    """
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    v = values.select("doc_id", "value", F.col("page").alias("_page"), F.col("start").alias("_start"), F.col("end").alias("_end")).withColumn("_v", F.regexp_replace("value", r"(?U)^\s+|\s+$", ""))
    amount = F.when(F.regexp_replace("_v", "[.,]", "").rlike(r"^\d+$"), F.replace("_v", F.lit(","), F.lit(".")).try_cast("double"))
    # Python rounds halves to even, so does bround.
    v = v.withColumns({"_n": F.replace(F.format_number(F.bround(amount, 0), 0), F.lit(","), F.lit(".")), "_whole": F.floor(amount).cast("string"), "_flat": squeezed(F.col("_v"))})
    j = v.join(pages.select("doc_id", "page", "text"), "doc_id", "left")
    t, flat = F.col("text"), squeezed(F.col("text"))
    ways = (
        ("auto_found", t.contains(F.col("_v")), F.col("_v")),
        ("auto_found_normalized", flat.contains(F.col("_flat")), F.col("_flat")),
        ("auto_found", F.lower(t).contains(F.lower("_v")), F.substr(t, F.instr(F.lower(t), F.lower("_v")), F.length("_v"))),
        ("auto_found_normalized", F.lower(flat).contains(F.lower("_flat")), F.col("_flat")),
        *(("auto_found_number_format", t.contains(n) | flat.contains(n), n) for n in (F.col("_n"), F.concat(F.lit("€ "), "_n"), F.concat(F.lit("€"), "_n"), F.col("_whole"))),
    )
    found = F.when(F.lit(False), F.struct(F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("snippet")))
    for method, here, snippet in ways:
        found = found.when(here, F.struct(F.lit(method).alias("method"), snippet.alias("snippet")))
    given = F.col("_page").isNotNull()
    sound = (F.col("page") == F.col("_page")) & (F.col("_start") < F.length(t)) & (F.col("_end") <= F.length(t))
    hit = F.when(given & sound, F.struct(F.lit("evidence").alias("method"), F.substr(t, F.col("_start") + 1, F.greatest(F.lit(0), F.col("_end") - F.col("_start"))).alias("snippet"))).when(~given & (F.col("_v") != ""), found)
    best = j.withColumn("_hit", hit).groupBy("doc_id", "value").agg(F.min(F.when(F.col("_hit").isNotNull(), F.struct(F.col("page").alias("page"), F.col("_hit").alias("hit")))).alias("b"))
    return best.select("doc_id", "value", F.coalesce("b.hit.method", F.lit("none")).alias("method"), F.col("b.page").alias("page"), F.col("b.hit.snippet").alias("snippet"))


def fixed_pages(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (doc_id, page, quote, ...) with the page that holds their quote.

    A quote under eight characters stays where it is, and so does one that its page has, whatever
    the case. Else the first page that has it; else the page that has most of its words of four
    letters or digits, if at least 60 %, the first of equals; else it stays. Pages (doc_id, page,
    text) meet the spans of their document; a repeated span is answered once.
    """
    bare = F.trim("quote")
    asked = spans.select("doc_id", "quote", F.col("page").alias("_old")).where(F.length(bare) >= 8).distinct()
    low, q = F.lower("text"), F.lower(bare)
    tokens = F.regexp_extract_all(q, F.lit("[a-zà-ÿ0-9]{4,}"), F.lit(0))
    j = asked.join(pages.select("doc_id", "page", "text"), "doc_id").withColumns({"_has": low.contains(q), "_words": tokens})
    hits = F.size(F.filter("_words", lambda w: low.contains(w)))
    j = j.withColumn("_score", F.when(F.col("_has"), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(hits, F.size("_words")), F.lit(0.0))))
    g = j.groupBy("doc_id", "quote", "_old").agg(
        F.bool_or(F.col("_has") & (F.col("page") == F.col("_old"))).alias("_stays"),
        F.min(F.when(F.col("_has"), F.col("page"))).alias("_exact"),
        F.max(F.struct(F.col("_score"), (-F.col("page")).alias("turn"))).alias("_most"),
    )
    new = F.when(F.coalesce("_stays", F.lit(False)), F.col("_old")).otherwise(F.coalesce("_exact", F.when(F.col("_most._score") >= 0.6, -F.col("_most.turn")), "_old"))
    g = g.select(F.col("doc_id").alias("_doc"), F.col("quote").alias("_quote"), "_old", new.alias("_new"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.col("quote") == F.col("_quote")) & F.col("page").eqNullSafe(F.col("_old"))
    return spans.join(g, same, "left").withColumn("page", F.coalesce("_new", "page")).select(spans.columns)


def occurrences(pages: DataFrame, values: DataFrame, known: DataFrame) -> DataFrame:
    """Pages (doc_id, value, page) on which a value of at least five characters stands between word edges and that are not known yet."""
    edge = r"[^a-zA-Z0-9À-ÿ]"
    pad = lambda x: F.concat(F.lit(" "), F.regexp_replace(F.lower(x), edge, " "), F.lit(" "))
    j = values.where(F.length("value") >= 5).join(pages, "doc_id").where(pad(F.col("text")).contains(pad(F.col("value"))))
    return j.select("doc_id", "value", "page").join(known, ["doc_id", "value", "page"], "left_anti")


def latest_by_turn(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_t", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_t") <= n).drop("_t")


def from_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate rows (doc_id, chunk_index, ord, field_key, value, ..., record_role) of models' answers (doc_id, chunk_index, answer, chunk).

    An answer may be of any shape that A.candidates_in() knows, amid whatever text; one that cannot
    be read gives no rows. Evidence that lacks the value is repaired from the chunk.
    """
    c = answers.select("doc_id", "chunk_index", "chunk", F.posexplode(A.candidates(F.col("answer"), keys)).alias("ord", "c"))
    evidence = repaired_evidence(F.col("c.value"), F.col("c.normalized_value"), F.col("c.evidence"), F.coalesce("chunk", F.lit("")))
    own = [F.col(f"c.{k}") for k in ("field_key", "value", "normalized_value", "unit")]
    return c.select("doc_id", "chunk_index", "ord", *own, evidence.alias("evidence"), "c.confidence", "c.evidence_type", "c.record_role")


def repaired_evidence(value: Column, normalized: Column, evidence: Column, chunk: Column, around: int = 300) -> Column:
    """The evidence, or, where it lacks the value, what surrounds the value (or its normal form) in the chunk; as it was if it isn't there either.

    Six lines before to two after the value's line, if there are two with text and those before have
    letters, as in tables with a header; else the characters around it.
    """
    place = lambda v: F.when(V.is_empty(v), 0).otherwise(F.instr(F.lower(chunk), F.lower(F.trim(v))))
    at = F.when(place(value) > 0, F.struct(place(value).alias("at"), F.length(F.trim(value)).alias("n"))).when(place(normalized) > 0, F.struct(place(normalized).alias("at"), F.length(F.trim(normalized)).alias("n")))

    def around_it(x: Column) -> Column:
        row = F.size(F.split(F.substr(chunk, F.lit(1), x["at"] - 1), "\n")) - 1
        first = F.greatest(F.lit(0), row - 6)
        lines = F.filter(F.transform(F.slice(F.split(chunk, "\n"), first + 1, row + 3 - first), lambda t: F.trim(t)), lambda t: t != "")
        header = F.exists(F.slice(lines, 1, F.greatest(F.lit(1), row - first)), lambda t: t.rlike("[A-Za-zÀ-ÿ]"))
        lo = F.greatest(F.lit(1), x["at"] - around)
        return F.when(header & (F.size(lines) >= 2), F.array_join(lines, "\n")).otherwise(F.trim(F.substr(chunk, lo, x["at"] + x["n"] + around - lo)))

    found = F.transform(F.array(at), lambda x: F.when(x.isNotNull(), around_it(x)))[0]
    return F.when(V.in_evidence(value, normalized, evidence), evidence).otherwise(F.coalesce(found, evidence))
