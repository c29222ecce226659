"""Risk signals and reports. A signal is STRUCT<name, risk_level, confidence, category>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import values as V


def signal(when: Column, name: Column | str, level: Column | str, confidence: Column | float, category: str) -> Column:
    """The signal where the condition holds, else null."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(c(name).alias("name"), c(level).alias("risk_level"), c(confidence).cast("double").alias("confidence"), F.lit(category).alias("category")))


def invisible_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(f"[{r}]")) for r, _ in P.INVISIBLE), F.lit(0))


def invisible_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"[{r}]"), F.lit(d)) for r, d in P.INVISIBLE]))


def doubtful_text(confidence: Column, missing: Column) -> tuple[Column, Column]:
    """Level and confidence of text signals: higher where verified fields are missing or the type is unsure."""
    unsure = missing | (confidence < 0.6)
    return F.when(unsure, "MEDIUM").otherwise("LOW"), F.when(unsure, 0.6).otherwise(0.4)


def repetition(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of at least four characters that come more than ten times and make over a twentieth of such words: (doc_id, word, count, total).

    Counted inside each row: a document's own words are all that its signal needs.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))
    d = docs.select("doc_id", F.array_sort(words).alias("w"))
    # In order, a word that comes more than ten times is met again ten places on.
    often = F.array_distinct(F.filter("w", lambda x, i: F.get("w", i + 10) == x))
    counted = F.transform(often, lambda c: F.struct(c.alias("word"), F.size(F.filter("w", lambda x: x == c)).cast("long").alias("count")))
    d = d.select("doc_id", F.size("w").cast("long").alias("total"), F.explode(counted).alias("c"))
    return d.select("doc_id", "c.word", "c.count", "total").where(F.col("count") / F.col("total") > 0.05)


def anomaly(text: Column) -> Column:
    """Six tenths of the share of non-ASCII characters and four tenths of the share of repeated words; 1 for no text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    share = F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) / F.greatest(F.length(text), F.lit(1))
    again = F.when(F.size(words) > 0, 1 - F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 1.0).otherwise(share * 0.6 + again * 0.4)


def low_confidence(confidence: Column) -> Column:
    return signal(confidence < 0.6, "low_classification_confidence", "MEDIUM", 1.0 - confidence, "context_mismatch")


def semantic(label: Column, top: Column, confidence: Column, margin: Column) -> Column:
    """A second model's view: context only where the type is unknown, a mismatch where it differs."""
    unknown = label.isNull() | (label == "unknown")
    level = F.when(~unknown & (confidence >= 0.75) & (margin >= 0.10), "MEDIUM").otherwise("LOW")
    name = F.when(unknown, "semantic_context_available").otherwise("semantic_context_mismatch")
    return signal(top.isNotNull() & (unknown | (top != label)), name, level, F.when(unknown, F.least(confidence, F.lit(0.6))).otherwise(F.least(confidence, F.lit(0.85))), "semantic_context")


def pdf_creator(creator: Column, producer: Column) -> Column:
    """The first suspicious tool named by creator or producer."""
    out = F.when(F.lit(False), F.lit(""))
    for tool in P.SUSPICIOUS_CREATORS:
        out = out.when(F.lower(F.coalesce(creator, F.lit(""))).contains(tool) | F.lower(F.coalesce(producer, F.lit(""))).contains(tool), tool)
    return out


def pdf_signals(creator: Column, producer: Column, created: Column, modified: Column, author: Column, title: Column) -> Column:
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return F.array_compact(F.array(signal(pdf_creator(creator, producer).isNotNull(), "suspicious_pdf_creator", "MEDIUM", 0.8, "manipulation"), signal(~blank(created) & ~blank(modified) & (created != modified), "pdf_date_mismatch", "LOW", 0.5, "manipulation"), signal(blank(author) & blank(title), "missing_metadata", "LOW", 0.4, "quality_warning")))


def producer_verdict(producer: Column) -> Column:
    """legitimate, programmatic or suspicious by the producer's name, in this order; null if none."""
    any_ = lambda xs: F.lower(F.coalesce(producer, F.lit(""))).rlike("|".join(xs))
    return F.when(any_(P.LEGITIMATE_PRODUCERS), "legitimate").when(any_(P.PROGRAM_PRODUCERS), "programmatic").when(any_(P.DOUBTFUL_PRODUCERS), "suspicious")


def legacy_score(producer: Column, anomaly_: Column, inconsistent: Column, low_ocr: Column) -> Column:
    """The older sum of points, 100 at most."""
    v = producer_verdict(producer)
    pts = F.when(v.isin("programmatic", "suspicious"), 30).otherwise(0) + F.when(anomaly_ > 0.3, F.floor(anomaly_ * 40)).otherwise(0) + F.when(inconsistent, 20).otherwise(0) + F.when(low_ocr, 50).otherwise(0)
    return F.least(F.lit(100), pts).cast("int")


def ela(size: Column, is_jpeg: Column, mean: Column, std: Column, most: Column, bright: Column) -> Column:
    """Error levels of a resaved image as a signal: gates on size and kind, then on spread, peak and share of bright points.

    The confidence is the greatest of three parts, between 0.5 and 0.95: how far spread and peak lie
    above their thresholds, and the share of bright points. Small images (under 300) count for 0.8 of it.
    """
    hit = (size >= 150) & is_jpeg & ((std > 2) | (most > 10) | (bright > 0.01))
    spread, peak = (std - 2) / 20, (most - 10) / 40 * 0.8
    glow = F.when(bright > 0.01, F.least(F.lit(1.0), bright / 0.1) * 0.7).otherwise(0.0)
    base = F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.greatest(spread, peak, glow)))
    return signal(hit, "ela_manipulation_detected", F.when((std > 20) | (most > 50), "HIGH").otherwise("MEDIUM"), F.when(size < 300, base * 0.8).otherwise(base), "manipulation")


def exif(software: Column, processing: Column, modified: Column, original: Column, digitized: Column, gps: Column, make: Column, model: Column) -> Column:
    """Signals of a picture's tags, each with a detail: editing software named by either software tag, more than a day between taking and changing it, a place (gps), and a camera.

    Dates have the form yyyy:MM:dd HH:mm:ss; the day digitized stands in for an original that is missing or no date.
    """
    out = []
    for tag in (software, processing):
        found = F.lit(None)
        for key, level_, confidence in reversed(P.EDITING_SOFTWARE):
            one = F.struct(F.lit("image_editing_software").alias("name"), F.lit(level_).alias("risk_level"), F.lit(confidence).alias("confidence"), F.lit("manipulation").alias("category"), tag.alias("detail"))
            found = F.when(F.contains(F.lower(tag), F.lit(key)), one).otherwise(found)
        out.append(found)
    at = lambda c: F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss"))
    apart = F.floor((F.unix_timestamp(at(modified)) - F.unix_timestamp(F.coalesce(at(original), at(digitized)))) / 86400)
    days = F.abs(apart)
    out.append(F.when(days > 1, F.struct(F.lit("exif_date_mismatch").alias("name"), F.when(days > 30, "HIGH").otherwise("MEDIUM").alias("risk_level"), F.lit(0.8).alias("confidence"), F.lit("manipulation").alias("category"), days.cast("string").alias("detail"))))
    tags = lambda name, confidence, detail: F.struct(F.lit(name).alias("name"), F.lit("LOW").alias("risk_level"), F.lit(confidence).alias("confidence"), F.lit("metadata").alias("category"), detail.alias("detail"))
    camera = F.concat_ws(" ", F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit("")))
    out.append(F.when(gps, tags("exif_gps_present", 0.5, F.lit("gps"))))
    out.append(F.when(camera != "", tags("exif_camera_metadata", 0.4, camera)))
    return F.array_compact(F.array(*out))


def amount_range(field: str, value: Column, low: float | None, high: float | None) -> Column:
    a = V.rule_amount(value)
    below = a < low if low is not None else F.lit(False)
    above = a > high if high is not None else F.lit(False)
    return signal(below | above, F.when(below, f"{field}_below_minimum").otherwise(f"{field}_above_maximum"), "MEDIUM", 0.8, "context_mismatch")


def date_max_age(field: str, value: Column, days: int, as_of: Column) -> Column:
    old = F.datediff(as_of, V.rule_date(value))
    return signal(old > days, f"{field}_too_old", F.when(old > 2 * days, "HIGH").otherwise("MEDIUM"), 0.9, "context_mismatch")


def cross_field_ratio(field: str, value: Column, other: Column, low: float | None, high: float | None) -> Column:
    b = V.rule_amount(other)
    r = V.rule_amount(value) / F.when(b != 0, b)
    under = r < low if low is not None else F.lit(False)
    over = r > high if high is not None else F.lit(False)
    return signal(under | over, F.when(under, f"{field}_ratio_too_low").otherwise(f"{field}_ratio_too_high"), F.when(under, "HIGH").otherwise("MEDIUM"), F.when(under, 0.85).otherwise(0.75), "context_mismatch")


def not_expired(field: str, value: Column, as_of: Column) -> Column:
    days = F.datediff(as_of, V.rule_date(value))
    return signal(days > 0, f"{field}_expired", F.when(days > 30, "HIGH").otherwise("MEDIUM"), 0.95, "document_expired")


def amount_inconsistency(total: Column, subtotal: Column, vat: Column) -> Column:
    diff = F.abs(V.naive_amount(total) - (V.naive_amount(subtotal) + V.naive_amount(vat)))
    return signal(diff > 0.02, "amount_inconsistency", "MEDIUM", 0.6, "context_mismatch")


def score(signals: Column) -> Column:
    """Twice the mean of weight times confidence, 100 at most; 0 for none."""
    weight = lambda s: F.create_map(*[F.lit(x) for kv in P.RISK_WEIGHTS.items() for x in kv])[s["risk_level"]] * s["confidence"]
    total = F.aggregate(F.transform(signals, weight), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(signals) > 0, F.least(F.lit(100.0), 2 * total / F.size(signals))).otherwise(0.0)


def level(signals: Column, score_: Column) -> Column:
    has = lambda x: F.exists(signals, lambda s: s["risk_level"] == x)
    return F.when((score_ >= 70) | has("CRITICAL"), "CRITICAL").when((score_ >= 50) | has("HIGH"), "HIGH").when(score_ >= 25, "MEDIUM").otherwise("LOW")


def summary(signals: Column, level_: Column) -> Column:
    """The number of signals above LOW (of all, if none is) and the first three grave ones."""
    named = F.create_map(*[F.lit(x) for kv in {"LOW": "Laag risico", "MEDIUM": "Gemiddeld risico", "HIGH": "Hoog risico", "CRITICAL": "Kritiek risico"}.items() for x in kv])
    above = F.filter(signals, lambda s: s["risk_level"] != "LOW")
    n = F.when(F.size(above) > 0, F.size(above)).otherwise(F.size(signals))
    grave = F.slice(F.transform(F.filter(above, lambda s: s["risk_level"].isin("HIGH", "CRITICAL")), lambda s: F.replace(s["name"], F.lit("_"), F.lit(" "))), 1, 3)
    head = F.concat(named[level_], F.lit(": "), n.cast("string"), F.lit(" signaal"), F.when(n != 1, "en").otherwise(""), F.lit(" gedetecteerd."))
    return F.when(F.size(signals) == 0, "Geen verdachte signalen gedetecteerd.").when(F.size(grave) > 0, F.concat(head, F.lit(" Belangrijkste: "), F.array_join(grave, ", "))).otherwise(head)


def advice(signals: Column) -> Column:
    """Advice cards (priority, category) in order of gravity; one at most for images and for metadata."""
    grave = lambda s: s["risk_level"].isin("HIGH", "CRITICAL")
    turn = lambda s: F.when(grave(s), 0).when(s["risk_level"] == "MEDIUM", 1).otherwise(2)
    ordered = F.array_sort(F.transform(signals, lambda s, i: F.struct(turn(s).alias("turn"), i.alias("i"), s.alias("s"))))

    def card(x: Column) -> Column:
        s = x["s"]
        expired = s["name"].endswith("_expired") | s["name"].endswith("_too_old")
        ratio = (s["category"] == "context_mismatch") & s["name"].contains("ratio")
        image = s["category"].isin("ela_manipulation", "image_manipulation")
        meta = s["category"].contains("metadata") | (s["category"] == "suspicious_tool")
        high = F.when(grave(s), "high").otherwise("medium")
        kind = F.when(expired, "document_verlopen").when(ratio, "waarde_afwijking").when(image, "mogelijke_vervalsing").when(meta, "pdf_metadata").when(grave(s), s["category"])
        pri = F.when(expired, high).when(ratio, F.when(s["risk_level"] == "HIGH", "high").otherwise("medium")).when(image, "high").when(meta, "medium").otherwise("high")
        once = F.when(~expired & ~ratio & (image | meta), s["category"])
        return F.when(kind.isNotNull(), F.struct(pri.alias("priority"), kind.alias("category"), once.alias("once")))

    cards = F.array_compact(F.transform(ordered, card))
    first = F.filter(cards, lambda c, i: c["once"].isNull() | (F.array_position(F.transform(cards, lambda y: F.coalesce(y["once"], F.lit(""))), F.coalesce(c["once"], F.lit("-"))) == i + 1))
    return F.transform(first, lambda c: F.struct(c["priority"].alias("priority"), c["category"].alias("category")))


def report(docs: DataFrame, signals: str = "signals") -> DataFrame:
    """Adds risk_score, overall_risk and summary to rows with an array of signals."""
    d = docs.withColumn("risk_score", score(F.col(signals)))
    d = d.withColumn("overall_risk", level(F.col(signals), F.col("risk_score")))
    return d.withColumn("summary", summary(F.col(signals), F.col("overall_risk")))
