"""What the classifiers said of a document: a record for each model, and the reason given for the label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD = "struct<status: string, label: string, confidence: double, threshold: double, reason: string, margin: double>"


def _two(x: Column) -> Column:
    """Two decimals, as a text."""
    return F.format_string("%.2f", x)


def margin(scores: Column) -> Column:
    """The greatest of a map's scores less the next, 0 for a single one, null without any."""
    best = F.reverse(F.array_sort(F.filter(F.map_values(scores), lambda x: x.isNotNull())))
    return F.when(F.size(best) >= 2, best[0] - best[1]).when(F.size(best) == 1, F.lit(0.0))


def model_record(label: Column, confidence: Column, threshold: Column | None = None, rejected: Column | None = None, error: Column | None = None, scores: Column | None = None) -> Column:
    """What became of a model's prediction.

    status is accepted, or rejected, with the rule that rejects it; below_threshold, with both
    figures; failed, with the error; or no_result. A null label or confidence is no prediction; an
    error counts only then. Without a threshold none is too low.
    """
    none = lambda kind: F.lit(None).cast(kind)
    threshold, rejected, error = (none(k) if x is None else x for x, k in ((threshold, "double"), (rejected, "string"), (error, "string")))
    some = label.isNotNull() & confidence.isNotNull()
    low = some & F.coalesce(confidence < threshold, F.lit(False))
    status = F.when(low, "below_threshold").when(some & rejected.isNotNull(), "rejected").when(some, "accepted").when(error.isNotNull(), "failed").otherwise("no_result")
    reason = F.when(low, F.concat(F.lit("Confidence "), _two(confidence), F.lit(" < threshold "), _two(threshold))).when(some, rejected).when(error.isNotNull(), error).otherwise("No model available or no prediction generated")
    apart = none("double") if scores is None else margin(scores)
    return F.struct(status.alias("status"), F.when(some, label).alias("label"), F.when(some, confidence).alias("confidence"), threshold.alias("threshold"), reason.alias("reason"), apart.alias("margin")).cast(RECORD)


def rationale(method: Column, confidence: Column, matched: Column, nb: Column, embedding: Column, model: Column) -> Column:
    """Why a document has its label: the method, or for strong rules the keywords found, then what both models predicted.

    nb, embedding: model records; only accepted and rejected ones have a prediction. A null model is the default one.
    """
    told = lambda name, r: F.when(r["status"].isin("accepted", "rejected"), F.concat(F.lit(f"{name}: "), r["label"], F.lit(" ("), _two(r["confidence"]), F.lit(")")))
    strong = F.concat(F.lit("STRONG keyword match (100% confidence) - matched keywords: "), F.array_join(F.coalesce(matched, F.array().cast("array<string>")), ", "))
    first = F.when(method == "deterministic_strong", strong).otherwise(F.concat(F.upper(method), F.lit(" classifier (p="), _two(confidence), F.lit(")")))
    models = F.nullif(F.concat_ws(", ", told("NB", nb), told("BERT", embedding)), F.lit(""))
    return F.concat(F.concat_ws(" | ", first, models), F.lit(" (model="), F.coalesce(model, F.lit("default")), F.lit(")"))
