"""Policies: which document types a document's signals admit.

A policy is a dict with requirements and exclusions, lists of (signal, op, value), and acceptance
limits. Policies are compiled into predicates over the signal map, one column per type, so no text
and no policy table is crossed with the documents; only the small results are exploded.
"""

from __future__ import annotations

import json
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"==": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
DEFAULT = {"requirements": [], "exclusions": [], "acceptance": {"trained_model": {"enabled": True, "min_confidence": 0.85, "min_margin": 0.10}, "deterministic": {"enabled": True}, "llm": {"enabled": True, "require_evidence": True}}}


def problems(policy: dict) -> list[str]:
    """What is wrong with a policy: unknown operators, limits outside 0 to 1."""
    out = [f"operator {r.get('op')!r}" for part in ("requirements", "exclusions") for r in policy.get(part) or [] if r.get("op") not in OPS or not r.get("signal")]
    trained = (policy.get("acceptance") or {}).get("trained_model") or {}
    return out + [f"{k} {trained[k]}" for k in ("min_confidence", "min_margin") if k in trained and not 0 <= trained[k] <= 1]


def parse(text: str | dict | None) -> dict:
    """A policy from JSON; null or invalid gives the default."""
    try:
        found = json.loads(text) if isinstance(text, str) else text
    except ValueError:
        found = None
    if not isinstance(found, dict) or problems(found):
        return DEFAULT
    limits = {k: {**v, **((found.get("acceptance") or {}).get(k) or {})} for k, v in DEFAULT["acceptance"].items()}
    return {"requirements": found.get("requirements") or [], "exclusions": found.get("exclusions") or [], "acceptance": limits}


def holds(signals: Column, requirement: dict, missing_fails: bool = False) -> Column:
    """Whether a requirement holds. A missing signal counts as 0, or fails if missing_fails."""
    value = signals[requirement["signal"]]
    test = lambda v: OPS[requirement["op"]](v, F.lit(float(requirement["value"])))
    return F.coalesce(test(value), F.lit(False)) if missing_fails else test(F.coalesce(value, F.lit(0.0)))


def describe(signals: Column, requirement: dict) -> Column:
    value = F.coalesce(signals[requirement["signal"]], F.lit(0.0))
    return F.format_string(f"{requirement['signal']} {requirement['op']} {requirement['value']:g} (werkelijk: %s)", value.cast("bigint").cast("string"))


def eligibility(docs: DataFrame, policies: dict[str, dict], signals: str = "signals") -> DataFrame:
    """Rows (doc_id, slug, is_eligible, failed, triggered) for every document and type."""
    s = F.col(signals)
    kinds = []
    for slug, policy in policies.items():
        failed = [F.when(~holds(s, r), describe(s, r)) for r in policy["requirements"]]
        hit = [F.when(holds(s, r), describe(s, r)) for r in policy["exclusions"]]
        listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
        kinds.append(F.struct(F.lit(slug).alias("slug"), listed(failed).alias("failed"), listed(hit).alias("triggered")))
    out = docs.select("doc_id", F.explode(F.array(*kinds)).alias("k")).select("doc_id", "k.*")
    return out.withColumn("is_eligible", (F.size("failed") == 0) & (F.size("triggered") == 0))


def preview(docs: DataFrame, policy: dict, signals: str = "signals", missing_fails: bool = False) -> DataFrame:
    """One row for each document and requirement or exclusion: what is asked, the value and whether it passed."""
    s = F.col(signals)
    rows = []
    for kind in ("requirements", "exclusions"):
        for i, r in enumerate(policy[kind]):
            ok = holds(s, r, missing_fails)
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("n"), F.lit(r["signal"]).alias("signal"), F.lit(r["op"]).alias("op"), F.lit(float(r["value"])).alias("required"), F.coalesce(s[r["signal"]], F.lit(0.0)).alias("actual"), (ok if kind == "requirements" else ~ok).alias("passed")))
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


def accept_trained(confidence: Column, second: Column, policy: dict) -> Column:
    """Whether a model's prediction clears the policy's limits."""
    t = policy["acceptance"]["trained_model"]
    return F.lit(bool(t["enabled"])) & (confidence >= t["min_confidence"]) & (confidence - second >= t["min_margin"])


def pick_trained(nb: Column, bert: Column, bert_second: Column) -> tuple[Column, Column, Column]:
    """From two models' confidences (null for no prediction): the method, its confidence and the second best."""
    bert_wins = bert.isNotNull() & (nb.isNull() | (bert > nb + 0.1))
    method = F.when(bert_wins, "bert").when(nb.isNotNull(), "naive_bayes")
    second = F.when(nb.isNotNull() & bert.isNotNull(), F.when(bert_wins, nb).otherwise(bert)).when(bert.isNotNull(), F.coalesce(bert_second, F.lit(0.0))).when(nb.isNotNull(), 0.0)
    return method, F.when(bert_wins, bert).otherwise(nb), second
