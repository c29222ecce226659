"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is a built-in expression over the row's own text, so there is no shuffle, and every
rule is a row of RULES. A null or empty text has no words and fails the base rules. Other columns
of the input pass through unless they clash with a measure, which then wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which she we were been has "
    "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les et des en un une du que est pour qui dans au sur par plus ne se ce il pas avec son elle "
    "el los las y del se con por una su para al lo como más o pero sus de"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie between low and high; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 25.0),
    Rule("symbol_ratio", "symbol_ratio", None, 0.3),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", "dup_line_ratio", None, 0.5),
    Rule("alphabetic_word_ratio", "alpha_word_ratio", 0.6, None),
)


def compile_rules(rules: tuple = RULES) -> Column:
    """True where every rule holds."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            out = out & (F.col(r.measure) <= F.lit(r.high))
    return out


def measures(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """Adds the counts and ratios that rules may name."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda s, chars: F.translate(s, chars, "")
    d = docs.withColumns({"_words": words_of(F.col(text_col)), "_lines": F.filter(F.split(text, "\n", -1), lambda x: gone(x, BLANKS) != "")})
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(gone(text, BLANKS)).cast("long"),
            "n_symbols": (F.length(text) - F.length(gone(text, SYMBOLS))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_stops": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))),
            "_alpha": F.size(F.filter("_words", lambda w: w.rlike(r"\p{L}"))),
            "_hash": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_lines", "_words")
    n = F.size("_hash")
    d = d.withColumn("_wins", F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice("_hash", i, window)))).otherwise(F.array().cast("array<bigint>"))).drop("_hash")
    # Only texts in which a window comes twice are sorted.
    twice = F.size(F.array_distinct("_wins")) < F.size("_wins")
    pairs = F.sort_array(F.transform("_wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_pairs", F.when(twice, pairs)).drop("_wins")
    same = lambda x, j: F.get("_pairs", j)["h"] == x["h"]
    at = F.filter(F.transform("_pairs", lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"])), lambda p: p.isNotNull())
    d = d.withColumn("_at", F.sort_array(at)).drop("_pairs")
    start = F.struct(F.lit(0).cast("int").alias("n"), F.lit(-window).cast("int").alias("last"))
    covered = F.aggregate("_at", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns(
        {
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "mean_word_length": over("word_chars", "n_words"),
            "symbol_ratio": over("n_symbols", "n_words"),
            "stop_word_ratio": over("_stops", "n_words"),
            "alpha_word_ratio": over("_alpha", "n_words"),
            "dup_line_ratio": over("n_dup_lines", "n_lines"),
        }
    ).drop("_at", "_stops", "_alpha")


def judge(docs: DataFrame, text_col: str = "text", rules: tuple = RULES) -> DataFrame:
    """Adds the measures, base_failed and kept."""
    d = measures(docs, text_col)
    base = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in dict.fromkeys(words))


def _holds(rules: tuple = RULES) -> str:
    parts = []
    for r in rules:
        parts += [f"{r.measure} >= {r.low}::DOUBLE"] if r.low is not None else []
        parts += [f"{r.measure} <= {r.high}::DOUBLE"] if r.high is not None else []
    return " AND ".join(parts)


#: The counts and ratios of every document, numbered by r, as measures() has them.
MEASURES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + 7], ' ')) AS c FROM p),
k AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM q, (SELECT unnest(range(0, 8)) AS o) WHERE c >= 2 GROUP BY r),
m AS (SELECT r, doc_id, source, lang, text, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({_quoted(STOP_WORDS)}))) AS stops,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS alphas
  FROM w LEFT JOIN k USING (r)),
n AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN stops / n_words ELSE 0.0 END AS stop_word_ratio, CASE WHEN n_words > 0 THEN alphas / n_words ELSE 0.0 END AS alpha_word_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
"""
OP7_SQL = f"{MEASURES_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_holds()}) AS kept FROM n"
