"""Column functions over text: quality predicates, signals, normalisers. Null text counts as empty unless said otherwise."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    """Without white space at both ends (Unicode)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


# --- quality -----------------------------------------------------------------------------------


def mostly_empty(text: Column) -> Column:
    """Fewer than a tenth of the non-blank characters are ASCII letters or digits."""
    bare = without_space(text)
    return (F.length(bare) == 0) | (_n(bare, "[a-zA-Z0-9]") / F.greatest(F.length(bare), F.lit(1)) < 0.1)


def garbage_reason(text: Column) -> Column:
    """The first check that calls the text garbage; null if none does."""
    t = strip(F.coalesce(text, F.lit("")))
    letters, words, low = _n(t, "[a-zA-Z]"), _n(t, "[a-zA-Z]{3,}"), F.lower(t)
    common = _n(low, r"(?U)\b(" + "|".join(P.DUTCH_COMMON) + r")\b") + _n(low, r"(?U)\b(" + "|".join(P.ENGLISH_COMMON) + r")\b")
    bad = sum((_n(t, p) for p in P.GARBAGE), F.lit(0))
    out = F.when(F.length(t) < 50, "too_short")
    out = out.when((letters > 0) & (_n(t, P.SPECIAL) / F.greatest(letters, F.lit(1)) > 0.5), "special_characters")
    out = out.when((F.length(t) > 100) & (words < 5), "few_words")
    out = out.when(_n(t, P.CONTROL) > F.length(t) * 0.05, "control_characters")
    return out.when((words > 10) & (common < 3), "no_common_words").when(bad >= 3, "garbage_patterns")


def is_garbage(text: Column) -> Column:
    return garbage_reason(text).isNotNull()


def ocr_quality(text: Column, ocr_used: Column) -> Column:
    bare = F.length(without_space(text))
    errors = sum((_n(F.coalesce(text, F.lit("")), p) for p in P.OCR_ERRORS), F.lit(0))
    return F.when(~ocr_used, "high").when(bare < 100, "low").when(errors > bare * 0.05, "low").when(errors > bare * 0.02, "medium").otherwise("high")


def needs_ocr(text: Column) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) < 200) | mostly_empty(text) | is_garbage(text)


# --- signals -----------------------------------------------------------------------------------

BUILTIN = {"iban_present": "boolean", "date_count": "count", "amount_count": "count", "date_amount_row_count": "count", "line_count": "count", "token_count": "count"}
MOST_CHARACTERS = 200_000


def prepared(text: Column) -> Column:
    """Cut at 200,000 characters, runs of blanks but line ends to one space."""
    return F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, MOST_CHARACTERS), r"(?U)[^\S\n]+", " ")


def lines_of(text: Column) -> Column:
    return F.split(strip(text), "\n", -1)


def builtin_signal(key: str, text: Column) -> Column:
    """A built-in signal of a prepared text as a double; unknown keys give 0."""
    lines = lines_of(text)
    if key == "iban_present":
        out = text.rlike(P.IBAN)
    elif key == "date_count":
        out = _n(text, P.DATE)
    elif key == "amount_count":
        out = _n(text, P.AMOUNT)
    elif key == "date_amount_row_count":
        out = F.size(F.filter(lines, lambda x: x.rlike(P.DATE) & x.rlike(P.AMOUNT)))
    elif key == "line_count":
        out = F.size(F.filter(lines, lambda x: strip(x) != ""))
    elif key == "token_count":
        out = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    else:
        out = F.lit(0)
    return out.cast("double")


def keyword_signal(text: Column, keywords: list[str], mode: str = "any", empty: bool = False) -> Column:
    """Any or all keywords occur, whatever the case. empty: the answer for no keyword."""
    if not keywords:
        return F.lit(empty)
    low = F.lower(text)
    hits = [low.contains(k.lower()) for k in keywords]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if mode == "all" else out | h
    return out


def java_pattern(pattern: str) -> str | None:
    """A user's Python pattern as Java's; None if it is not valid, which counts as no match."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    return "(?imU)" + re.sub(r"\(\?P<", "(?<", pattern).replace("\\Z", "\\z").replace("(?P=", "\\k<")


def regex_signal(text: Column, found: list[str], mode: str = "any", empty: bool = False) -> Column:
    """Any or all patterns match, whatever the case, line by line."""
    if not found:
        return F.lit(empty)
    hits = [F.lit(False) if p is None else text.rlike(p) for p in map(java_pattern, found)]
    out = hits[0]
    for h in hits[1:]:
        out = out & h if mode == "all" else out | h
    return out


def signal_map(text: Column, signals: list[dict]) -> Column:
    """Values of a table of signals as one MAP<STRING, DOUBLE>.

    A signal has key, compute_kind (builtin, keyword_set, regex_set; others give 0) and config
    (keywords, patterns, match_mode).
    """
    entries = []
    for s in signals:
        config = s.get("config") or {}
        mode = config.get("match_mode", "any")
        if s["compute_kind"] == "builtin":
            value = builtin_signal(s["key"], text)
        elif s["compute_kind"] == "keyword_set":
            value = keyword_signal(text, config.get("keywords") or [], mode).cast("double")
        elif s["compute_kind"] == "regex_set":
            value = regex_signal(text, config.get("patterns") or [], mode).cast("double")
        else:
            value = F.lit(0.0)
        entries += [F.lit(s["key"]), value]
    return F.create_map(*entries)


# --- normalisers -------------------------------------------------------------------------------


def pii_normalized(text: Column) -> Column:
    """IBANs, then dates, then amounts to placeholders; blanks squeezed; ends stripped."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), P.LOOSE_IBAN, "__IBAN__")
    t = F.regexp_replace(t, P.DATE, "__DATE__")
    t = F.regexp_replace(t, P.EURO_AMOUNT, "__AMOUNT__")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def unicode_form(text: Column, form: str) -> Column:
    """A Unicode normal form (NFC, NFD, NFKC, NFKD), which Spark lacks; null stays null."""

    @F.pandas_udf("string")
    def work(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    return work(text)


def slug(text: Column) -> Column:
    """NFKC in lower case, separators to hyphens; null unless it begins with a letter."""
    t = F.regexp_replace(F.lower(strip(unicode_form(text, "NFKC"))), r"[_\s]+", "-")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9-]", "-"), "-+", "-"), "^-|-$", "")
    return F.when(t.rlike("^[a-z][a-z0-9-]*$"), t)


def plain(text: str) -> str:
    """search_text() of a setting."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", " ", t).strip()


@functools.cache
def _search_tables() -> tuple[str, str, str, str, str]:
    """By Unicode's decompositions: characters that search_text() reads as one letter or digit, and these; those it drops; those it reads as several, with what they are read as; a pattern of the ranges where the last lie."""
    one, read, dropped, several = [], [], [], []
    ranges: list[list[int]] = []
    for code in range(128, 0x110000):
        c = chr(code)
        if unicodedata.combining(c):
            dropped.append(c)
        elif unicodedata.decomposition(c):
            t = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
            if len(t) == 1 and t.isascii() and t.isalnum():
                one.append(c)
                read.append(t)
            elif re.search("[a-z0-9]", t):
                several.append((c, re.sub("[^a-z0-9]", " ", t)))
                if ranges and code - ranges[-1][1] <= 8:  # few ranges, as each is tried for each character
                    ranges[-1][1] = code
                else:
                    ranges.append([code, code])
            elif not t:
                dropped.append(c)
    pattern = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"
    return "".join(one), "".join(read), "".join(dropped), "\x01".join(f"{c}\x02{t}" for c, t in several), pattern


def search_text(text: Column) -> Column:
    """NFKD in lower case without marks, all but letters and digits of ASCII to single spaces.

    By tables made from Unicode's decompositions, so that it stays among Spark's own functions; text
    in ASCII and common signs, which hold no letters, skips them.
    """
    one, read, dropped, several, rare = _search_tables()
    t = F.coalesce(text, F.lit(""))
    names = F.str_to_map(F.lit(several), F.lit("\x01"), F.lit("\x02"))
    spelled = F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(names, c), c)), "")
    spelled = F.when(t.rlike(rare), spelled).otherwise(t)
    t = F.lower(F.when(t.rlike("[\\x{80}-\\x{10FFFF}&&[^€£§°‘’“”–—•…]]"), F.translate(spelled, one + dropped, read)).otherwise(t))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
