"""Scalar text and time functions; all take and return Columns."""

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from trendloom.functions import lexicon as L


# --- entity removal (literal replacement, in entity order); each step reads the text once ---

def _values(items: Column, field: str) -> Column:
    values = F.filter(F.transform(items, lambda e: e[field]), lambda v: v.isNotNull())
    return F.coalesce(values, F.array().cast("array<string>"))


def _remove_each(text: Column, items: Column, field: str, prefix: str = "") -> Column:
    return F.aggregate(_values(items, field), text, lambda t, v: F.replace(t, F.concat(F.lit(prefix), v), F.lit("")))


def strip_cashtags(text: Column, symbols: Column) -> Column:
    return _remove_each(text, symbols, "text", "$")


def strip_mentions(text: Column, mentions: Column, keep_handles=()) -> Column:
    """Remove ``@name`` for every mention; a kept handle loses only its ``@`` (case-sensitive)."""
    def step(t, name):
        replacement = F.when(name.isin(*keep_handles), name).otherwise(F.lit("")) if keep_handles else F.lit("")
        return F.replace(t, F.concat(F.lit("@"), name), replacement)

    return F.aggregate(_values(mentions, "screen_name"), text, step)


def strip_hash_signs(text: Column, hashtags: Column) -> Column:
    """Without hashtags the sought text is empty, which replaces nothing."""
    return F.replace(text, F.when(F.size(hashtags) > 0, F.lit("#")).otherwise(F.lit("")), F.lit(""))


def strip_urls(text: Column, urls: Column) -> Column:
    return _remove_each(text, urls, "url")


def strip_media(text: Column, media: Column) -> Column:
    return _remove_each(text, media, "url")


# --- unescape and social clean-up ---

def _numeric_exceptions() -> dict[int, str]:
    """Code points that a numeric reference does not stand for itself: the null, the C1 range, which
    is read as windows-1252, and those that are no characters, which vanish."""
    found = {0: "\ufffd", 13: "\r"}
    for n in [*range(1, 9), 11, *range(14, 32), 127, *range(0xFDD0, 0xFDF0), *[p * 0x10000 + e for p in range(17) for e in (0xFFFE, 0xFFFF)]]:
        found[n] = ""
    for n in range(0x80, 0xA0):
        found[n] = bytes([n]).decode("cp1252", errors="ignore") or chr(n)
    return found


def _table(values: dict, kind: str) -> Column:
    """A constant map; folded once, not built for each row."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _by_letters(values: dict[str, str]) -> dict[str, dict[str, dict[str, str]]]:
    """Names below their first and second letter, as maps are searched from the start."""
    found: dict = {}
    for name, value in values.items():
        found.setdefault(name[0], {}).setdefault(name[1], {})[name] = value
    return found


def _looked_up(values: dict[str, str], name: Column) -> Column:
    first = F.try_element_at(_table(_by_letters(values), "map<string,map<string,map<string,string>>>"), F.substring(name, 1, 1))
    return F.try_element_at(F.try_element_at(first, F.substring(name, 2, 1)), name)


_ENTITY = (r"(?s)&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32}+;?)|[^&]++|&")
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;")  # tried first
_SHORT = {k: v for k, v in html5.items() if not k.endswith(";")}  # names that also count without a semicolon


def _character(digits: Column, base: int) -> Column:
    """The character of a numeric reference; U+FFFD beyond Unicode and for surrogates."""
    kept = F.ltrim(digits, F.lit("0"))
    n = F.when(F.length(kept) > 7, F.lit(0x110000)).otherwise(F.conv(F.when(kept == "", F.lit("0")).otherwise(kept), base, 10).cast("long"))
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    known = F.try_element_at(_table({str(k): v for k, v in _numeric_exceptions().items()}, "map<string,string>"), n.cast("string"))
    return F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(F.coalesce(known, own))


_SHORT_START = "^(?:" + "|".join(sorted(_SHORT, key=len, reverse=True)) + ")"


def _named(run: Column) -> Column:
    """A name's characters; of an unknown name the longest start that is a name without its semicolon."""
    name = F.substring(run, 2, 40)
    start = F.regexp_extract(name, _SHORT_START, 0)
    by_start = F.concat(_looked_up(_SHORT, start), F.substring(name, F.length(start) + 1, F.lit(40)))
    return F.coalesce(_looked_up(html5, name), by_start, run)


def html_unescape(text: Column) -> Column:
    """Decode all HTML entities: the text is cut into entities and runs without one, each is decoded once, and all are joined."""
    def decoded(run: Column) -> Column:
        digits = F.regexp_replace(run, "[&#xX;]", "")
        hexadecimal = F.lower(F.substring(run, 3, 1)) == "x"
        found = F.when(~F.startswith(run, F.lit("&")) | (run == "&"), run)
        for name in _COMMON:
            found = found.when(run == f"&{name}", F.lit(html5[name]))
        return (found
                .when(F.startswith(run, F.lit("&#")), F.when(hexadecimal, _character(digits, 16)).otherwise(_character(digits, 10)))
                .otherwise(_named(run)))

    runs = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(runs, decoded), "")).otherwise(text)


def social_clean(text: Column, classes=L.SOCIAL_DEFAULT) -> Column:
    """Remove the chosen classes of social markup and tidy the spaces."""
    for name in classes:
        text = F.regexp_replace(text, L.SOCIAL_PATTERNS[name], "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_entities(text: Column, entities: Column, keep_handles=()) -> Column:
    text = strip_cashtags(text, entities["symbols"])
    text = strip_mentions(text, entities["user_mentions"], keep_handles)
    text = strip_hash_signs(text, entities["hashtags"])
    text = strip_urls(text, entities["urls"])
    return strip_media(text, entities["media"])


# --- words, tokens, sentences ---

def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(L.WHITESPACE_WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(L.WHITESPACE_WORD)).cast("bigint")


def dedup_tokens(text: Column) -> Column:
    """Distinct case-sensitive words and punctuation marks."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(L.DEDUP_TOKEN), F.lit(0)))


def raw_feature_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(L.FEATURE_TOKEN), F.lit(0))


def feature_tokens(text: Column, stop_words=L.ENGLISH_STOP_WORDS) -> Column:
    """Lower-cased words of two or more characters without stop words; repeats stay."""
    return F.filter(raw_feature_tokens(text), lambda t: ~t.isin(*stop_words))


def sentences(text: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(text, F.lit(L.SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def end_with_period(text: Column) -> Column:
    return F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))


def contains_marker(text: Column, marker: str = "RT @") -> Column:
    return text.contains(marker)


# --- time ---

def format_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def minutes_before(ts: Column, minutes: int) -> Column:
    return ts - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def elapsed_minutes(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(60.0)


def elapsed_hours(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / F.lit(3600.0)
