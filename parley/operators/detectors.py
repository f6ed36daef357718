"""Per-message detectors as column expressions. All of them run inside the
JVM; no Python sees a row.

Parameters named ``low`` take lower-case text. Lower-case a column once (see
``detect``) and hand the same column to all detectors.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import rules
from parley.functions.kernels import rounded

UNICODE = "(?U)"


def detect(df: DataFrame, column: str, made: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Adds one column per detector; the text is lower-cased once for all."""
    low = f"_low_{column}"
    lowered = df.withColumn(low, F.lower(column))
    return lowered.withColumns({name: fn(F.col(low)) for name, fn in made.items()}).drop(low)


def any_phrase(low: Column, phrases: list[str]) -> Column:
    """True if the lower-case text contains one of the phrases. Plain substring
    search is several times faster than an alternation pattern."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases])


def first_label(low: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that occurs in the lower-case text."""
    def found(pattern: str) -> Column:
        hit = low.rlike(UNICODE + pattern)
        return any_phrase(low, rules.NEEDLES[pattern]) & hit if pattern in rules.NEEDLES else hit

    return F.coalesce(*[F.when(found(p), F.lit(name)) for p, name in patterns])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(low: Column) -> Column:
    return F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")


def session_ending(low: Column, low_reply: Column) -> Column:
    wrapped = F.coalesce(any_phrase(low_reply, rules.WRAP_UP_PHRASES), F.lit(False))
    ends = any_phrase(low, rules.SESSION_END_PHRASES) | (stripped(low).isin(rules.SHORT_ENDINGS) & wrapped)
    return (F.size(words(low)) <= rules.SESSION_END_MAX_WORDS) & ends


def last_reply(history: Column) -> Column:
    """Latest assistant text of a history array of (role, content)."""
    replies = F.filter(history, lambda m: m["role"] == "assistant")
    return F.try_element_at(replies, F.lit(-1))["content"]


def wellbeing(low: Column) -> Column:
    return any_phrase(low, rules.WELLBEING_PHRASES)


def is_unanswered(low_response: Column, sources_count: Column) -> Column:
    return (sources_count == 0) & any_phrase(low_response, rules.UNCERTAINTY_PHRASES)


def scope_rejected(low_response: Column) -> Column:
    return F.contains(low_response, F.lit(rules.SCOPE_MARKER))


def vulgar_label(low: Column) -> Column:
    return first_label(low, rules.VULGAR_PATTERNS)


def injection_label(low: Column, chars: Column) -> Column:
    """``chars`` is the length of the message as it was sent."""
    long = F.when(chars > rules.INJECTION_MAX_CHARS, F.lit(rules.INJECTION_TOO_LONG))
    return F.coalesce(long, first_label(low, rules.INJECTION_PATTERNS))


def word_overlap(low_a: Column, low_b: Column) -> Column:
    """Jaccard overlap of the two word sets; NULL when a set is too small."""
    x, y = F.array_distinct(words(low_a)), F.array_distinct(words(low_b))
    enough = (F.size(x) >= rules.REPHRASE_MIN_WORDS) & (F.size(y) >= rules.REPHRASE_MIN_WORDS)
    return F.when(enough, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def frustration_reason(low: Column, low_previous: Column, previous_unanswered: Column) -> Column:
    rephrased = F.when(word_overlap(low_previous, low) > rules.REPHRASE_OVERLAP, F.lit(rules.REPHRASE_REASON))
    after = F.when(previous_unanswered, F.lit(rules.UNANSWERED_REASON))
    return F.coalesce(first_label(low, rules.FRUSTRATION_PATTERNS), rephrased, after)


def category(low: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    keywords = rules.CATEGORY_KEYWORDS if keywords is None else keywords
    return F.coalesce(*[F.when(any_phrase(low, words_), F.lit(name)) for name, words_ in keywords.items()])


def price_limit(low: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")) for p in rules.PRICE_PATTERNS]).cast("double")


def keyword_list(low: Column) -> Column:
    """Search words in order of appearance, repeats kept."""
    stop = F.array(*[F.lit(w) for w in rules.KEYWORD_STOP_WORDS])
    return F.filter(words(low), lambda w: (F.length(w) >= rules.KEYWORD_MIN_CHARS) & ~F.array_contains(stop, w))


def mentioned(sources: Column, low_response: Column) -> Column:
    return F.filter(sources, lambda s: F.contains(low_response, F.lower(s["name"])))


def citation_gap(sources: Column, low_response: Column) -> Column:
    return F.when(F.size(sources) > 0, F.size(mentioned(sources, low_response)) == 0)


def rec_gap(target: Column, sources: Column, unanswered: Column) -> Column:
    low = F.lower(F.coalesce(target, F.lit("")))
    wanted = words(low)
    found = F.exists(sources, lambda s: F.exists(wanted, lambda w: F.contains(F.lower(s["name"]), w)))
    return (F.when(low.isin("", rules.GENERAL_TARGET), F.lit(False)).when(unanswered, F.lit(True))
             .when(F.coalesce(F.size(sources), F.lit(0)) <= 0, F.lit(False)).otherwise(~found))


def intent_label(raw: Column) -> Column:
    """Label out of the raw text of a classifier."""
    first = F.try_element_at(words(F.lower(raw)), F.lit(1))
    clean = F.regexp_replace(first, r"[.,]+$", "")
    return F.when(clean.isin(rules.INTENT_LABELS), clean).otherwise(F.lit(rules.INTENT_UNKNOWN))


def intent_target(raw: Column) -> Column:
    return F.left(stripped(F.coalesce(raw, F.lit(""))), F.lit(rules.INTENT_TARGET_CHARS))


def _tokens(chars: Column) -> Column:
    return F.floor(chars / rules.CHARS_PER_TOKEN)


def tokens_out(response: Column) -> Column:
    return F.when(F.length(response) > 0, F.greatest(F.lit(1), _tokens(F.length(response)))).cast("bigint")


def tokens_in(message: Column, history_chars: Column, sources_chars: Column) -> Column:
    chars = F.length(message) + history_chars + sources_chars
    return F.greatest(F.lit(1), _tokens(chars) + rules.PROMPT_TOKENS).cast("bigint")


def printed_chars(sources: Column) -> Column:
    """Length of the source list as Python prints it: ``[{'id': 'a', ...}, ...]``.
    0 when nothing was retrieved, 2 for an empty list."""
    def text(c: Column) -> Column:
        both = F.contains(c, F.lit("'")) & F.contains(c, F.lit('"'))
        quotes = F.length(c) - F.length(F.replace(c, F.lit("'"), F.lit("")))
        slashes = F.length(c) - F.length(F.replace(c, F.lit("\\"), F.lit("")))
        return F.length(c) + 2 + slashes + F.when(both, quotes).otherwise(0)

    frame = len("{'id': , 'name': , 'price': , 'category': }")
    sizes = F.transform(sources, lambda s: text(s["id"]) + text(s["name"]) + text(s["category"])
                        + F.length(s["price"].cast("string")) + frame)
    joined = F.aggregate(sizes, F.lit(0), lambda a, n: a + n)
    commas = F.greatest(F.size(sources) - 1, F.lit(0)) * 2
    return F.coalesce(joined + commas + 2, F.lit(0))


def call_cost(tokens_in_: Column, tokens_out_: Column, prices: dict[str, float] | None = None) -> Column:
    p = rules.PRICES if prices is None else prices
    return (F.coalesce(tokens_in_, F.lit(0)) / 1e6 * p["in"]
            + F.coalesce(tokens_out_, F.lit(0)) / 1e6 * p["out"])


def intent_cost(tokens_in_: Column, tokens_out_: Column, prices: dict[str, float] | None = None) -> Column:
    p = rules.PRICES if prices is None else prices
    return (F.coalesce(tokens_in_, F.lit(0)) / 1e6 * p["intent_in"]
            + F.coalesce(tokens_out_, F.lit(0)) / 1e6 * p["intent_out"])


def context_pct(tokens_in_: Column, size: int = rules.CONTEXT_TOKENS) -> Column:
    return rounded(tokens_in_ / size * 100, 1)
