"""Text Columns: sanitising, company-name normalising, small predicates.

All functions take and return Columns and stay inside the JVM.
"""

from __future__ import annotations

import re
import string
from functools import cache, reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from ownerscope import dictionaries as D

# ASCII word boundary. Java's own \b looks at Unicode letters while \w does not.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# white space as the reference semantics define it (members of a character class)
SPACES = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# a run of white space that is not one plain space; printable ASCII is ruled out first, by one comparison
UNEVEN_SPACES = f"(?![!-~])(?: [{SPACES}]+|[{SPACES}&&[^ ]][{SPACES}]*)"
NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"


def _listed(chars: re.Match) -> str:
    """A character class with its ASCII ranges written out, which Java looks up in one table instead of testing range by range."""
    out = chars[0]
    for short, full in (("A-Z", string.ascii_uppercase), ("a-z", string.ascii_lowercase), ("0-9", string.digits), (r"\s", " \\t\\n\\x0B\\f\\r")):
        out = out.replace(short, full)
    return out


def _alternatives(rest: str) -> bool:
    """Whether a stretch of a pattern has a bar outside the groups that are closed in it."""
    bare, before = re.sub(r"\\.|\[[^\]]*\]", "", rest), None
    while bare != before:
        bare, before = re.sub(r"\([^()]*\)", "", bare), bare
    return "|" in bare


def _first_characters(rest: str) -> str | None:
    """Class of the word characters a pattern can start with, where that is plain to see: a class, or a group of words."""
    if m := re.match(r"\(?(\[[A-Za-z0-9-]+\])(?!\?|\*|\{0|\{,)", rest):
        return None if _alternatives(rest[m.end():]) else m[1]
    m = re.match(r"\((?:\?:)?([A-Za-z0-9][^()]*)\)(?!\?|\*|\{0|\{,)", rest)
    words = m[1].split("|") if m and not _alternatives(rest[m.end():]) else []
    plain = all(re.match(r"[A-Za-z0-9](?![?*{])", w) for w in words)
    return f"[{''.join(sorted({w[0] for w in words}))}]" if words and plain else None


@cache
def regex(pattern: str, flags: str = "") -> str:
    """A dictionary pattern in the form Spark's regex functions need.

    Every pattern that starts with a boundary goes on with a word character, so
    the boundary there is just "no word character before"; it is looked at where
    the first character fits. A name's class holds no apostrophe, so a name before
    one gives nothing back.
    """
    head, rest = ("", pattern)
    if pattern.startswith(r"\b"):
        rest = pattern[2:]
        first = _first_characters(rest)
        head = f"(?={first})(?<!\\w)" if first else r"(?<!\w)(?=\w)"
    rest = rest.replace("{1,50})(?:'", "{1,50}+)(?:'")
    whole = head + rest.replace(r"\b", BOUNDARY)
    return ("(?i)" if "i" in flags else "") + re.sub(r"\[(?:[^\]\\^]|\\.)(?:[^\]\\]|\\.)*\]", _listed, whole)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words) -> Column:
    return any_of([c.contains(w) for w in words])


def leading_number(c: Column) -> Column:
    """Number a text starts with, 0 where there is none."""
    found = F.regexp_extract(c.cast("string"), NUMBER_PREFIX, 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


# --- sanitising --------------------------------------------------------------
def _first(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def _untagged(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<"), F.lit("")), F.lit(">"), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN_SPACES, " "))


def sanitize_nlp(c: Column, max_chars: int | None = None) -> Column:
    """Text as the mention patterns see it; ``max_chars=1000`` is the in-page latency guard."""
    kept = _untagged(_first(c, max_chars))
    return collapse(F.regexp_replace(kept, r"[\x00-\x1F\x7F-\x9F]", ""))


def sanitize_page(c: Column, max_chars: int | None = None) -> Column:
    """Element text for layered detection; ``max_chars=100`` is the in-page guard."""
    kept = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "<>", ""),
                            f"^[{SPACES}]+|[{SPACES}]+$", "")
    return _first(kept, max_chars)


def sanitize_boundary(c: Column, max_chars: int | None = None) -> Column:
    """Text handed across the page boundary; ``max_chars=10000`` is the in-page guard."""
    return F.regexp_replace(F.translate(_first(c, max_chars), "<>", ""), "(?i)javascript:", "")


# --- company names -----------------------------------------------------------
def _escaped(text: str) -> str:
    return "".join("\\" + ch if ch in r".*+?^${}()|[]\&," else ch for ch in text)


def suffix_alternatives() -> str:
    every = [s for names in D.SUFFIXES.values() for s in names]
    return "|".join(_escaped(s) for s in sorted(every, key=len, reverse=True))


SUFFIX_RE = f"(?iu){BOUNDARY}({suffix_alternatives()}){BOUNDARY}"
DOTTED_RE = f"(?iu){BOUNDARY}({suffix_alternatives()})(?:{BOUNDARY}|(?<=\\.))"


def normalize_company(c: Column, dotted: str = "literal") -> Column:
    """Name without legal suffixes; known abbreviations expand.

    ``dotted="literal"`` keeps the dot of "Inc." behind (the reference result);
    ``dotted="strip"`` also removes it and a dangling "&".
    """
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[,;]", "")
    if dotted == "strip":
        bare = F.regexp_replace(plain, DOTTED_RE, "")
        bare = F.regexp_replace(bare, r"[\s.&]+$", "")
        bare = F.regexp_replace(bare, r"\s\.(?=\s)", "")
    else:
        bare = F.regexp_replace(plain, SUFFIX_RE, "")
    name = collapse(bare)
    expansions = literal_map({k.lower(): v for k, v in D.ABBREVIATIONS.items()})
    return F.coalesce(F.try_element_at(expansions, F.lower(name)), name)


def company_suffixes(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SUFFIX_RE), F.lit(1))


def _suffix_lookup(suffixes: Column, table: dict[str, list[str]]) -> Column:
    entries = F.create_map(*chain.from_iterable(
        (F.lit(k), literal_array(v)) for k, v in table.items()))
    found = F.transform(suffixes, lambda s: F.try_element_at(entries, F.lower(s)))
    return F.array_distinct(F.flatten(F.filter(found, lambda x: x.isNotNull())))


def company_type(suffixes: Column) -> Column:
    return _suffix_lookup(suffixes, {s: [t] for t, names in D.SUFFIX_TYPES.items() for s in names})


def country_table() -> dict[str, list[str]]:
    """suffix -> countries, in the order the hints are added."""
    table: dict[str, list[str]] = {}
    for region, code in (("us", "US"), ("uk", "UK")):
        for s in D.SUFFIXES[region]:
            hints = table.setdefault(s.lower(), [])
            if code not in hints:
                hints.append(code)
    for s, codes in D.SUFFIX_COUNTRIES.items():
        table.setdefault(s, []).extend(codes)
    return table


def country_hints(suffixes: Column) -> Column:
    return _suffix_lookup(suffixes, country_table())


def expand_abbreviations(c: Column) -> Column:
    out = c
    for short, full in D.ABBREVIATIONS.items():
        out = F.regexp_replace(out, f"(?i){BOUNDARY}{_escaped(short)}{BOUNDARY}",
                               full.replace("$", r"\$"))
    return out


def variation_groups(name: Column) -> Column:
    """Ids of the variation groups a lower-cased normalised name belongs to."""
    table: dict[str, list[int]] = {}
    for i, (head, others) in enumerate(D.VARIATIONS.items()):
        for n in [head, *others]:
            table.setdefault(n, []).append(i)
    entries = F.create_map(*chain.from_iterable(
        (F.lit(k), literal_array(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(entries, name), F.array().cast("array<int>"))


def is_variation(a: Column, b: Column) -> Column:
    na, nb = F.lower(normalize_company(a)), F.lower(normalize_company(b))
    return (na == nb) | F.arrays_overlap(variation_groups(na), variation_groups(nb))


# --- mentions ----------------------------------------------------------------
def normalize_mention(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(collapse(c), r"""[.,;:!?'"]+$""", ""), r"""^['"]+""", "")


def is_ticker(c: Column) -> Column:
    bare = F.regexp_replace(c, r"^([^$]*)\$", "$1")
    return bare.rlike("^[A-Z]{1,5}$") & ~bare.isin(*D.EXCLUDED_TICKERS)


def has_company_context(text: Column) -> Column:
    """Corporate or industry context that keeps an ambiguous word."""
    return any_of([text.rlike(regex(p, f)) for f, p in D.AMBIGUOUS_CONTEXT])


def keep_ambiguous(normalized: Column, text: Column) -> Column:
    return ~normalized.isin(*D.AMBIGUOUS_WORDS) | has_company_context(text)


def entity_key(normalized: Column, kind: Column) -> Column:
    return F.concat_ws("_", normalized, kind)


def context_sentiment(c: Column) -> Column:
    pos = F.size(F.regexp_extract_all(c, F.lit(regex(D.CONTEXT_POSITIVE, "i")), F.lit(0)))
    neg = F.size(F.regexp_extract_all(c, F.lit(regex(D.CONTEXT_NEGATIVE, "i")), F.lit(0)))
    return (F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"))


def mention_context(text: Column, position: Column, mention: Column, width: int = 50) -> Column:
    """Window around a mention with its industries, figures and sentiment."""
    return describe_context(context_window(text, position, mention, width))


def context_window(text: Column, position: Column, mention: Column, width: int = 50) -> Column:
    """Text around a mention; ``position`` is the zero-based offset in ``text``."""
    start = F.greatest(F.lit(0), position - width)
    end = F.least(F.length(text), position + F.length(mention) + width)
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def describe_context(window: Column) -> Column:
    industries = F.filter(
        F.array(*[F.when(window.rlike(regex(p, "i")), F.lit(n)) for n, p in D.CONTEXT_INDUSTRIES]),
        lambda x: x.isNotNull())
    figures = F.filter(
        F.array(*[
            F.when(window.rlike(regex(p, f)),
                   F.struct(F.lit(n).alias("key"), F.regexp_extract(window, regex(p, f), 0).alias("value")))
            for n, f, p in D.CONTEXT_FINANCIAL]),
        lambda x: x.isNotNull())
    return F.struct(
        window.alias("text"),
        industries.alias("industries"),
        F.when(F.size(figures) > 0, F.map_from_entries(figures)).alias("financial"),
        context_sentiment(window).alias("sentiment"),
    )


# --- news --------------------------------------------------------------------
def count_contained(lowered: Column, words) -> Column:
    return sum((lowered.contains(w).cast("int") for w in words), F.lit(0))


def headline_sentiment(c: Column) -> Column:
    low = F.lower(c)
    pos, neg = count_contained(low, D.HEADLINE_POSITIVE), count_contained(low, D.HEADLINE_NEGATIVE)
    return F.when(pos > neg, "POSITIVE").when(neg > pos, "NEGATIVE").otherwise("NEUTRAL")


def ownership_relevance(text: Column, source_id: Column) -> Column:
    """Sum in a fixed order: the 0.3 filter is sensitive to the last bit."""
    low = F.lower(text)
    score = F.lit(0.0)
    for word in D.OWNERSHIP_KEYWORDS:
        score = score + F.when(low.contains(word), 0.2).otherwise(0.0)
    score = score + F.when(source_id.isin(*D.TIER1_SOURCES), 0.1).otherwise(0.0)
    for p in D.OWNERSHIP_PATTERNS:
        score = score + F.when(low.rlike("(?i)" + p), 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def key_indicators(text: Column, n: int = 3) -> Column:
    low = F.lower(text)
    percents = F.regexp_extract_all(low, F.lit(r"(\d+(?:\.\d+)?)%"), F.lit(0))
    amounts = F.regexp_extract_all(low, F.lit(r"(?i)\$(\d+(?:\.\d+)?)\s*(billion|million|b|m)"), F.lit(0))
    investors = F.array(*[F.when(low.contains(t), F.lit(t)) for t in D.INVESTOR_TYPES])
    return F.slice(F.concat(
        F.transform(percents, lambda x: F.concat(F.lit("Percentage: "), x)),
        F.transform(amounts, lambda x: F.concat(F.lit("Amount: "), x)),
        F.transform(F.filter(investors, lambda x: x.isNotNull()),
                    lambda x: F.concat(F.lit("Investor Type: "), x)),
    ), 1, n)


def registry_match(term: Column, name: Column) -> Column:
    """0-100: equal, contains, contained, else shared words."""
    a, b = F.lower(collapse(term)), F.lower(collapse(name))
    wa, wb = F.split(a, " "), F.split(b, " ")
    hits = F.size(F.filter(wa, lambda w: F.exists(wb, lambda v: v.contains(w) | w.contains(v))))
    share = hits / F.greatest(F.size(wa), F.size(wb)) * 60
    return (F.when(a == b, 100).when(b.contains(a), 85).when(a.contains(b), 75)
            .otherwise(half_up(share)).cast("int"))


# --- contracts ---------------------------------------------------------------
def is_classified(c: Column) -> Column:
    return F.coalesce(contains_any(F.lower(c), D.CLASSIFIED_KEYWORDS), F.lit(False))


def agency_weight(c: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(D.AGENCY_WEIGHTS), F.upper(c)), F.lit(1.0))


def is_offshore(code: Column) -> Column:
    return F.coalesce(F.lower(code).isin(*D.OFFSHORE_CODES), F.lit(False))


def money_scale(c: Column) -> Column:
    """Number and unit of a short money text (1.5 / 'M')."""
    def tenth(x):
        return half_up(x * 10) / 10
    return F.struct(
        F.when(c >= 1e9, tenth(c / 1e9)).when(c >= 1e6, tenth(c / 1e6))
         .when(c >= 1e3, tenth(c / 1e3)).otherwise(c).alias("amount"),
        F.when(c >= 1e9, "B").when(c >= 1e6, "M").when(c >= 1e3, "K").otherwise("").alias("unit"),
    )


def money_text(c: Column) -> Column:
    m = money_scale(c)
    scaled = F.format_string("%.1f", m["amount"].cast("double"))
    return F.concat(F.lit("$"), F.when(m["unit"] != "", scaled).otherwise(F.call_function("format_number", c, F.lit("#,##0.###"))),
                    m["unit"])


def requester_key(requester: Column, origin: Column) -> Column:
    """id_host; a missing origin is 'unknown', an unusable one 'invalid'."""
    host = F.try_parse_url(origin, F.lit("HOST"))
    return F.concat_ws("_", requester.cast("string"),
                       F.when(origin.isNull() | (origin == ""), F.lit("unknown"))
                       .otherwise(F.coalesce(host, F.lit("invalid"))))
