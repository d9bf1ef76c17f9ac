"""Building blocks of the oracle SQL, written independently of the Column code."""

from __future__ import annotations

from ownerscope import dictionaries as D
from ownerscope.functions.text import suffix_alternatives


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(s(v) for v in values) + ")"


def list_of(values) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def rx(pattern: str, flags: str = "") -> str:
    return s(("(?i)" if "i" in flags else "") + pattern)


def contains_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, {s(w)})" for w in words) + ")"


SUFFIX = rx(rf"\b({suffix_alternatives()})\b", "i")


def norm0(expr: str) -> str:
    plain = f"regexp_replace({expr}, '[,;]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, {SUFFIX}, '', 'g'), '\\s+', ' ', 'g'))"


def abbreviated(expr: str) -> str:
    cases = " ".join(f"when {s(k.lower())} then {s(v)}" for k, v in D.ABBREVIATIONS.items())
    return f"case lower({expr}) {cases} else {expr} end"


def normalized(source: str, column: str, out: str) -> str:
    """``source`` with the normalised name of ``column`` added as ``out``."""
    return f"(select * exclude (n0__), {abbreviated('n0__')} as {out} from (select *, {norm0(column)} as n0__ from {source}) n__)"


def candidates_values() -> str:
    rows, ord_ = [], 0
    for company_ord, (cid, name, aliases, ticker, *_rest) in enumerate(D.KB_COMPANIES):
        for sub, (text, kind) in enumerate([(name, "name"), *[(a, "alias") for a in aliases], (ticker, "ticker")]):
            rows.append(f"({s(cid)}, {s(text)}, {s(kind)}, {D.CANDIDATE_BOOST[kind]}::double, {(company_ord << 32) + sub})")
    return "(select * from (values " + ", ".join(rows) + ") v(company_id, text, kind, boost, ord))"


def candidates_cte(tickers: bool = True) -> str:
    where = "" if tickers else " where kind <> 'ticker'"
    return (f"cand as (select company_id, text, kind, boost, ord, case when kind = 'ticker' then upper(text) else n end as b "
            f"from {normalized(candidates_values() + ' c', 'text', 'n')} x{where})")


def ratio(a: str, b: str) -> str:
    return (f"case when {a} = {b} then 1e0 else 1e0 - levenshtein({a}, {b})::double / "
            f"greatest(length({a}), length({b})) end")


def tokens(expr: str) -> str:
    return (f"list_filter(string_split_regex(regexp_replace(lower({expr}), '[^\\w\\s]', ' ', 'g'), '\\s+'), "
            f"lambda x: x <> '')")


def pair_ctes(source: str, prefix: str = "p") -> str:
    """CTEs scoring the (a, b) columns of ``source``; the last one is ``<prefix>5``."""
    stop = list_of(D.STOP_WORDS)
    bonus = " or ".join(
        f"(contains(la, {s(x)}) and contains(lb, {s(y)})) or (contains(la, {s(y)}) and contains(lb, {s(x)}))"
        for x, y in D.ABBREVIATION_PAIRS)
    p = prefix
    return f"""
{p}1 as (select *, lower(trim(a)) as la, lower(trim(b)) as lb, {tokens('a')} as ta, {tokens('b')} as tb from {source}),
{p}2 as (select *, array_to_string(list_sort(ta), ' ') as sa, array_to_string(list_sort(tb), ' ') as sb,
    list_distinct(ta) as da, list_distinct(tb) as db,
    case when length(la) <= length(lb) then la else lb end as sh, case when length(la) <= length(lb) then lb else la end as lo from {p}1),
{p}3 as (select *, case when len(list_filter(da, lambda x: not list_contains({stop}, x))) > 0
        then list_filter(da, lambda x: not list_contains({stop}, x)) else da end as ea,
    case when len(list_filter(db, lambda x: not list_contains({stop}, x))) > 0
        then list_filter(db, lambda x: not list_contains({stop}, x)) else db end as eb from {p}2),
{p}4 as (select *, (a = '' or b = '') as none_,
    {ratio('la', 'lb')} as r0,
    case when la = lb then 1e0 else list_max(list_transform(range(1, length(lo) - length(sh) + 2), lambda i:
        case when sh = '' or trim(substr(lo, i, length(sh))) = '' then 0e0
             else 1e0 - levenshtein(sh, trim(substr(lo, i, length(sh))))::double
                  / greatest(length(sh), length(trim(substr(lo, i, length(sh))))) end)) end as pr0,
    case when sa = '' or sb = '' then 0e0 else {ratio('sa', 'sb')} end as so0,
    case when len(list_distinct(list_concat(ea, eb))) = 0 then 1e0
         else len(list_intersect(ea, eb))::double / len(list_distinct(list_concat(ea, eb))) end as se0,
    case when {bonus} then 0.1::double else 0e0 end as bonus from {p}3),
{p}5 as (select *, case when none_ then 0e0 else r0 end as ratio, case when none_ then 0e0 else pr0 end as partial,
    case when none_ then 0e0 else so0 end as token_sort, case when none_ then 0e0 else se0 end as token_set,
    case when none_ then 0e0 else r0 * 0.2::double + pr0 * 0.2::double + so0 * 0.3::double + se0 * 0.3::double end as name_ratio
    from {p}4)"""


def label(expr: str) -> str:
    return ("case " + " ".join(f"when {expr} >= {b} then '{n}'" for b, n in D.SCORE_LABELS)
            + " else 'very_low' end")
