"""Numbers, dates, ranges, periods, JSON and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: comparison words, unit names, error classes, condition synonyms, multipliers
COMPARISONS = {"up to": "<=", "at most": "<=", "not more than": "<=", "no more than": "<=", "not less than": ">=", "no less than": ">=", "at least": ">=", "from": ">=", "over": ">", "more than": ">", "under": "<", "less than": "<"}
UNITS = {"%": "percent", "percent": "percent", "$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "֏": "AMD", "amd": "AMD", "months": "month", "month": "month", "years": "year", "year": "year", "days": "day", "day": "day", "dollar": "USD", "dollars": "USD", "euro": "EUR", "euros": "EUR", "dram": "AMD", "drams": "AMD"}
ERROR_CODES = {"timeout": "source_timeout", "connect": "source_unreachable", "parse": "source_invalid", "quota": "rate_limited"}
CONDITIONS = {"currency": "currency", "ccy": "currency", "term": "term", "maturity": "term", "amount": "amount", "sum": "amount", "channel": "channel"}
MULTIPLIERS = {"thousand": 1_000, "million": 1_000_000}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def comparison(c: Column) -> Column:
    """The operator of the first comparison words in the text, whole words only."""
    words = F.regexp_extract(F.lower(c), r"(?:^|[^\p{L}])(" + "|".join(sorted(COMPARISONS, key=len, reverse=True)) + r")(?:[^\p{L}]|$)", 1)
    return F.try_element_at(_lookup(COMPARISONS), words)


def unit(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(UNITS), F.lower(F.trim(c))), F.upper(F.trim(c)))


def number_range(c: Column) -> Column:
    """Struct of low and high of 'a-b'; null if there is none or it falls."""
    a, b = (F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)", i).try_cast("decimal(18,6)") for i in (1, 2))
    return F.when(a <= b, F.struct(a.alias("low"), b.alias("high")))


def numbers(c: Column) -> Column:
    """All plain numbers of a text as decimals, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.try_cast("decimal(38,6)"))


def parse_date(c: Column) -> Column:
    """Year first or day first with -, / or . between (two-digit years are 20xx), 'Month day, year' and 'day Month year'; null for none or an impossible date."""
    iso = F.try_to_date(F.regexp_replace(F.regexp_extract(c, r"(?<!\d)(\d{4}([-/.])\d{2}\2\d{2})(?!\d)", 1), "[/.]", "-"), "yyyy-MM-dd")
    d, m, y = (F.regexp_extract(c, r"(?<!\d)(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})(?!\d)", i) for i in (1, 2, 3))
    full = F.when(F.char_length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    dotted = F.try_to_date(F.concat_ws("-", full, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    names = F.create_map(*[F.lit(x) for k, n in enumerate(MONTHS) for x in (n, f"{k + 1:02d}")])
    month = "(" + "|".join(MONTHS) + ")"
    english = lambda p, mi, di, yi: F.try_to_date(F.concat_ws("-", F.regexp_extract(F.lower(c), p, yi), F.try_element_at(names, F.regexp_extract(F.lower(c), p, mi)), F.lpad(F.regexp_extract(F.lower(c), p, di), 2, "0")), "yyyy-MM-dd")
    a = english(month + r"\s+(\d{1,2}),?\s+(\d{4})", 1, 2, 3)
    b = english(r"(\d{1,2})\s+" + month + r"\s+(\d{4})", 2, 1, 3)
    return F.coalesce(iso, dotted, a, b)


def period_status(periods: Column, as_of: Column) -> Column:
    """current, historical, future or time_bounded of an array of (starts, ends); null without periods; open ends are null."""
    inside = lambda p: (p["starts"].isNull() | (p["starts"] <= as_of)) & (p["ends"].isNull() | (p["ends"] >= as_of))
    past = lambda p: F.coalesce(p["ends"] < as_of, F.lit(False))
    ahead = lambda p: F.coalesce(p["starts"] > as_of, F.lit(False))
    return F.when(F.coalesce(F.size(periods), F.lit(0)) < 1, None).when(F.exists(periods, inside), "current").when(F.forall(periods, past), "historical").when(F.forall(periods, ahead), "future").otherwise("time_bounded")


def suffixed_amount(c: Column) -> Column:
    """'1.5 million' as a number."""
    base = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("decimal(18,6)")
    factor = F.coalesce(F.try_element_at(_lookup(MULTIPLIERS), F.regexp_extract(F.lower(c), "(thousand|million)", 1)), F.lit(1))
    return base * factor


def percentage_points(c: Column) -> Column:
    return F.when((c > 0) & (c < 1), c * 100).otherwise(c)


def whole_months(number: Column, unit_: Column) -> Column:
    months = F.when(unit_ == "year", number * 12).when(unit_ == "month", number)
    return F.when(months == F.floor(months), months.cast("long"))


def condition_dimension(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(CONDITIONS), F.lower(F.trim(c))), F.lit("other"))


def error_code(c: Column) -> Column:
    """Stable code of an error text; an HTTP status wins."""
    status = F.regexp_extract(c, r"\b([45]\d\d)\b", 1)
    word = F.regexp_extract(F.lower(c), "(" + "|".join(ERROR_CODES) + ")", 1)
    return F.when(status != "", F.concat(F.lit("http_"), status)).otherwise(F.coalesce(F.try_element_at(_lookup(ERROR_CODES), word), F.lit("unexpected")))


def age_seconds(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then)).cast("long")


def wall_clock(c: Column, zone: str) -> Column:
    return F.from_utc_timestamp(c, zone)


def number_key(c: Column) -> Column:
    """Comparison key of a number text: 12.0 is 12, 1.000 is not 1,000."""
    plain = F.regexp_like(c, F.lit(r"^\d+(\.\d+)?$"))
    stripped = F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain & F.contains(c, F.lit(".")), stripped).otherwise(c)


def display_json(c: Column, most: int = 2000) -> Column:
    return F.substring(F.to_json(c), 1, most)


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/?#]+)", 1))


def path_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1)), "/+$", "")


def allowed(c: Column, hosts: list[str]) -> Column:
    """http(s), a listed host or below one, no credentials, no bare IP."""
    h = host(c)
    named = F.lit(False)
    for x in hosts:
        named = named | (h == x) | h.endswith("." + x)
    return named & ~F.contains(h, F.lit("@")) & ~F.regexp_like(h, F.lit(r"^[\d.]+(:\d+)?$"))


def document_name(text: Column, url: Column) -> Column:
    """Link text, else the last part of the URL's path."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.nullif(F.element_at(F.split(path_key(url), "/"), -1), F.lit("")), host(url))


def effective_range(c: Column) -> Column:
    """Struct of starts and ends of 'from D to D' or 'until D' with ISO dates; null ends are open."""
    day = r"(\d{4}-\d{2}-\d{2})"
    starts = F.try_to_date(F.regexp_extract(F.lower(c), "from " + day, 1), "yyyy-MM-dd")
    ends = F.try_to_date(F.regexp_extract(F.lower(c), "(?:to|until) " + day, 1), "yyyy-MM-dd")
    return F.when(starts.isNotNull() | ends.isNotNull(), F.struct(starts.alias("starts"), ends.alias("ends")))


def rate_and_term(c: Column) -> Column:
    """Struct of percentage and months of a free line such as '12.5% for 3 years'."""
    percent = F.regexp_extract(c, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    n = F.regexp_extract(F.lower(c), r"(\d+)\s*(?:year|month)", 1).try_cast("long")
    months = F.when(F.regexp_like(F.lower(c), F.lit(r"\d+\s*year")), n * 12).otherwise(n)
    return F.struct(percent.alias("percent"), months.alias("months"))


def renamed_keys(c: Column, aliases: dict[str, str]) -> Column:
    """A map with alias keys under their canonical names; entries already canonical win."""
    known = _lookup(aliases)
    own = F.map_filter(c, lambda k, v: ~k.isin(*aliases))
    moved = F.transform_keys(F.map_filter(c, lambda k, v: k.isin(*aliases)), lambda k, v: known[k])
    return F.map_concat(own, F.map_filter(moved, lambda k, v: ~F.map_contains_key(own, k)))
