"""What numbers a text states: typed spans, every reading of a number, and lines that state money, rates, terms, fees, ages or yes and no."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: numbers, multiplier words, currencies, units, words of bounds, rate types
NUMBER = "\\d+(?:[.,\u00a0 ]\\d{3})+(?:[.,]\\d+)?|\\d+(?:[.,]\\d+)?"
MULTIPLIERS = {"billion": 1_000_000_000, "bln": 1_000_000_000, "bn": 1_000_000_000, "million": 1_000_000, "mln": 1_000_000, "mn": 1_000_000, "mio": 1_000_000, "thousand": 1000, "thsd": 1000, "k": 1000}
CURRENCIES = {"usd": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "eur": "EUR", "€": "EUR", "euro": "EUR", "euros": "EUR", "amd": "AMD", "֏": "AMD", "dram": "AMD", "drams": "AMD"}
UNITS = {"%": "percent", "percent": "percent", "month": "month", "months": "month", "year": "year", "years": "year", "day": "day", "days": "day"} | CURRENCIES
UPPER_WORDS = ("up to", "maximum", "at most", "no more than", "not more than", "not exceeding")
LOWER_WORDS = ("from", "minimum", "at least", "no less than", "not less than", "starting")
OPERATORS = {"up to": "<=", "at most": "<=", "no more than": "<=", "not more than": "<=", "at least": ">=", "no less than": ">=", "not less than": ">=", "from": ">=", "more than": ">", "over": ">", "above": ">", "less than": "<", "under": "<", "below": "<"}
RATE_TYPES = ("fixed", "variable", "floating", "adjustable")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

_DECIMAL = "decimal(38,6)"


def _either(words) -> str:
    """A pattern of words, longer ones first; signs stand for themselves."""
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def number_readings(c: Column, months: bool = False) -> Column:
    """All readings of all numbers of a text, each once: separators as thousands or decimals, times a multiplier word that the text holds.

    With ``months``, years in months and the month after a threshold count too. Null for a null text.
    """
    plain = F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1), lambda x: F.regexp_replace(x, "[\u00a0 ]", ""))
    without = lambda x, chars: F.translate(x, chars, "")
    each = F.transform(plain, lambda x: F.transform(F.array(without(x, ","), F.translate(x, ",", "."), F.translate(without(x, "."), ",", "."), without(x, ".,")), lambda y: y.try_cast(_DECIMAL)))
    out = F.array_distinct(F.array_compact(F.flatten(each)))
    times = lambda n: F.transform(out, lambda x: F.try_multiply(x, F.lit(Decimal(n))).try_cast(_DECIMAL))
    scaled = [out]
    for factor in sorted(set(MULTIPLIERS.values())):
        words = _either(w for w, f in MULTIPLIERS.items() if f == factor and len(w) > 1)
        scaled.append(F.when(F.regexp_like(F.lower(c), F.lit(rf"\b(?:{words})\b")), times(factor)).otherwise(F.array().cast(f"array<{_DECIMAL}>")))
    if months:
        scaled += [times(12), F.transform(out, lambda x: F.try_add(x, F.lit(Decimal(1))).try_cast(_DECIMAL))]
    return F.array_distinct(F.array_compact(F.concat(*scaled)))


def ungrounded_numbers(numbers: Column, quote: Column, months: bool = False) -> Column:
    """The non-zero numbers that no reading of the quote gives."""
    return F.array_except(F.filter(numbers, lambda x: x != 0), F.coalesce(number_readings(quote, months), F.array().cast(f"array<{_DECIMAL}>")))


def stated_number(c: Column) -> Column:
    """One number text as a decimal: a single comma is a thousands mark only before three digits and behind a whole number other than zero."""
    x = F.regexp_replace(c, "[\u00a0 ]", "")
    lone = F.regexp_like(x, F.lit(r"^\d+,\d+$"))
    thousands = F.regexp_like(x, F.lit(r"^0*[1-9]\d*,\d{3}$"))
    return F.when(lone & ~thousands, F.translate(x, ",", ".")).otherwise(F.translate(x, ",", "")).try_cast(_DECIMAL)


def bounds(c: Column) -> Column:
    """(low, high) that a line states: its least and greatest number of two or more; of one, by the words before it; multiplier words count for their number, a last one for all."""
    text = F.lower(c)
    with_unit = rf"({NUMBER})\s*({_either(MULTIPLIERS)})?\b"
    texts, units = (F.regexp_extract_all(text, F.lit(with_unit), k) for k in (1, 2))
    factors = F.create_map(*[F.lit(x) for w, f in MULTIPLIERS.items() for x in (w, Decimal(f))])
    last = F.element_at(units, -1)
    factor = lambda u: F.coalesce(F.try_element_at(factors, F.when(u != "", u).otherwise(last)), F.lit(Decimal(1)))
    values = F.array_compact(F.transform(F.arrays_zip(texts.alias("t"), units.alias("u")), lambda s: F.try_multiply(stated_number(s["t"]), factor(s["u"])).try_cast(_DECIMAL)))
    one, has = F.get(values, 0), lambda words: F.regexp_like(text, F.lit(rf"\b(?:{_either(words)})\b"))
    upper, lower = has(UPPER_WORDS), has(LOWER_WORDS)
    many = F.size(values) >= 2
    low = F.when(many, F.array_min(values)).when(upper, None).otherwise(one)
    high = F.when(many, F.array_max(values)).when(~upper & lower, None).otherwise(one)
    return F.when(F.size(values) > 0, F.struct(low.alias("low"), high.alias("high")))


def currency(c: Column) -> Column:
    """The code of the first currency word or sign."""
    words, signs = _either(w for w in CURRENCIES if w.isalpha()), _either(w for w in CURRENCIES if not w.isalpha())
    found = F.regexp_extract(F.lower(c), rf"(\b(?:{words})\b|{signs})", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair]), found)


def money_range(c: Column) -> Column:
    """(low, high, currency) of a line such as 'USD 3-150 million'; null without a number."""
    b = bounds(c)
    return F.when(b.isNotNull(), F.struct(b["low"].alias("low"), b["high"].alias("high"), currency(c).alias("currency")))


def rate(c: Column) -> Column:
    """(low, high, rate_type) of a line such as 'from 12.5%, fixed'; null without a percentage."""
    b = bounds(c)
    kind = F.regexp_extract(F.lower(c), rf"\b({_either(RATE_TYPES)})\b", 1)
    return F.when(F.contains(c, F.lit("%")) & b.isNotNull(), F.struct(b["low"].alias("low"), b["high"].alias("high"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("rate_type")))


def term(c: Column) -> Column:
    """(low_months, high_months, indefinite) of a line in months or years."""
    b, years = bounds(c), F.regexp_like(F.lower(c), F.lit(r"\byears?\b"))
    months = lambda x: F.when(years, F.try_multiply(x, F.lit(Decimal(12)))).otherwise(x).cast("long")
    indefinite = F.regexp_like(F.lower(c), F.lit(r"\bindefinite\s+term\b"))
    unit = years | F.regexp_like(F.lower(c), F.lit(r"\bmonths?\b"))
    return F.when(indefinite | (unit & b.isNotNull()), F.struct(F.when(~indefinite, months(b["low"])).alias("low_months"), F.when(~indefinite, months(b["high"])).alias("high_months"), indefinite.alias("indefinite")))


def fee_line(c: Column) -> Column:
    """(percent, low, high, currency, free) of a line such as '0.5%, minimum 1,000 AMD'; amounts are what follows the percentage."""
    percent = F.regexp_extract(c, rf"({NUMBER})\s*%", 1)
    rest = F.regexp_replace(c, rf"(?:{NUMBER})\s*%", " ")
    b = bounds(rest)
    free = F.regexp_like(F.lower(c), F.lit(r"\b(?:free|no fee|not charged|waived)\b"))
    return F.struct(stated_number(F.nullif(percent, F.lit(""))).alias("percent"), b["low"].alias("low"), b["high"].alias("high"), currency(rest).alias("currency"), free.alias("free"))


def age_range(c: Column) -> Column:
    """(low, high) whole years of a line that names ages."""
    b = bounds(c)
    return F.when(F.regexp_like(F.lower(c), F.lit(r"\b(?:age|aged|years?\s+old|years?)\b")) & b.isNotNull(), F.struct(b["low"].cast("long").alias("low"), b["high"].cast("long").alias("high")))


def yes_no(c: Column) -> Column:
    """True or false of the first word that says so; null for none."""
    word = F.regexp_extract(F.lower(c), r"\b(yes|true|required|available|no|false|not)\b", 1)
    return F.when(word.isin("yes", "true", "required", "available"), True).when(word.isin("no", "false", "not"), False)


_MONTH = "|".join(MONTHS)
_CURRENCY = _either(CURRENCIES)
_UNIT = _either(UNITS)
_DATES = (
    re.compile(r"(?<!\d)(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?!\d)"),
    re.compile(r"(?<!\d)(?P<d>\d{1,2})[./](?P<m>\d{1,2})[./](?P<y>\d{4})(?!\d)"),
    re.compile(rf"\b(?P<m>{_MONTH})\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?!\d)", re.I),
    re.compile(rf"(?<!\d)(?P<d>\d{{1,2}})\s+(?P<m>{_MONTH})\s+(?P<y>\d{{4}})(?!\d)", re.I),
)
_RANGES = (
    re.compile(rf"(?<![\w$€֏])(?P<unit>{_CURRENCY})\s*(?P<low>{NUMBER})\s*(?:-|–|—|\bto\b)\s*(?P<high>{NUMBER})(?!\d)", re.I),
    re.compile(rf"(?<![\d.,])(?P<low>{NUMBER})\s*(?P<unit>{_UNIT})?\s*(?:-|–|—|\bto\b)\s*(?P<high>{NUMBER})(?:\s*(?P<last>{_UNIT})(?!\w))?(?![\d])", re.I),
)
_COMPARED = re.compile(rf"\b(?P<op>{_either(OPERATORS)})\s+(?:(?P<front>{_CURRENCY})\s*)?(?P<low>{NUMBER})(?:\s*(?P<unit>{_UNIT})(?!\w))?(?!\d)", re.I)
_VALUES = (
    re.compile(rf"(?<![\w$€֏])(?P<unit>{_CURRENCY})\s*(?P<low>{NUMBER})(?!\d)", re.I),
    re.compile(rf"(?<![\d.,])(?P<low>{NUMBER})\s*(?P<unit>{_UNIT})(?!\w)", re.I),
)


def _decimal(text: str) -> Decimal | None:
    x = text.replace(" ", "").replace("\u00a0", "")
    whole, comma, part = x.partition(",")
    if comma and "." not in x and "," not in part and (len(part) != 3 or not whole.lstrip("0")):
        x = f"{whole}.{part}"
    try:
        value = Decimal(x.replace(",", ""))
    except InvalidOperation:
        return None
    return value.quantize(Decimal("0.000001")) if value.adjusted() < 30 else None


def scan_scalars(text: str) -> list[dict]:
    """Dates first, then ranges, comparisons and values with a unit; spans never overlap and come in order."""
    found: list[dict] = []
    taken = bytearray(len(text))

    def add(match: re.Match, **made) -> None:
        a, b = match.span()
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            empty = dict.fromkeys(("operator", "value", "low", "high", "unit", "day"))
            found.append(empty | {"raw": match.group(), "start": a, "end": b} | made)

    def unit(text: str | None) -> str | None:
        return UNITS.get(text.lower()) if text else None

    for pattern in _DATES:
        for m in pattern.finditer(text):
            month = m["m"] if m["m"].isdigit() else MONTHS.index(m["m"].lower()) + 1
            try:
                add(m, kind="date", day=date(int(m["y"]), int(month), int(m["d"])))
            except ValueError:
                continue
    for pattern in _RANGES:
        for m in pattern.finditer(text):
            low, high = _decimal(m["low"]), _decimal(m["high"])
            if low is not None and high is not None and low <= high:
                add(m, kind="range", low=low, high=high, unit=unit(m.groupdict().get("last") or m["unit"]))
    for m in _COMPARED.finditer(text):
        if (value := _decimal(m["low"])) is not None:
            add(m, kind="number", operator=OPERATORS[m["op"].lower()], value=value, unit=unit(m["unit"] or m["front"]))
    for pattern in _VALUES:
        for m in pattern.finditer(text):
            if (value := _decimal(m["low"])) is not None:
                add(m, kind="number", value=value, unit=unit(m["unit"]))
    return sorted(found, key=lambda s: s["start"])


SCALAR = "array<struct<kind:string,operator:string,value:decimal(38,6),low:decimal(38,6),high:decimal(38,6),unit:string,day:date,raw:string,start:int,end:int>>"
_FIELDS = [("kind", pa.string()), ("operator", pa.string()), ("value", pa.decimal128(38, 6)), ("low", pa.decimal128(38, 6)), ("high", pa.decimal128(38, 6)), ("unit", pa.string()), ("day", pa.date32()), ("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32())]


def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([scan_scalars(t or "") for t in texts.to_pylist()], pa.list_(pa.struct(_FIELDS)))


def extract_scalars_udf():
    """The Arrow function, for registration in a session."""
    return F.arrow_udf(_spans, SCALAR)


def extract_scalars(c: Column) -> Column:
    """Array of typed spans of a text: kind (date, range, number), operator, value, low and high, unit, day, raw text and place. Null text has none."""
    return extract_scalars_udf()(c)
