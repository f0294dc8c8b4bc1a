"""Text normalisation, tokens and detectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no topic, and suffixes cut by the stemmer, longest first
STOPWORDS = ("the", "and", "of", "to", "in", "is", "for", "on", "with", "a", "an", "or", "by", "at", "what")
SUFFIXES = ("ments", "ment", "tions", "tion", "ings", "ing", "s")


def normalize_text(c: Column) -> Column:
    """All white space, no-break space too, to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def normalize_lines(c: Column) -> Column:
    """Each line normalised, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), normalize_text), lambda x: x != ""), "\n")


def normalize_money(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(\d)[,\x20](?=\d{3}(\D|$))", "$1"))


def canonical_decimal(c: Column) -> Column:
    """A decimal as text without needless zeros."""
    text = c.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def normalize_percentage(c: Column) -> Column:
    """'12,50 %' and '12.5' become '12.5%'; null where it is no number."""
    number = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*%$", ""), ",", ".").try_cast("decimal(38,6)")
    return F.when(number.isNotNull(), F.concat(canonical_decimal(number), F.lit("%")))


def locale_decimal(c: Column) -> Column:
    """One comma is a thousands mark only with exactly three digits behind it and no leading zero; else a decimal comma."""
    one = F.regexp_count(c, F.lit(",")) == 1
    thousands = F.regexp_like(c, F.lit(r"^[1-9]\d{0,2},\d{3}(\.\d+)?$"))
    text = F.when(one & ~thousands & ~F.contains(c, F.lit(".")), F.regexp_replace(c, ",", ".")).otherwise(F.regexp_replace(c, ",", ""))
    return text.try_cast("decimal(38,6)")


def collapsed(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def term_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case words of two letters and more, without marks inside words and without stopwords."""
    plain = F.regexp_replace(F.lower(c), r"['’`]", "")
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: F.char_length(x) > 1)
    return F.filter(words, lambda x: ~x.isin(*STOPWORDS))


def stem(c: Column) -> Column:
    """The word without its first matching suffix, if three letters stay."""
    out = c
    for suffix in reversed(SUFFIXES):
        out = F.when(c.endswith(suffix) & (F.char_length(c) >= len(suffix) + 3), F.substring(c, F.lit(1), F.char_length(c) - len(suffix))).otherwise(out)
    return out


def search_query(c: Column, most: int = 12, prefix_from: int = 4) -> Column:
    """Distinct tokens joined by |, long ones as prefixes."""
    terms = F.slice(F.array_distinct(tokens(c)), 1, most)
    return F.array_join(F.transform(terms, lambda x: F.when(F.char_length(x) >= prefix_from, F.concat(x, F.lit(":*"))).otherwise(x)), " | ")


def script(c: Column) -> Column:
    """en for ASCII letters only, other for other letters only, mixed, or null without letters."""
    ascii_ = F.regexp_count(c, F.lit("[A-Za-z]"))
    other = F.regexp_count(c, F.lit(r"[^\x00-\x7F]"))
    return F.when((ascii_ > 0) & (other > 0), "mixed").when(ascii_ > 0, "en").when(other > 0, "other")


def whole_term(text: Column, term: str, suffix: str = "") -> Column:
    """Whether the term stands in the text as whole words, with a tolerated suffix pattern."""
    return F.regexp_like(F.lower(text), F.lit(rf"(^|[^a-z0-9]){term.lower()}({suffix})?([^a-z0-9]|$)"))


def plain_text(c: Column) -> Column:
    """Markdown links to their text, tags dropped."""
    return F.regexp_replace(F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1"), "<[^>]+>", "")


def escape_cell(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), "\n", "<br>")


def list_items(c: Column) -> Column:
    """Lines that are list items, without their marks."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*([-*•]|\d+[.)])\s+")))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*([-*•]|\d+[.)])\s+", ""))


def superscripts_to_digits(c: Column) -> Column:
    return F.translate(c, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def footnote_marker(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([*†‡]+|\d+\)|[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", 1)


def is_label(c: Column) -> Column:
    return (F.char_length(c) <= 60) & (F.char_length(c) > 0) & ~F.regexp_like(c, F.lit(r"[.!?;]|\d")) & ~F.regexp_like(c, F.lit(r"^\s*[-*•]"))


def key_value(c: Column) -> tuple[Column, Column]:
    parts = F.split(c, r"\s*:\s*", 2)
    has = F.size(parts) == 2
    return F.when(has, parts[0]), F.when(has, parts[1])


def is_measured_label(c: Column) -> Column:
    """'label: value' with a digit and a unit."""
    return F.regexp_like(c, F.lit(r"(?i)^[^:\n]{2,60}:\s*[^\n]*\d[^\n]*(%|usd|eur|amd|month|year|day)"))


def one_category(c: Column, groups: dict[str, str], otherwise: str = "OTHER") -> Column:
    """The only category whose pattern is in the text, else ``otherwise``."""
    hits = [F.regexp_like(F.lower(c), F.lit(p)) for p in groups.values()]
    count = sum((h.cast("int") for h in hits), F.lit(0))
    out = F.lit(otherwise)
    for name, h in zip(groups, hits, strict=True):
        out = F.when((count == 1) & h, F.lit(name)).otherwise(out)
    return out


def stitched_parts(c: Column, least: int = 3) -> Column:
    """Verbatim parts of a quote stitched with ellipses."""
    return F.filter(F.transform(F.split(c, r"\s*(?:…|\.\.\.)\s*"), F.trim), lambda x: F.char_length(x) >= least)


def quote_holds(quote: Column, content: Column) -> Column:
    """Whether each part of a stitched quote is in the content, whatever the case and spacing."""
    return F.forall(stitched_parts(quote), lambda p: F.contains(collapsed(content), collapsed(p)))
