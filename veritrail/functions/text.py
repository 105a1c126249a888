"""Text functions as Column builders; all run inside code generation, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrail.functions.forms import collapse as collapse
from veritrail.functions.forms import fold as fold


#: Words that carry no topic.
STOPWORDS = ("a", "al", "and", "con", "de", "del", "el", "en", "for", "in", "la", "las", "los", "of", "on", "or", "para", "por", "que", "se", "the", "to", "un", "una", "y")


def tokens(text: Column, most: int | None = None) -> Column:
    """Runs of letters and digits of the folded text, at most ``most`` of them."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(found, 1, most) if most else found


def significant(term: Column) -> Column:
    """Whether a term is digits, or has three characters and is no stopword."""
    return term.rlike("^[0-9]+$") | ((F.length(term) >= 3) & ~term.isin(*STOPWORDS))


def query_terms(text: Column, most: int = 18) -> Column:
    """Distinct terms of digits or three characters and more, in order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(tokens(text, 64), lambda t: t.rlike("^[0-9]+$") | (F.length(t) >= 3))), 1, most)


def uppercase_ratio(text: Column) -> Column:
    """Share of letters in upper case; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))


def only_offset(text: Column, quote: Column) -> Column:
    """Where ``quote`` stands in ``text`` (from 0) if it stands there once; null otherwise."""
    first = F.position(quote, text)
    again = F.position(quote, text, first + 1)
    return F.when((F.trim(quote) != "") & (first > 0) & (again == 0), first - 1)


def is_question(text: Column) -> Column:
    return text.contains("¿") & F.trim(text).endswith("?")


def document_number(text: Column) -> Column:
    """A document number without spaces and leading zeros; one letter may follow."""
    tight = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.when(tight.rlike("^[0-9]+[A-Z]?$"), F.regexp_replace(tight, "^0+([0-9])", "$1")).otherwise(tight)


#: Spanish month names; the ninth has a second spelling.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spanish_date(text: Column) -> Column:
    """The date written as ``3 de mayo de 1999``; null for an unknown month or an impossible day."""
    pattern = r"([0-9]{1,2})\s+de\s+(\p{L}+)\s+(?:de|del)\s+([0-9]{4})"
    low = F.replace(fold(text), F.lit("setiembre"), F.lit("septiembre"))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, pattern, 2))
    iso = F.concat_ws("-", F.regexp_extract(low, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(low, pattern, 1), 2, "0"))
    return F.when(low.rlike(pattern) & (month > 0), F.try_to_date(iso, "yyyy-MM-dd"))


def decimal_text(number: Column) -> Column:
    """A decimal without exponent or closing zeros."""
    plain = number.cast("decimal(38,6)").cast("string")
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def backoff_seconds(attempts: Column, base: int, most: int) -> Column:
    """Seconds to wait after so many attempts: doubled each time, eight times at most, up to ``most``."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(8)))).cast("long"))
