"""Column builders for label normalisation and answer cleaning.

All builders return JVM-side ``Column`` expressions (no Python UDFs).  A
builder that needs its input twice binds it once with :func:`let`, so that
chaining many steps does not grow the expression tree exponentially.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Whitespace as Python's str.split()/str.strip() see it (Unicode aware).
_WS = r"(?U)\s"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: ColumnOrName, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it (possibly many times) in ``body``."""
    return F.get(F.transform(F.array(_c(value)), body), 0)


# --- projections / normalisation (PRJ2-PRJ5) --------------------------------

def normalise_label(c: ColumnOrName) -> Column:
    """``str(s).replace('_', ' ').lower()``."""
    return F.lower(F.replace(_c(c).cast("string"), F.lit("_"), F.lit(" ")))


def report_key_underscore(c: ColumnOrName) -> Column:
    """Report normalisation A: lower-case, spaces become underscores."""
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit("_"))


def report_key_lower(c: ColumnOrName) -> Column:
    """Report normalisation B: lower-case only."""
    return F.lower(_c(c))


def null_to_empty(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


# --- whitespace -------------------------------------------------------------

def strip(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: drop leading and trailing whitespace."""
    return F.regexp_replace(_c(c), rf"^{_WS}+|{_WS}+$", "")


def collapse_ws(c: ColumnOrName) -> Column:
    """Python ``' '.join(s.split())``."""
    return F.regexp_replace(strip(c), rf"{_WS}+", " ")


# --- extraction (TXT1-TXT3) -------------------------------------------------

ASSISTANT_MARKER = "ASSISTANT: "
IMAGE_MARKER = "<image>"


def assistant_extract(c: ColumnOrName) -> Column:
    """Answer after the chat marker, with newlines removed.

    Decided per row: text without the marker passes through unchanged.
    """
    return let(c, lambda x: F.when(
        F.contains(x, F.lit(ASSISTANT_MARKER)),
        F.get(F.split(F.replace(x, F.lit("\n"), F.lit("")), ASSISTANT_MARKER, -1), 1),
    ).otherwise(x))


def fewshot_tail(c: ColumnOrName, piece: int = 3) -> Column:
    """Text after the third ``<image>`` tag (the query turn of a two-shot prompt)."""
    return let(c, lambda x: F.when(
        F.contains(x, F.lit(IMAGE_MARKER)),
        F.coalesce(F.get(F.split(x, IMAGE_MARKER, -1), piece), F.lit("")),
    ).otherwise(x))


def sentence_with(c: ColumnOrName, word: str) -> Column:
    """First '.'-separated sentence containing ``word`` (case-insensitive), stripped.

    Without such a sentence the whole text is returned.
    """
    w = word.lower()

    def body(x: Column) -> Column:
        found = F.coalesce(
            strip(F.get(F.filter(F.split(x, r"\.", -1), lambda s: F.contains(F.lower(s), F.lit(w))), 0)), x)
        if not w.isascii():
            return found
        # Fast path: without the word anywhere in the text no sentence can hold it.
        return F.when(F.contains(F.lower(x), F.lit(w)), found).otherwise(x)
    return let(c, body)


def keep_before(c: ColumnOrName, delim: str) -> Column:
    """``s.split(delim)[0]``."""
    return F.substring_index(_c(c), delim, 1)


def keep_after_last(c: ColumnOrName, delim: str) -> Column:
    """``s.split(delim)[-1]``."""
    return F.substring_index(_c(c), delim, -1)


def delete(c: ColumnOrName, s: str) -> Column:
    """``s.replace(sub, '')`` (literal, all occurrences)."""
    return F.replace(_c(c), F.lit(s), F.lit(""))


# --- phrase removal (TXT5-TXT7) ---------------------------------------------

# Patterns that must equal the reference's.
AUTHOR_PHRASE = (r"\bby [A-Z][a-z]*(?: [A-Z][a-z]*)*(?: [A-Z]*[a-z]{0,3})*"
                 r"(?: [A-Z][a-z]* )* [A-Z][a-z]* \b")
YEAR_PHRASE = r"\bmade in [0-9]{4} \b"
CENTURY = r"([0-9]+)(?:st|nd|rd|th) century"
FOUR_DIGITS = r"[0-9]{4}"
# Texts that count as a number, and the size below which a bucket is a whole number of 64 bits.
NUMBER = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
LARGEST = 9e18
# Digits up to the last one that is not 0, that digit, and the zeros after it.
LAST_NONZERO = "^(.*)([1-9])(0*)$"


def remove_author(c: ColumnOrName) -> Column:
    """Drop an ``by <Name Name> `` phrase, then collapse whitespace."""
    return collapse_ws(F.regexp_replace(_c(c), AUTHOR_PHRASE, ""))


def remove_year(c: ColumnOrName) -> Column:
    """Drop a ``made in <4 digits> `` phrase, then collapse whitespace."""
    return collapse_ws(F.regexp_replace(_c(c), YEAR_PHRASE, ""))


# --- years (TXT8-TXT10) -----------------------------------------------------

def _first_year_of(digits: Column) -> Column:
    """(n - 1) * 100 as text, on the digits of n themselves: any number of them."""
    def body(d: Column) -> Column:
        less = F.concat(F.regexp_extract(d, LAST_NONZERO, 1),
                        F.translate(F.regexp_extract(d, LAST_NONZERO, 2), "123456789", "012345678"),
                        F.replace(F.regexp_extract(d, LAST_NONZERO, 3), F.lit("0"), F.lit("9")))
        years = F.regexp_replace(F.concat(less, F.lit("00")), "^0+(?=[0-9])", "")
        return F.when(F.regexp_like(d, F.lit("^0*$")), F.lit("-100")).otherwise(years)
    return let(digits, body)


def century_to_year(c: ColumnOrName) -> Column:
    """Rewrite every ``<n>th century`` as ``(n-1)*100``.

    Distinct matches are replaced longest first, so a match that is a suffix
    of a longer one ("9th century" in "19th century") cannot be hit early.
    """
    def body(x: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(x, F.lit(CENTURY), 0))
        longest_first = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
        rewritten = F.aggregate(
            longest_first, x,
            lambda acc, m: F.replace(acc, m, _first_year_of(F.regexp_extract(m, "^[0-9]+", 0))),
        )
        # Fast path: texts without the word "century" have no match.
        return F.when(F.contains(x, F.lit(" century")), rewritten).otherwise(x)
    return let(c, body)


def find_year(c: ColumnOrName) -> Column:
    """First run of four digits, else ``'0'``."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), FOUR_DIGITS, 0), F.lit("")), F.lit("0"))


def year_bucket(c: ColumnOrName, precision: int | Column = 100) -> Column:
    """Numeric value floored to ``precision`` (10 decade, 100 century) as text.

    Unparseable input counts as 0, like ``pd.to_numeric(errors='coerce')``, and so
    does a number beyond 64 bits or an infinite one.
    """
    p = precision if isinstance(precision, Column) else F.lit(int(precision))

    def body(x: Column) -> Column:
        v = x.try_cast("double")
        v = F.when(F.regexp_like(x, F.lit(NUMBER)) & (F.abs(v) < F.lit(LARGEST)), v).otherwise(F.lit(0.0))
        return (F.floor(v / p) * p).cast("bigint").cast("string")
    return let(_c(c).cast("string"), body)
