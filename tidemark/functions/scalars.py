"""Scalar expressions: number and date normalisers, quote extraction, rounding, business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP, NARROW_NBSP = "\u00a0", "\u202f"
#: White space that is cut off both ends of a text.
BLANKS = f" \t\n\r\f\v{NBSP}{NARROW_NBSP}"
#: A time of day that may follow a date, with or without a zone.
TIME = r"([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|UTC|[+-]\d{2}:?\d{2})?)?"
#: Dates with the name of a month.
NAMED = r"\d{1,2}[-/., ]+[a-z]{3,9}[-/., ]+\d{4}|[a-z]{3,9}[-/., ]+\d{1,2}[-/., ]+\d{4}|\d{4}[-/., ]+[a-z]{3,9}[-/., ]+\d{1,2}"
#: Texts that stand for a missing value.
MISSING = ("", "nan", "None", "null")
#: Rates outside of this range are not believed.
PLAUSIBLE = (500.0, 10_000.0)


def audit_text(raw: Column) -> Column:
    """A number's text for the audit: trimmed, without spaces; a comma becomes the point only where there is no point."""
    text = F.translate(F.btrim(raw, F.lit(BLANKS)), f"{NBSP} ", "")
    return F.when(text.contains(",") & ~text.contains("."), F.replace(text, F.lit(","), F.lit("."))).otherwise(text)


def to_double(text: Column) -> Column:
    """The number that a text spells, null where it spells none (type suffixes such as 1d or 2f are no numbers)."""
    return F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double"))


def audit_number(raw: Column) -> Column:
    """Value of a raw field, null where it is missing or no number; "1,234.5" is no number here."""
    return number_of(audit_text(raw))


def number_of(text: Column) -> Column:
    """Value of a text that audit_text made."""
    return F.when(~text.isin(*MISSING), to_double(text))


def quoted_number(raw: Column) -> Column:
    """Value of a scraped number: of comma and point the last one is the decimal sign, a lone comma too."""
    text = F.translate(F.btrim(raw, F.lit(BLANKS)), f"{NARROW_NBSP}{NBSP} ", "")
    last = lambda sign: F.length(text) - F.instr(F.reverse(text), sign)
    both = text.contains(",") & text.contains(".")
    comma_last = both & (last(",") > last("."))
    dropped = F.when(comma_last, F.replace(text, F.lit("."), F.lit(""))).when(both, F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return to_double(F.replace(dropped, F.lit(","), F.lit(".")))


def plain_text(html: Column) -> Column:
    """Text of a page: tags become spaces, runs of white space one space."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"(?U)\s+", " ")


def quote_text(html: Column) -> Column:
    """The first number after the quote's label, within a bounded gap without digits; the bare currency is the fallback.

    Fixed values: the two patterns.
    """
    text = plain_text(html)
    labelled = F.regexp_extract(text, r"(?i)USD\s*\(cours\s+moyen\)\s*[^0-9]{0,80}([0-9][0-9\s.,]*)", 1)
    bare = F.regexp_extract(text, r"(?i)\bUSD\b\s*[^0-9]{0,120}([0-9][0-9\s.,]*)", 1)
    found = F.when(labelled != "", labelled).when(bare != "", bare)
    return F.regexp_replace(found, r"\s", "")


def plausible(value: Column) -> Column:
    """value where it lies in the believed range, else null."""
    return F.when(value.between(*PLAUSIBLE), value)


def quote_rate(html: Column) -> Column:
    """Rate of a daily page, null where there is none or it is not plausible."""
    return plausible(quoted_number(quote_text(html)))


def latest_quote(html: Column) -> Column:
    """date and value of the newest quote on the market page; null unless both are there.

    The value stands as "1 USD = X CDF", the day as DD/MM/YYYY after the market's name.  No range is asked for, and a value without
    a point has only its first comma replaced, so that a second one makes it no number.  Fixed values: the two patterns.
    """
    text = plain_text(html)
    day = F.regexp_extract(text, r"(?iu)Marché officiel des changes\s+(\d{2}/\d{2}/\d{4})", 1)
    value = quoted_number(F.regexp_replace(F.regexp_extract(text, r"(?i)1\s*USD\s*=\s*([0-9\s.,]+)\s*CDF", 1), r"[\s\u202f]", ""))
    return F.when((day != "") & value.isNotNull(), F.struct(F.try_to_timestamp(day, F.lit("dd/MM/yyyy")).cast("date").alias("date"), value.alias("value")))


def parsed_date(raw: Column, day_first: bool = False) -> Column:
    """Date of a text, null where it is none.

    The year may come first, with dashes, slashes, dots or nothing between, or last, with day and month by day_first.  English names of months, whole or of
    three letters, may stand before or after the day, with blanks, dashes, dots or commas between.  A time of day may follow.
    """
    trimmed = F.btrim(raw, F.lit(BLANKS))
    words = F.regexp_extract(trimmed, rf"(?i)^({NAMED}){TIME}$", 1)
    spaced = F.initcap(F.lower(F.btrim(F.regexp_replace(words, r"[-/., ]+", " "))))
    named = F.when(spaced != "", F.coalesce(*[F.try_to_date(spaced, f) for f in ("d MMM y", "d MMMM y", "MMM d y", "MMMM d y", "y MMM d", "y MMMM d")]))
    day = F.regexp_extract(trimmed, rf"^(\d{{4}}([-/.])\d{{1,2}}\2\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\3\d{{4}}|\d{{8}}){TIME}$", 1)
    text = F.translate(day, "/.", "--")
    iso, plain, last = (F.try_to_date(text, f) for f in ("y-M-d", "yyyyMMdd", "d-M-y" if day_first else "M-d-y"))
    return F.when(text.rlike(r"^\d{4}-"), iso).when(text.rlike(r"^\d{8}$"), plain).when(text != "", last).otherwise(named)


def rounded(value: Column, digits: int) -> Column:
    """Round half up in binary arithmetic, alike in every engine that follows IEEE 754; infinities and NaN stay."""
    scale = float(10**digits)
    moved = value * scale + 0.5
    return F.when(F.abs(moved) < 2.0**53, F.floor(moved).cast("double")).otherwise(moved) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: infinite by zero, or NaN if a is zero too, where Spark's own division raises."""
    return F.when(b != 0, a / b).otherwise(a * F.pow(b, F.lit(-1.0)))


def business_days_later(day: Column, n: int) -> Column:
    """n weekdays after day; a weekend day counts as the Friday before it."""
    from_monday = F.weekday(day)
    start = F.date_sub(day, F.greatest(from_monday - 4, F.lit(0)))
    monday_based = F.least(from_monday, F.lit(4))
    steps = monday_based + n
    return F.date_add(start, n + 2 * F.floor(steps / 5).cast("int"))
