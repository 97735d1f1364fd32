"""Text columns: trimming, caps, years, defaults for falsy values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Strips all white space, Unicode's and the separators 0x1c to 0x1f."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def cap_text(text: Column, n: int, default: Column) -> Column:
    """The first n characters of the stripped text, or the default if nothing is left (or null)."""
    bare = strip(text)
    return F.when(F.length(bare) > 0, F.substring(bare, 1, n)).otherwise(default)


def detect_year_date(text: Column, default: Column) -> Column:
    """January 1st of the first year 1900 to 2099 that stands alone in the text."""
    year = F.regexp_extract(text, r"(?U)\b(19\d{2}|20\d{2})\b", 1)
    return F.when(F.length(year) > 0, F.concat(year, F.lit("-01-01"))).otherwise(default)


def or_default(value: Column, default: str) -> Column:
    """Null and empty texts get the default."""
    return F.when(value.isNull() | (value == ""), F.lit(default)).otherwise(value)


def number_or_default(value: Column, default: float) -> Column:
    """Null and 0.0 get the default."""
    return F.when(value.isNull() | (value == 0.0), F.lit(default)).otherwise(value)
