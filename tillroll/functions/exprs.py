"""Column expressions shared by the operators.

Everything here returns a built-in Spark ``Column`` (JVM side, inside
whole-stage codegen); there is no Python UDF anywhere in the package.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: optional sign, decimal or exponent form, or
# the special words inf / infinity / nan.  Java-style suffixes ("1.0f",
# "1d") and thousands separators ("1,234") are rejected even though a
# plain cast would take the former.
NUMERIC_TEXT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"

# Timestamp formats tried, in order, after the ISO forms that a plain cast
# to TIMESTAMP_NTZ accepts (date, date time, 'T' separator, fractions).
# Month-first like the usual default of spreadsheet exports.
DEFAULT_DATE_FORMATS = (
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
    "d.M.yyyy H:mm",
    "d.M.yyyy",
)


# White space that may stand around a number or date (as text readers strip it).
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def stripped(c) -> Column:
    """Text without white space at both ends."""
    col = F.col(c) if isinstance(c, str) else c
    return F.btrim(col.cast("string"), F.lit(BLANKS))


def to_number(c, data_type: T.DataType | None = None) -> Column:
    """Text or numeric column to DOUBLE; anything not a number -> null."""
    col = F.col(c) if isinstance(c, str) else c
    if data_type is not None and isinstance(data_type, T.NumericType):
        return col.cast("double")
    s = stripped(col)
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def to_timestamp_ntz(c, formats=DEFAULT_DATE_FORMATS, data_type: T.DataType | None = None) -> Column:
    """Text, date or timestamp column to TIMESTAMP_NTZ; unparseable -> null.

    ISO text goes through ``try_cast``.  Other formats are tried in order and
    read as wall-clock time: the text is parsed with an explicit zero offset
    and the instant's distance from the epoch is added to the epoch's wall
    clock, so the session's time zone (and its daylight saving) plays no part.
    """
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(data_type, (T.TimestampNTZType,)):
        return col
    if isinstance(data_type, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    s = stripped(col)
    parts = [s.try_cast("timestamp_ntz")]
    for fmt in formats or ():
        instant = F.try_to_timestamp(F.concat(s, F.lit(" Z")), F.lit(fmt + " X"))
        parsed = F.timestamp_add("MICROSECOND", F.unix_micros(instant),
                                 F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        seps = _literal_chars(fmt)
        if seps:
            # A format's literal characters must all occur in the text for it
            # to match; checking that first skips the failing parse (which
            # throws and catches inside the JVM) for text of another shape.
            guard = F.lit(True)
            for ch in seps:
                guard = guard & s.contains(ch)
            parsed = F.when(guard, parsed)
        parts.append(parsed)
    return F.coalesce(*parts)


def _literal_chars(fmt: str) -> list[str]:
    """Distinct literal (non-letter) characters of a datetime pattern, or
    none when the pattern has quoted text or optional sections."""
    if any(c in fmt for c in "'[]{}#"):
        return []
    return sorted({c for c in fmt if not c.isalpha()})


def positive(c) -> Column:
    """``c > 0`` where NaN and null both fail (Spark orders NaN above all)."""
    col = F.col(c) if isinstance(c, str) else c
    return (col > 0) & ~F.isnan(col)


def week_end_sunday(d) -> Column:
    """Label of the Monday..Sunday week holding ``d``: its Sunday (DATE)."""
    col = F.col(d) if isinstance(d, str) else d
    return F.date_add(F.date_trunc("week", col).cast("date"), 6)


def month_end(d) -> Column:
    col = F.col(d) if isinstance(d, str) else d
    return F.last_day(col)


def weekday_name(d) -> Column:
    col = F.col(d) if isinstance(d, str) else d
    return F.date_format(col, "EEEE")


# fixed values: weekday names in the order of ``weekday()`` (Monday = 0)
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_label(idx) -> Column:
    """Name of weekday number ``idx`` (Monday = 0), the same text as
    ``weekday_name``.  Grouping on ``weekday()`` and naming the (at most
    seven) groups afterwards avoids formatting a string for every row."""
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), col + 1)


def weekday_monday0(d) -> Column:
    """Monday = 0 .. Sunday = 6."""
    col = F.col(d) if isinstance(d, str) else d
    return F.weekday(col)


def whole_days_between(start, end) -> Column:
    """Floor of the elapsed time in days (26 h -> 1), not midnights crossed."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    micros = F.timestamp_diff("MICROSECOND", s, e)
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def money(c, digits: int = 2, symbol: str = "£") -> Column:
    """Currency text with thousands separators, half-even like Python."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(symbol), F.format_number(col, digits))


def plain_money(c, digits: int = 2, symbol: str = "£") -> Column:
    """Currency text without thousands separators."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit(symbol), F.replace(F.format_number(col, digits), F.lit(","), F.lit("")))


def signed_percent(c, digits: int = 1) -> Column:
    """``c`` with its sign and a percent sign: ``+4.2%``, ``-0.5%``."""
    col = F.col(c) if isinstance(c, str) else c
    text = F.format_number(col, digits)
    return F.concat(F.when(text.startswith("-"), F.lit("")).otherwise(F.lit("+")), text, F.lit("%"))


def percent(c, digits: int = 1, scale: float = 1.0) -> Column:
    """``c * scale`` as text with a percent sign (``scale=100`` for fractions)."""
    col = F.col(c) if isinstance(c, str) else c
    v = col * F.lit(scale) if scale != 1.0 else col
    return F.concat(F.format_number(v, digits), F.lit("%"))


def cut(c, n: int, ellipsis: str = "...", always: bool = False) -> Column:
    """First ``n`` characters; append the ellipsis when longer (or always)."""
    col = F.col(c) if isinstance(c, str) else c
    head = F.substring(col, 1, n)
    if always:
        return F.concat(head, F.lit(ellipsis))
    return F.when(F.length(col) > n, F.concat(head, F.lit(ellipsis))).otherwise(head)


def first_words(c, n: int = 3) -> Column:
    """First ``n`` whitespace-separated words, joined by one space."""
    col = F.col(c) if isinstance(c, str) else c
    words = F.filter(F.split(F.trim(col), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.slice(words, 1, n), " ")


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Number of ``bounds`` (sorted ascending) that are ``<= value``.

    Emitted as a balanced tree of CASE expressions: log2(len) comparisons
    per row, fully code-generated, and a pure function of ``value`` so a
    retried task always puts a row in the same bucket.
    """
    def build(lo: int, hi: int) -> Column:
        # answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2          # is bounds[mid-1] <= value ?
        return F.when(value >= F.lit(float(bounds[mid - 1])), build(mid, hi)).otherwise(build(lo, mid - 1))
    return build(0, len(bounds))
