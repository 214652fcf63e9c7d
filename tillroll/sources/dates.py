"""Date layouts of a text column, elected by the column's own values.

``02/03/2024`` is 2 March or 3 February, and one value cannot tell.  A column
can: every candidate layout (order of day, month and year, sign between them,
month as number or name, two or four digits of year) is counted over all
values in one aggregate.  Layouts of one family, alike but for the order of
day and month, exclude each other: the one that reads more values of the
column reads all of its family.  The family that reads most is the column's
layout; values that it cannot read may be of another family that was elected
(stray ISO dates in a day-first column), and all others are null.

A tie within a family goes to the order that reads more in the whole column;
if that is a tie as well, it is reported and goes to the earlier candidate
(month first, but day first between dots).

A time of day may follow the date in any layout, with or without seconds,
fractions and AM/PM.  ISO text (``2024-02-13``, ``2024-02-13T08:26:00``) is a
layout of its own and is read by a plain cast.

Everything is built-in expressions; the driver receives one row of counts per
candidate.  :func:`elect` gives a :class:`Layouts` value that can be kept and
pinned for later loads or for a stream.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import stripped

# fixed values: English month names; their first three letters are the short names
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]
#: Two-digit years from here on are of the last century.
PIVOT = 69
_MARK = "\x01"
# a, sign, b, sign, c, then an optional time: hour, minute, second, AM or PM
_DATE = (r"^(\d{1,4}|[A-Za-z]{3,9})([-/. ]|, )(\d{1,2}|[A-Za-z]{3,9})([-/. ]|, ?)(\d{1,2}|\d{4})"
         r"(?:(?:T|,? +)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?(?: ?([AaPp][Mm]))?)?$")
_PIECES = 9


@dataclass(frozen=True)
class Layout:
    """Order of the parts (``ymd``, ``mdy``, ``dmy``), the sign between them
    (any for a named month), month by name, year in two digits."""
    order: str
    sign: str
    named: bool = False
    short: bool = False

    @property
    def name(self) -> str:
        part = {"y": "yy" if self.short else "yyyy", "m": "MMM" if self.named else "MM", "d": "dd"}
        return self.sign.join(part[p] for p in self.order)

    @property
    def iso(self) -> bool:
        return self == ISO

    @property
    def family(self) -> str:
        """Equal for layouts that differ in the order of day and month only."""
        return f"{self.order.index('y')}{self.sign}{self.named}{self.short}"


ISO = Layout("ymd", "-")


@dataclass(frozen=True)
class Layouts:
    """Layouts that read a column, the most frequent first."""
    order: tuple[Layout, ...]

    @property
    def column(self) -> Layout:
        return self.order[0]


def candidates() -> list[Layout]:
    """All layouts, in the order in which ties are decided."""
    out = [ISO] + [Layout("ymd", s) for s in ("/", ".", " ", "")]
    for short in (False, True):
        for sign in ("/", "-", " ", "."):
            orders = ("dmy", "mdy") if sign == "." else ("mdy", "dmy")
            out += [Layout(o, sign, short=short) for o in orders]
    out += [Layout("ymd", " ", named=True)]
    out += [Layout(o, " ", named=True, short=short) for short in (False, True) for o in ("mdy", "dmy")]
    return out


def pieces(text: Column) -> Column:
    """A date's parts as an array, from a single match; null for other text."""
    parts = F.split(F.regexp_replace(text, _DATE, _MARK + "".join(f"|${k + 1}" for k in range(_PIECES))), r"\|")
    return F.when(text.startswith(_MARK), None).otherwise(F.when(F.get(parts, F.lit(0)) == _MARK, parts))


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def _month(text: Column) -> Column:
    low = F.lower(text)
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(low, 1, 3)).cast("int")
    full = F.get(F.array(*[F.lit(m) for m in MONTHS]), short - 1)
    return F.when((short > 0) & ((low == full) | (F.length(low) == 3) | (low == "sept")), short)


def _from_pieces(x: Column, layout: Layout) -> Column:
    """TIMESTAMP_NTZ of the parts, null where they do not fit ``layout``."""
    at = {p: F.get(x, F.lit(2 * k + 1)) for k, p in enumerate(layout.order)}
    one, two = F.get(x, F.lit(2)), F.get(x, F.lit(4))
    long_ = F.length(at["y"]) == (2 if layout.short else 4)
    if layout.named:
        fits = long_ & at["m"].rlike("^[A-Za-z]") & (F.length(at["d"]) <= 2)
        month = _month(at["m"])
    else:
        fits = long_ & (one == layout.sign) & (two == layout.sign) & (F.length(at["m"]) <= 2) & (F.length(at["d"]) <= 2)
        month = _whole(at["m"])
    year = _whole(at["y"])
    if layout.short:
        year = year + F.when(year >= PIVOT, 1900).otherwise(2000)
    hour, half = F.get(x, F.lit(6)), F.lower(F.get(x, F.lit(9)))
    clock = (F.when(hour == "", 0).when(half == "", _whole(hour))
             .when(_whole(hour).between(1, 12), _whole(hour) % 12 + F.when(half == "pm", 12).otherwise(0)))
    minute = F.when(F.get(x, F.lit(7)) == "", 0).otherwise(_whole(F.get(x, F.lit(7))))
    second = F.when(F.get(x, F.lit(8)) == "", F.lit(0)).otherwise(F.get(x, F.lit(8)).try_cast("decimal(16,6)"))
    made = F.try_make_timestamp_ntz(year, month, _whole(at["d"]), clock, minute, F.when(second < 60, second))
    return F.when(fits, made)


def _compact(text: Column) -> Column:
    part = lambda a, n: _whole(F.substring(text, a, n))                                 # noqa: E731
    zero = F.lit(0)
    return F.when(text.rlike(r"^\d{8}$"), F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), zero, zero, zero))


def read(c, layouts: Layout | Layouts) -> Column:
    """Text to TIMESTAMP_NTZ by one layout, or by the first of several that
    reads a value; anything else -> null."""
    s = stripped(c)
    every = (layouts,) if isinstance(layouts, Layout) else layouts.order
    other = [a for a in every if a.sign and not a.iso]
    # a one-element transform: the match is made once per value, and only if a cast does not read it
    matched = (F.get(F.transform(F.array(pieces(s)), lambda x: F.coalesce(*[_from_pieces(x, a) for a in other])), F.lit(0))
               if other else None)
    parts = [s.try_cast("timestamp_ntz")] if ISO in every else []
    parts += [_compact(s)] if any(not a.sign for a in every) else []
    parts += [matched] if matched is not None else []
    return F.coalesce(*parts)


def count_layouts(df: DataFrame, column: str) -> DataFrame:
    """One row per candidate: ``position``, ``layout``, ``parsed`` (values it
    reads), ``filled`` (values that are not blank), ``use`` (1 for the
    column's layout, 2, .. for other elected families, else null) and ``tied``
    (nothing tells its order of day and month).  One aggregate, lazily."""
    every = candidates()
    s = stripped(F.col(f"`{column}`"))
    # the generator keeps the parts as one computed column
    text = df.select(F.inline(F.array(F.struct(s.alias("s"), pieces(s).alias("x")))))
    reads = [F.col("s").try_cast("timestamp_ntz") if a.iso else _compact(F.col("s")) if not a.sign
             else _from_pieces(F.col("x"), a) for a in every]
    row = text.agg(F.count_if(F.col("s") != "").alias("filled"), *[F.count(r).alias(f"n{k}") for k, r in enumerate(reads)])
    totals = {o: sum((F.col(f"n{k}") for k, a in enumerate(every) if a.order == o and not a.named), F.lit(0)) for o in ("ymd", "mdy", "dmy")}
    rows = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(a.name).alias("layout"), F.lit(a.family).alias("family"),
                              F.col(f"n{k}").alias("parsed"), totals[a.order].alias("total")) for k, a in enumerate(every)])
    row = row.select("filled", rows.alias("t"))

    def ahead(y, x):
        more, level = y["parsed"] > x["parsed"], y["parsed"] == x["parsed"]
        return more | (level & ((y["total"] > x["total"]) | ((y["total"] == x["total"]) & (y["position"] < x["position"]))))
    won = F.filter("t", lambda x: (x["parsed"] > 0) & ~F.exists("t", lambda y: (y["family"] == x["family"]) & ahead(y, x)))
    row = row.select("filled", "t", won.alias("won"))
    level = lambda x, y: ((y["family"] == x["family"]) & (y["position"] != x["position"]) & (y["parsed"] == x["parsed"])
                          & (y["total"] == x["total"]))
    out = F.transform("t", lambda x: F.struct(
        x["position"].alias("position"), x["layout"].alias("layout"), x["parsed"].alias("parsed"),
        F.when(F.exists("won", lambda y: y["position"] == x["position"]),
               F.size(F.filter("won", lambda y: (y["parsed"] > x["parsed"]) | ((y["parsed"] == x["parsed"])
                                                                                & (y["position"] < x["position"])))) + 1).alias("use"),
        ((x["parsed"] > 0) & F.exists("t", lambda y: level(x, y))).alias("tied")))
    return row.select("filled", F.inline(out)).select("position", "layout", "parsed", "filled", "use", "tied")


def elect(df: DataFrame, column: str) -> Layouts:
    """The layouts of a text column (ISO if none reads any value); warns where
    nothing tells days from months."""
    rows = count_layouts(df, column).where("use IS NOT NULL OR tied").collect()
    used = sorted((r for r in rows if r["use"]), key=lambda r: r["use"])
    if not used:
        return Layouts((ISO,))
    for r in used:
        if r["tied"]:
            warnings.warn(f"dates in {column!r} are ambiguous: read as {r['layout']}, but another order of day and month "
                          "reads as many; pin the format if that is wrong", stacklevel=2)
    every = candidates()
    return Layouts(tuple(every[r["position"]] for r in used))
