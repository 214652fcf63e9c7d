"""Data profile: column info and descriptive statistics.

Exact quartiles come from a mergeable rank sketch and shrinking brackets.  The
numeric columns are written once, to a folder of the computation's own.  One
aggregate over them takes the moments and, per wanted rank, the sketch's values
next to it: a bracket of a few thousandths of the values, cut in the middle.
A second counts the pieces and so finds the one that holds the rank, whatever
the sketch's error.  Only the values of these pieces are written on, and each
further pass reads the remainder of the one before; a rank is found when its
piece is one value, or has no more than a few thousand, which are sorted.
Each pass leaves some thousandths, so even 10**12 values take four.
``approx=True`` uses ``percentile_approx`` in one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

#: Accuracy of the sketch: ranks are off by about one in so many.
GRID = 1000


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def columns_profile(df: DataFrame) -> DataFrame:
    """column, type, non-null count (one pass, one row per column)."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("type"),
                              F.col(f"c{i}").alias("non_null"))
                     for i, f in enumerate(fields)])
    return counts.select(F.inline(rows))


def _is_time(dt) -> bool:
    return isinstance(dt, (T.TimestampNTZType, T.TimestampType, T.DateType))


def _as_number(c: str, dt):
    col = F.col(f"`{c}`")
    if _is_time(dt):
        return F.timestamp_diff("MICROSECOND", _epoch(), col.cast("timestamp_ntz")).cast("double")
    return col.cast("double")


class _Rank:
    """A wanted rank: the value of that many smaller ones in a column, known to
    lie in [lo, hi], with ``before`` values of the column below lo and ``n`` in it."""

    def __init__(self, column: int, rank: int, lo: float, hi: float, n: int):
        self.column, self.rank, self.lo, self.hi, self.before, self.n = column, rank, lo, hi, 0, n
        self.value = lo if lo == hi else None

    def cuts(self, points) -> None:
        """Take three values of a sketch as the next cut points, inside [lo, hi]."""
        self.low, self.mid, self.high = (min(max(p, self.lo), self.hi) for p in points)

    def share(self, grid: int) -> list[float]:
        at, near = (self.rank - self.before + 0.5) / self.n, 2.0 / grid
        return [max(at - near, 0.0), at, min(at + near, 1.0)]

    def counts(self, v) -> list:
        """How many values of [lo, hi] are under, between, on and over the cut points."""
        inside = (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))
        low, mid, high = F.lit(self.low), F.lit(self.mid), F.lit(self.high)
        return [F.count_if(inside & x) for x in (v < low, (v >= low) & (v < mid), v == mid, (v > mid) & (v <= high), v > high)]

    def narrow(self, found: list[int]) -> None:
        """Go to the piece that holds the rank."""
        down, up = math.nextafter, math.inf
        bounds = [(self.lo, down(self.low, -up)), (self.low, down(self.mid, -up)), (self.mid, self.mid),
                  (down(self.mid, up), self.high), (down(self.high, up), self.hi)]
        for (lo, hi), n in zip(bounds, found):
            if self.rank < self.before + n:
                self.lo, self.hi, self.n = lo, hi, n
                if lo == hi:
                    self.value = lo
                return
            self.before += n


def _column(n: int):
    return F.col(f"n{n}")


def wide_quantiles(wide: DataFrame, n_columns: int, probs, grid: int = GRID) -> tuple[dict, dict]:
    """Exact quantiles and moments of the double columns ``n0``, ``n1``, .. of a
    table that is cheap to read again (a stored one): ``({column: [quantile]},
    {column: moments})``; columns without values are missing in both."""
    spark = wide.sparkSession
    value = [F.when(~F.isnan(_column(i)), _column(i)) for i in range(n_columns)]

    def around(q):
        return max(q - 2 / grid, 0.0), q, min(q + 2 / grid, 1.0)
    points = sorted({x for q in probs for x in around(q)})
    first = wide.agg(*[e for i, v in enumerate(value) for e in (
        F.count(v).alias(f"cnt{i}"), F.avg(v).alias(f"avg{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
        F.max(v).alias(f"max{i}"),
        F.percentile_approx(v, points, grid).alias(f"q{i}"))]).first()
    moments, ranks = {}, []
    for i in range(n_columns):
        n = first[f"cnt{i}"]
        if not n:
            continue
        moments[i] = {m: first[f"{m}{i}"] for m in ("cnt", "avg", "std", "min", "max")}
        near = dict(zip(points, first[f"q{i}"]))
        for q in probs:
            for rank in {f(q * (n - 1)) for f in (math.floor, math.ceil)}:
                r = _Rank(i, rank, first[f"min{i}"], first[f"max{i}"], n)
                r.cuts([near[x] for x in around(q)])
                ranks.append(r)
    open_ = [r for r in ranks if r.value is None]
    with scratch_dir(spark) as folder:
        if open_:
            row = wide.agg(*[c.alias(f"c{j}_{k}") for j, r in enumerate(open_)
                             for k, c in enumerate(r.counts(value[r.column]))]).first()
            for j, r in enumerate(open_):
                r.narrow([row[f"c{j}_{k}"] for k in range(5)])
        rest, level = None, 0
        open_ = [r for r in open_ if r.value is None]
        while open_:
            # the values of the open brackets only, from the table before
            if rest is None:
                pairs = F.array(*[F.when((value[r.column] >= F.lit(r.lo)) & (value[r.column] <= F.lit(r.hi)), F.struct(
                    F.lit(j).alias("j"), value[r.column].alias("v"))) for j, r in enumerate(open_)])
                part = wide.select(F.inline(F.filter(pairs, lambda x: x.isNotNull())))
            else:
                pairs = F.array(*[F.when((F.col("j") == was) & (F.col("v") >= F.lit(r.lo)) & (F.col("v") <= F.lit(r.hi)), F.struct(
                    F.lit(j).alias("j"), F.col("v").alias("v"))) for j, (was, r) in enumerate(zip(places, open_))])
                part = rest.select(F.inline(F.filter(pairs, lambda x: x.isNotNull())))
            part.write.parquet(f"{folder}/{level}")
            rest, level = spark.read.schema("j int, v double").parquet(f"{folder}/{level}"), level + 1
            few = [j for j, r in enumerate(open_) if r.n <= 4 * grid]
            if few:                                     # at most 4 * grid values each
                for row in rest.where(F.col("j").isin(few)).groupBy("j").agg(F.sort_array(F.collect_list("v")).alias("vs")).collect():
                    r = open_[row["j"]]
                    r.value = row["vs"][r.rank - r.before]
            many = [j for j, r in enumerate(open_) if r.value is None]
            if many:
                sketch = [F.percentile_approx(F.when(F.col("j") == j, F.col("v")), open_[j].share(grid), grid).alias(f"q{j}") for j in many]
                row = rest.where(F.col("j").isin(many)).agg(*sketch).first()
                for j in many:
                    open_[j].cuts(row[f"q{j}"])
                row = rest.agg(*[c.alias(f"c{j}_{k}") for j in many
                                 for k, c in enumerate(open_[j].counts(F.when(F.col("j") == j, F.col("v"))))]).first()
                for j in many:
                    open_[j].narrow([row[f"c{j}_{k}"] for k in range(5)])
            places = [j for j, r in enumerate(open_) if r.value is None]
            open_ = [open_[j] for j in places]
    at = {(r.column, r.rank): r.value for r in ranks}
    out = {}
    for i, m in moments.items():
        out[i] = []
        for q in probs:
            pos = q * (m["cnt"] - 1)
            a, b = at[(i, math.floor(pos))], at[(i, math.ceil(pos))]
            out[i].append(a if a == b else a + (b - a) * (pos - math.floor(pos)))
    return out, moments


def grouped_quantiles(values: DataFrame, probs, grid: int = GRID, moments: dict | None = None) -> dict:
    """Exact linear-interpolated quantiles of ``v`` for every key ``k`` of a
    long table ``(k int, v double)`` with few keys.

    Same definition as NumPy / pandas ``quantile`` (position ``q * (n-1)``),
    nulls and NaN ignored.  Returns ``{k: [quantile per prob]}``; a ``moments``
    dict is filled with ``{k: {cnt, avg, std, min, max}}`` of the values.
    """
    with scratch_dir(values.sparkSession) as folder:
        values.write.parquet(folder)
        stored = values.sparkSession.read.parquet(folder)
        keys = [r["k"] for r in stored.select("k").distinct().collect()]
        wide = stored.select(*[F.when(F.col("k") == k, F.col("v").cast("double")).alias(f"n{i}") for i, k in enumerate(keys)])
        got, found = wide_quantiles(wide, len(keys), probs, grid) if keys else ({}, {})
    if moments is not None:
        moments.update({keys[i]: m for i, m in found.items()})
    return {keys[i]: qs for i, qs in got.items()}


def exact_quantiles(values: DataFrame, probs, **kw) -> list:
    """Quantiles of column ``v`` of ``values`` (see :func:`grouped_quantiles`)."""
    res = grouped_quantiles(values.select(F.lit(0).alias("k"), F.col("v")), probs, **kw)
    return res.get(0, [None for _ in probs])


def describe(df: DataFrame, approx: bool = False, accuracy: int = 1_000_000,
             decimals: int | None = 2) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max of numeric and date/time
    columns, long form: ``column, statistic, value, value_time``.

    Time columns report their statistics in ``value_time`` (std is null),
    numeric ones in ``value`` (rounded to ``decimals``).
    """
    spark = df.sparkSession
    fields = [f for f in df.schema.fields
              if isinstance(f.dataType, T.NumericType) or _is_time(f.dataType)]
    if not fields:
        raise ValueError("no numeric or date/time column to describe")
    nums = df.select(*[_as_number(f.name, f.dataType).alias(f"n{i}") for i, f in enumerate(fields)])
    probs = [0.25, 0.5, 0.75]
    quart, moments = {}, {}
    if approx:
        row = nums.agg(*[e for i in range(len(fields)) for e in (
            F.count(f"n{i}").alias(f"cnt{i}"), F.avg(f"n{i}").alias(f"avg{i}"),
            F.stddev_samp(f"n{i}").alias(f"std{i}"), F.min(f"n{i}").alias(f"min{i}"),
            F.max(f"n{i}").alias(f"max{i}"),
            F.percentile_approx(f"n{i}", probs, accuracy).alias(f"q{i}"))]).first()
        for i in range(len(fields)):
            moments[i] = {m: row[f"{m}{i}"] for m in ("cnt", "avg", "std", "min", "max")}
            quart[i] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * 3
    else:
        # the numeric columns are computed and written once; all passes read them
        with scratch_dir(spark) as folder:
            nums.write.parquet(folder)
            got, moments = wide_quantiles(spark.read.schema(nums.schema).parquet(folder), len(fields), probs)
        for i in range(len(fields)):
            quart[i] = got.get(i, [None] * 3)
    empty = {"cnt": 0, "avg": None, "std": None, "min": None, "max": None}
    rows = []
    for i, f in enumerate(fields):
        is_time = _is_time(f.dataType)
        m = moments.get(i, empty)
        stats = [m["cnt"], m["avg"], None if is_time else m["std"], m["min"], *quart[i], m["max"]]
        for k, (name, val) in enumerate(zip(STATS, stats)):
            rows.append((i, f.name, k, name, None if val is None else float(val),
                         is_time and name != "count"))
    schema = "position int, column string, stat_pos int, statistic string, raw double, is_time boolean"
    small = spark.createDataFrame(rows, schema)
    raw = F.col("raw")
    value = F.when(~F.col("is_time"), F.round(raw, decimals) if decimals is not None else raw)
    value_time = F.when(F.col("is_time") & raw.isNotNull(),
                        F.timestamp_add("MICROSECOND", F.round(raw).cast("bigint"), _epoch()))
    return small.select("position", "column", "stat_pos", "statistic",
                        value.alias("value"), value_time.alias("value_time"))
