"""Ordinary least squares for every series at once, from sufficient statistics.

One aggregate gives the variances and covariances of the inputs and the
target per series (a fixed number of sums, whatever the number of days).  The
normal equations in standardised form are then solved in a row expression, by
eliminating one input after the other.  An input that is constant in a series,
or a combination of earlier ones, gets the coefficient 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of an input's variance that the inputs before it must leave unexplained.
TOLERANCE = 1e-9


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _eliminated(matrix: Column, n: int) -> Column:
    """Gauss-Jordan elimination of ``n`` rows of ``n + 1`` numbers; the
    matrix is a correlation matrix, so its pivots are on the diagonal."""
    zero = F.lit(0.0)

    def step(m: Column, k: Column) -> Column:
        def with_pivot(d: Column) -> Column:
            gone = F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when((i == k) | (j == k), zero).otherwise(v)))

            def by_row(p: Column) -> Column:
                return F.transform(m, lambda row, i: F.when(i == k, p).otherwise(
                    F.zip_with(row, p, lambda a, b: a - F.get(row, k) * b)))
            solved = _let(F.transform(F.get(m, k), lambda v: v / d), by_row)
            return F.when(d > TOLERANCE, solved).otherwise(gone)
        return _let(F.get(F.get(m, k), k), with_pivot)
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, step)


def fit(table: DataFrame, keys: list[str], inputs: list[str], target: str) -> DataFrame:
    """One row per group: ``n_rows``, ``intercept`` and ``coefficients`` (array,
    in the order of ``inputs``)."""
    n = len(inputs)
    of = [*inputs, target]
    sums = [F.count(F.lit(1)).alias("n_rows")]
    sums += [F.avg(c).alias(f"m{i}") for i, c in enumerate(of)]
    sums += [F.covar_pop(of[i], of[j]).alias(f"c{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]
    stats = table.groupBy(*keys).agg(*sums)

    def spread(i: int) -> Column:
        # a sum of squares below the rounding of its mean is none
        v = F.col(f"c{i}_{i}")
        return F.when(v > 1e-24 * (1 + F.col(f"m{i}") ** 2), F.sqrt(v))

    scaled = stats.select(*keys, "n_rows", *[f"m{i}" for i in range(n + 1)], *[spread(i).alias(f"s{i}") for i in range(n + 1)],
                          *[f"c{i}_{j}" for i in range(n + 1) for j in range(i, n + 1)])

    def cell(i: int, j: int) -> Column:
        a, b = min(i, j), max(i, j)
        return F.coalesce(F.col(f"c{a}_{b}") / F.col(f"s{a}") / F.col(f"s{b}"), F.lit(0.0))
    matrix = F.array(*[F.array(*[cell(i, j) for j in range(n + 1)]) for i in range(n)])
    solved = scaled.select("*", _eliminated(matrix, n).alias("m"))
    slopes = F.array(*[F.coalesce(F.get(F.get("m", F.lit(i)), F.lit(n)) * F.col(f"s{n}") / F.col(f"s{i}"), F.lit(0.0)) for i in range(n)])
    means = F.array(*[f"m{i}" for i in range(n)])
    level = lambda b: F.aggregate(F.zip_with(b, F.col("means"), lambda x, m: x * m), F.col(f"m{n}"), lambda s, x: s - x)
    return (solved.select(*keys, "n_rows", f"m{n}", slopes.alias("coefficients"), means.alias("means"))
            .select(*keys, "n_rows", level(F.col("coefficients")).alias("intercept"), "coefficients"))


def predict(coefficients: Column, intercept: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(coefficients, x, lambda a, b: a * b), intercept, lambda s, v: s + v)
