"""Cleaning: rename + project, type coercion, derived value, row filter.

One narrow stage (no shuffle): Catalyst fuses the projection and the filter
into the scan's codegen span.  For typed Parquet input the casts are
no-ops and filters on the source columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import positive, to_number, to_timestamp_ntz
from ..sources import dates
from ..sources.schema import resolve_mapping


class EmptyResultError(ValueError):
    """The clean table has no rows (the load is refused)."""


def _order_date(raw: DataFrame, source: str, formats, data_type):
    """The date expression: a pinned layout, pinned patterns, or the elected layout."""
    src = F.col(f"`{source}`")
    if not isinstance(data_type, T.StringType):
        return to_timestamp_ntz(src, (), data_type)
    if formats is None:
        formats = dates.elect(raw, source)
    if isinstance(formats, (dates.Layout, dates.Layouts)):
        return dates.read(src, formats)
    return to_timestamp_ntz(src, formats, data_type)


def clean(raw: DataFrame, mapping: dict | None = None, formats=None,
          require_rows: bool = False) -> DataFrame:
    """Raw sales table -> clean sales table.

    * columns are mapped to targets (auto-detected, ``mapping`` overrides);
      unmapped columns are dropped; order is required targets, optional
      targets, then ``total_value``;
    * ``quantity`` / ``unit_price``: numeric text only, else null;
    * ``total_value = quantity * unit_price``;
    * ``order_date``: text in the column's own layouts, else null.  Without
      ``formats`` they are elected (:mod:`tillroll.sources.dates`), which is
      one aggregate over that column when the plan is built; a
      :class:`~tillroll.sources.dates.Layout` or ``Layouts`` pins them, a list
      of patterns reads ISO text or one of them, value by value;
    * rows kept: ``quantity > 0 AND unit_price > 0 AND order_date IS NOT NULL``
      (NaN fails).  ``product_name`` may stay null.

    ``require_rows=True`` runs a short job (stops at the first row) and raises
    :class:`EmptyResultError` on an empty result.
    """
    m = resolve_mapping(raw.columns, mapping)
    types = {f.name: f.dataType for f in raw.schema.fields}
    parsed, plain = [], []
    parses = False
    for target, source in m.items():
        src = F.col(f"`{source}`")
        if target == "quantity" or target == "unit_price":
            parsed.append(to_number(src, types[source]).alias(target))
            parses = parses or isinstance(types[source], T.StringType)
        elif target == "order_date":
            parsed.append(_order_date(raw, source, formats, types[source]).alias(target))
            parses = parses or isinstance(types[source], T.StringType)
        else:
            plain.append(src.cast("string").alias(target))
    if parses:
        # Text input: parse every value once.  The one-element inline holds
        # just the three parsed columns, which the filter needs in any case;
        # Catalyst does not push the filter below a generator, so the regex
        # and date parsing are not repeated in it, while the other columns
        # stay ordinary ones and are pruned from the scan when unused.
        typed = raw.select(*plain, F.inline(F.array(F.struct(*parsed)))).select(*m)
    else:
        # Typed input: plain projection, so the filter can reach the scan.
        typed = raw.select(*parsed, *plain).select(*m)
    out = (typed.withColumn("total_value", F.col("quantity") * F.col("unit_price"))
           .filter(positive("quantity") & positive("unit_price") & F.col("order_date").isNotNull()))
    if require_rows and out.isEmpty():
        raise EmptyResultError("no rows left after cleaning")
    return out


def ensure_not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyResultError("no rows left after cleaning")
    return df


def preview(df: DataFrame, n: int = 20, order_by=None) -> DataFrame:
    """First ``n`` rows in a stable order (files carry no row order in Spark).

    A top-k (``TakeOrderedAndProject``): each task keeps ``n`` rows.
    """
    keys = order_by or df.columns
    return df.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(n)
