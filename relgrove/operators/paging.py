"""Keyset pages: the rows after a cursor, in the order of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgrove.functions.userset import wildcard_first


def page(df: DataFrame, column: str, limit: int | None = None, after: str | None = None, wildcard_leads: bool = False) -> DataFrame:
    """(``column``, next_cursor): up to ``limit`` distinct ids after ``after``, in order.

    next_cursor is the page's last id if more follow, else null, and is repeated
    on each row. A cursor is a value: it may name an id that is there no more.
    No limit, or one of 0 or less, means all rows.
    """
    key = (lambda c: wildcard_first(c)) if wildcard_leads else (lambda c: c)
    ids = df.select(column).distinct()
    if after is not None:
        ids = ids.where(key(F.col(column)) > key(F.lit(after)))
    order: list[Column] = [key(F.col(column))]
    if limit is None or limit <= 0:
        return ids.orderBy(*order).withColumn("next_cursor", F.lit(None).cast("string"))
    # limit + 1 rows at most come together
    first = ids.orderBy(*order).limit(limit + 1).agg(F.sort_array(F.collect_list(key(F.col(column)))).alias("a"))
    value = (lambda c: c["id"]) if wildcard_leads else (lambda c: c)
    more = F.when(F.size("a") > limit, value(F.element_at("a", limit)))
    return first.select(F.explode(F.slice("a", 1, limit)).alias("k"), more.alias("next_cursor")).select(value(F.col("k")).alias(column), "next_cursor").orderBy(key(F.col(column)))
