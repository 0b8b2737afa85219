"""Running values over rows in order, where one key may hold most rows: by ranges of the order, never a key in one task.

Rows of a key are cut into ranges of a number that orders them. What a range holds is aggregated; a window over these few
rows gives each range what comes before it; and windows inside ranges do the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the ordering number to a range.
SIZE = 1 << 16


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, size: int = SIZE) -> DataFrame:
    """Adds, for each row, the sums of ``sums`` up to and including it, and the last values of ``lasts`` that aren't null before it.

    ``order`` is a whole number that no two rows of a key share; a null key is one like others.
    """
    sums, lasts, columns = sums or {}, lasts or {}, rows.columns
    named = {f"_{k}": c for k, c in (sums | lasts).items()}
    # one column of keys and range: structs with nulls are equal, so the join and the windows below deal the rows only once
    place = F.struct(*keys, F.floor(F.col(order) / size).alias("_range"))
    rows = rows.withColumns({**named, "_place": place}).drop(*keys)
    held = lambda k: F.max(F.when(F.col(f"_{k}").isNotNull(), F.struct(F.col(order).alias("o"), F.col(f"_{k}").alias("v"))))
    totals = rows.groupBy("_place").agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in sums], *[held(k).alias(f"_t_{k}") for k in lasts])
    before = Window.partitionBy(*[F.col("_place")[k] for k in keys]).orderBy(F.col("_place._range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_place", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums], *[F.max(f"_t_{k}").over(before).alias(f"_b_{k}") for k in lasts])
    inside = Window.partitionBy("_place").orderBy(order)
    until = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    added = {k: F.col(f"_b_{k}") + F.coalesce(F.sum(f"_{k}").over(until), F.lit(0)) for k in sums}
    added |= {k: F.coalesce(F.last(f"_{k}", ignorenulls=True).over(earlier), F.col(f"_b_{k}")["v"]) for k in lasts}
    out = rows.join(offsets, "_place").withColumns(added)
    return out.select(*[F.col("_place")[c].alias(c) if c in keys else c for c in columns], *[c for c in added if c not in columns])


def haloed(rows: DataFrame, keys: list[str], number: str, before: int, size: int = SIZE) -> DataFrame:
    """Rows by ranges (``range``) of a gapless ``number``, each with the ``before`` rows that precede it (``halo``): frames fit into ranges."""
    home, last = F.floor(F.col(number) / size), F.floor((F.col(number) + before) / size)
    return rows.withColumn("range", F.explode(F.sequence(home, last))).withColumn("halo", F.col("range") != home)
