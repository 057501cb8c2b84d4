"""Running sums and rolling windows over long series, without a task that holds a series.

Rows get gapless positions in (series, order), and stretches of ``size`` positions are chunks; a chunk is what one task holds,
whether it has many series or a part of one. Running sums add up within chunks first; then the totals of the chunks
before, one row each, are added. Rolling windows get copies of the rows that end the chunk before.

Ties of the order are put in any order; null series are a series; null values count as none; columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .ordering import numbered

#: Rows of a chunk.
CHUNK = 100_000


def placed(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column] | None = None, size: int = CHUNK) -> DataFrame:
    """(row, by, at, chunk, values): each row whole, its series as one struct, its position, its chunk, and named values."""
    row = df.select(F.struct(*df.columns).alias("row"), F.struct(*by).alias("by"), F.struct(*order).alias("order"), F.struct(*[v.alias(n) for n, v in (values or {"none": F.lit(0)}).items()]).alias("values"))
    n = numbered(row, ["by", "order"], "at")
    return materialize(n.select("row", "by", "at", F.floor(F.col("at") / size).alias("chunk"), "values"), "placed")


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], size: int = CHUNK) -> DataFrame:
    """``df`` with, for each of ``values``, the sum over the series up to and with the row, under its name."""
    rows = placed(df, by, order, values, size)
    names = list(values)
    upto = W.partitionBy("chunk", "by").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("row", "by", "chunk", *[F.coalesce(F.sum(F.col("values")[v]).over(upto), F.lit(0)).alias(f"s{i}") for i, v in enumerate(names)])
    totals = rows.groupBy("by", "chunk").agg(*[F.coalesce(F.sum(F.col("values")[v]), F.lit(0)).alias(f"t{i}") for i, v in enumerate(names)])
    before = W.partitionBy("by").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    # a series that ends in the chunk it began in has nothing before
    carried = totals.select(F.col("by").alias("_by"), F.col("chunk").alias("_chunk"), *[F.sum(f"t{i}").over(before).alias(f"c{i}") for i in range(len(names))]).where("c0 is not null")
    out = local.join(carried, F.col("by").eqNullSafe(F.col("_by")) & (F.col("chunk") == F.col("_chunk")), "left")
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in names]
    return out.select(*kept, *[(F.col(f"s{i}") + F.coalesce(F.col(f"c{i}"), F.lit(0))).alias(v) for i, v in enumerate(names)])


def rolled(df: DataFrame, by: list[str], order: list[str], window: int, columns: dict[str, object], size: int = CHUNK) -> DataFrame:
    """``df`` with columns over the last ``window`` rows of the series: each of ``columns`` is given ``value`` (a column of ``df``) and the window.

    Every chunk gets copies of the ``window`` - 1 rows before it, which see no result of their own.
    """
    size = max(size, window - 1)
    rows = placed(df, by, order, None, size)
    ends = F.col("at") % size >= size - (window - 1)
    dealt = rows.select("row", "by", "at", "chunk", F.explode(F.when(ends, F.array("chunk", F.col("chunk") + 1)).otherwise(F.array("chunk"))).alias("task"))
    last = W.partitionBy("task", "by").orderBy("at").rowsBetween(-(window - 1), 0)
    value = lambda c: F.col("row")[c]
    new = dealt.select("row", (F.col("chunk") == F.col("task")).alias("own"), *[f(value, last).alias(f"n{i}") for i, f in enumerate(columns.values())])
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in columns]
    return new.where("own").select(*kept, *[F.col(f"n{i}").alias(n) for i, n in enumerate(columns)])
