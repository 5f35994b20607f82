"""Running sums, last values and maxima along a key's positions without one task for a key.

A key's rows are cut into splits by position. Each split is folded to one row,
these rows are scanned for each key, and what came before a split enters it as
a row at its head: so the rows move once, by key and split, and a key of
any size is as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one split.
SPLIT = 1 << 18


def running(rows: DataFrame, keys: list[str], pos: str = "pos", sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, most: dict[str, Column] | None = None, split: int = SPLIT, exclusive: bool = False) -> DataFrame:
    """Rows with new columns: for each of `sums` the sum up to and with the row (nulls count 0), for each of `lasts`
    the last value that isn't null, for each of `most` the greatest value so far. `exclusive`: up to the row before.

    Values are expressions over a row. Positions are whole numbers, distinct within a key. Null keys are a key.
    """
    sums, lasts, most = sums or {}, lasts or {}, most or {}
    columns = rows.columns
    values = {f"_v_{n}": v for n, v in [*((n, F.coalesce(v, F.lit(0))) for n, v in sums.items()), *lasts.items(), *most.items()]}
    placed = rows.withColumns({"_split": F.floor(F.col(pos) / split), **values})
    fold = {
        **{n: lambda c: F.sum(c) for n in sums},
        **{n: lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(pos))) for n in lasts},
        **{n: lambda c: F.max(c) for n in most},
    }
    folded = placed.groupBy(*keys, "_split").agg(*[f(F.col(f"_v_{n}")).alias(f"_v_{n}") for n, f in fold.items()])
    before = Window.partitionBy(*keys).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    scan = {**{n: F.sum for n in sums}, **{n: lambda c: F.last(c, ignorenulls=True) for n in lasts}, **{n: F.max for n in most}}
    heads = folded.select(*keys, "_split", *[f(F.col(f"_v_{n}")).over(before).alias(f"_v_{n}") for n, f in scan.items()], F.lit(0).alias("_row"))
    both = placed.withColumn("_row", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    within = Window.partitionBy(*keys, "_split").orderBy("_row", pos).rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    out = both.withColumns({n: f(F.col(f"_v_{n}")).over(within) for n, f in scan.items()})
    return out.where("_row = 1").select(*columns, *scan)
