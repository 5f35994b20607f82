"""Mixing sources to target weights.

Words are summed per source; the mix's size (a share of all words) is dealt out
by weight, no source getting more than `most` times its own words; what is cut
off goes to the others by weight. A source's rate is target / words; each
document comes floor(rate) times, and once more if a hash of its id and the
seed, as a number in [0, 1), is below the rate's fraction. Reruns and retried
tasks decide alike.

Null texts have size 0; a null source is a source of its own, last in order.
Documents without an id draw by their text. Repeated rows draw alike (ids
equal). Without words all targets are 0. Empty tables yield no rows. All
columns of the input stay; the operator's own have a leading underscore.
Only the table of sources (a row for each source) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.llm._common import materialize, word_count

#: Sources whose rates are broadcast; beyond it rates are joined by shuffle.
BROADCAST_SOURCES = 1_000_000


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Targets are min(most * size, level * weight), the level such that they sum
    to share of all words. In order of most * size / weight the sources at
    their limit come first, so running sums give the level.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    filled = weighed.withColumn("level", level)
    # the level is that of the first source that doesn't reach its limit
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("at", "level"))).over(whole)
    placed = filled.withColumn("at", F.row_number().over(order)).withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("at") < F.col("free.at")), F.col("cap")).otherwise(F.least("cap", F.col("free.level") * F.col("weight")))
    return placed.select("source", "source_size", "weight", target.alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of a key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights: list[int] = [5, 2, 1], share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:  # noqa: B006
    """The input with _size, _source_size, _target and _copies."""
    size = word_count(text_col) if size is None else size
    rates = materialize(source_targets(docs.select(F.col(source_col).alias("source"), size.alias("size")), weights, share, most), "targets")
    rates = rates.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    sized = docs.withColumn("_size", size)
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, sized[source_col].eqNullSafe(rates["_source"]), "left").drop("_source")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    copies = F.floor(rate) + F.when(uniform(key, seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("_copies", copies.cast("long"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the input's columns."""
    taken = with_copies(docs, **how)
    return taken.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
