"""Coverage blocks and files: totals, run-length blocks, line states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(covered: Column, total: Column) -> Column:
    """100 * covered / total; 0 without any."""
    return F.when(total > 0, covered.cast("double") * 100 / total.cast("double")).otherwise(F.lit(0.0))


def report_totals(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Statements, covered statements and percent of each report (blocks: keys, statements, covered)."""
    sums = blocks.groupBy(*keys).agg(F.sum("statements").cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col("covered"), F.col("statements"))), F.lit(0)).cast("long").alias("hit"))
    return sums.withColumn("percent", percent(F.col("hit"), F.col("total")))


def file_percent_by_span(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of each file by line spans: a block counts max(1, end - start + 1) lines."""
    span = F.greatest(F.lit(1), F.col("end_line") - F.col("start_line") + 1)
    sums = blocks.groupBy(*keys).agg(F.sum(span).cast("long").alias("total"), F.coalesce(F.sum(F.when(F.col("covered"), span)), F.lit(0)).cast("long").alias("hit"))
    return sums.withColumn("percent", percent(F.col("hit"), F.col("total")))


def file_line_stats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines, covered lines and percent of each file (lines: keys, line, covered)."""
    return lines.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("covered").alias("hit")).withColumn("percent", percent(F.col("hit"), F.col("total")))


def file_summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """Number of covered (percent > 0) and uncovered files of each report, and the uncovered ones' paths in order."""
    return files.groupBy(*keys).agg(F.count_if(F.col("percent") > 0).alias("covered_files"), F.count_if(F.col("percent") <= 0).alias("uncovered_count"), F.sort_array(F.collect_list(F.when(F.col("percent") <= 0, F.col("path")))).alias("uncovered_files"))


def run_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive lines of one state as blocks (lines: keys, line, covered; one row for each line)."""
    island = F.col("line") - F.row_number().over(Window.partitionBy(*keys, "covered").orderBy("line"))
    return lines.withColumn("_island", island).groupBy(*keys, "covered", "_island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).drop("_island")


def merge_states(executed: DataFrame, missing: DataFrame, keys: list[str]) -> DataFrame:
    """Line states of executed and missing lines; a line in both is executed."""
    both = executed.select(*keys, "line", F.lit(True).alias("covered")).unionByName(missing.select(*keys, "line", F.lit(False).alias("covered")))
    return both.groupBy(*keys, "line").agg(F.max("covered").alias("covered"))


def block_lines(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each line of each file; where blocks overlap the last one (by pos) counts."""
    lines = blocks.select(*keys, "pos", "covered", F.explode(F.when(F.col("end_line") >= F.col("start_line"), F.sequence("start_line", "end_line"))).alias("line"))
    return lines.groupBy(*keys, "line").agg(F.max_by("covered", "pos").alias("covered"))


def line_hits(tasks: DataFrame, blocks: DataFrame, keys: list[str], absent_is_hit: bool = False) -> DataFrame:
    """Hit and missed lines of each task (tasks: task_id, keys, start_line, end_line).

    A line that no block holds is missed; with absent_is_hit it is hit, unless
    the file has no blocks at all.
    """
    wanted = tasks.select("task_id", *keys, F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))).alias("line"))
    known = blocks.select(*keys).distinct().withColumn("_known", F.lit(True))
    if absent_is_hit:
        states = block_lines(blocks.where("not covered"), keys)
        joined = wanted.join(states, [*keys, "line"], "left").join(known, keys, "left")
        hit = F.col("covered").isNull() & F.col("_known").isNotNull()
    else:
        joined = wanted.join(block_lines(blocks, keys), [*keys, "line"], "left")
        hit = F.coalesce(F.col("covered"), F.lit(False))
    judged = joined.select("task_id", "line", hit.alias("hit"))
    return judged.groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("line")))).alias("hit_lines"),
        F.sort_array(F.collect_list(F.when(~F.col("hit"), F.col("line")))).alias("missed_lines"),
        F.min("hit").alias("target_hit"),
    )
