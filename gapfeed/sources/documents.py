"""Task and validation documents: JSON lines, section tables, package manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T

TASK = "id string, framework string, file string, target string, kind string, line_range string, gap_type string, missing_branches array<string>, uncovered_lines array<int>, suggested_inputs array<string>, goal string, command string, test_file string, test_name string, priority int, confidence double"
VALIDATION = f"status string, action string, coverage_task struct<{', '.join(f.replace(' ', ':', 1) for f in TASK.split(', '))}>, run_result struct<status:string, passed:int, failed:int, skipped:int>"
SECTIONS = "name string, status string, exit_code int, reason string, signals string"


def task_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Tasks of JSON lines, each a task or a validation that wraps one; blank lines are passed over, and
    lines with neither id nor target come back with `valid` false."""
    rows = lines.where(T.trim(column) != "")
    wrapped = F.from_json(column, VALIDATION)["coverage_task"]
    task = F.when(wrapped["id"].isNotNull() | wrapped["target"].isNotNull(), wrapped).otherwise(F.from_json(column, TASK))
    rows = rows.withColumn("_task", task)
    return rows.select(*lines.columns, "_task.*").withColumn("valid", F.coalesce(F.col("id"), F.lit("")) .isNotNull() & ((F.coalesce(F.col("id"), F.lit("")) != "") | (F.coalesce(F.col("target"), F.lit("")) != "")))


def validation_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(id, target, line_range, status, action, skipped) of validation JSON lines; missing texts are empty, counts 0."""
    v = F.from_json(column, VALIDATION)
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = lines.where(T.trim(column) != "").withColumn("v", v)
    return rows.select(text(F.col("v.coverage_task.id")).alias("id"), text(F.col("v.coverage_task.target")).alias("target"), text(F.col("v.coverage_task.line_range")).alias("line_range"), text(F.col("v.status")).alias("status"), text(F.col("v.action")).alias("action"), F.coalesce("v.run_result.skipped", F.lit(0)).alias("skipped"))


def section_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Sections of tab-separated lines: name, status, code, reason, signals (JSON)."""
    cells = F.split(column, "\t")
    rows = lines.where(F.size(cells) >= 4).withColumn("c", cells)
    return rows.select(*[c for c in lines.columns if c != column], F.get("c", 0).alias("name"), F.get("c", 1).alias("status"), F.get("c", 2).try_cast("int").alias("exit_code"), F.get("c", 3).alias("reason"), F.from_json(F.coalesce(F.get("c", 4), F.lit("{}")), "map<string,string>").alias("signals"))


def in_vocabulary(value: Column, allowed: list[str]) -> Column:
    """Whether a value is one of a closed list (null: no)."""
    return F.coalesce(value.isin(*allowed), F.lit(False))
