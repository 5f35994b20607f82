"""Writing results: JSON results, JSON lines, and a report of verification sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_result(df: DataFrame, summary: Column, *columns: str, keep: list[str] | None = None) -> DataFrame:
    """Each row as a result: a text for people and the chosen columns (all by default) as one JSON text, nulls included."""
    names = list(columns) or df.columns
    kept = [c for c in keep or [] if c not in ("text", "json")]
    return df.select(*kept, summary.alias("text"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists", partitions: list[str] | None = None) -> None:
    """One JSON object a line, in as many files as the data has partitions; nulls are written."""
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy(*partitions or []).json(path)


def section_reports(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Each run's report: overall_status, failed_count, a Markdown table and the whole as JSON.

    sections: keys, pos, name, status, exit_code. One row for each run is made by an
    aggregation; a run's sections are a list, as a report shows them all.
    """
    cell = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    one = F.struct("pos", "name", "status", "exit_code")
    failed = F.count_if(F.col("status") == "failed")
    runs = sections.groupBy(*keys).agg(failed.alias("failed_count"), F.sort_array(F.collect_list(one)).alias("_s"))
    runs = runs.withColumn("overall_status", F.when(F.col("failed_count") > 0, "failed").otherwise("passed"))
    line = lambda s: F.concat(F.lit("| "), cell(s["name"]), F.lit(" | "), cell(s["status"]), F.lit(" | "), cell(s["exit_code"]), F.lit(" |"))
    head = F.concat(F.lit("Overall: "), "overall_status", F.lit(", failed: "), F.col("failed_count").cast("string"), F.lit("\n\n| section | status | exit code |\n| --- | --- | --- |\n"))
    whole = F.to_json(F.struct("overall_status", "failed_count", F.transform("_s", lambda s: F.struct(s["name"].alias("name"), s["status"].alias("status"), s["exit_code"].alias("exit_code"))).alias("sections")), {"ignoreNullFields": "false"})
    return runs.select(*keys, "overall_status", "failed_count", F.concat(head, F.array_join(F.transform("_s", line), "\n")).alias("markdown"), whole.alias("json"))
