"""Star-schema and event tables as inputs of the feedback operators: plain deterministic projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as line coverage: (file, line, covered)."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.select((F.col("l_partkey") % 97).alias("file"), (F.col("l_orderkey") % 400 + 1).cast("int").alias("line"), (F.col("l_returnflag") == "R").alias("covered"))
    return rows.groupBy("file", "line").agg(F.max("covered").alias("covered"))


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as coverage blocks: (run_id, file, block_id, pos, start_line, end_line, statements, covered)."""
    t = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 500 + 1).cast("int")
    return t.select(
        (F.col("o_custkey") % 7).alias("run_id"),
        (F.col("o_custkey") % 50).alias("file"),
        F.col("o_orderkey").alias("block_id"),
        F.col("o_orderkey").alias("pos"),
        start.alias("start_line"),
        (start + (F.col("o_custkey") % 9).cast("int")).alias("end_line"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("statements"),
        (F.col("o_orderstatus") == "F").alias("covered"),
    )


def part_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as source spans: (file, span_pos, name, start_line, end_line)."""
    t = table(spark, sf_dir, "part")
    start = (F.col("p_partkey") * 7 % 500 + 1).cast("int")
    return t.select((F.col("p_partkey") % 50).alias("file"), F.col("p_partkey").alias("span_pos"), F.col("p_name").alias("name"), start.alias("start_line"), (start + F.col("p_size").cast("int")).alias("end_line"))


def part_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as coverage suggestions."""
    t = table(spark, sf_dir, "part")
    words = F.split(F.lower("p_type"), " ")
    kinds = F.array(*[F.lit(x) for x in ("branch", "error_path", "return_path", "statement", "")])
    folders = F.array(*[F.lit(x) for x in ("utils", "service", "pkg", "src/controller", "core/time", "lib")])
    frameworks = F.array(*[F.lit(x) for x in ("go-test", "jest", "pytest", "junit", "cargo-test", "mocha", "vitest", "node-test")])
    ends = F.array(*[F.lit(x) for x in (".go", ".ts", ".py", ".java", ".rs", ".css")])
    pick = lambda a, n: F.element_at(a, (F.col("p_partkey") % n + 1).cast("int"))
    start = (F.col("p_partkey") % 300 + 1).cast("int")
    end = start + (F.col("p_size") % 4).cast("int")
    whole = F.col("p_partkey") % 11 == 0
    return t.select(
        (F.col("p_partkey") % 13).alias("report"),
        pick(frameworks, 8).alias("framework"),
        F.col("p_partkey").alias("idx"),
        F.concat(pick(folders, 6), F.lit("/"), F.element_at(words, 1), F.lit("_"), F.element_at(words, -1), pick(ends, 6)).alias("file"),
        F.when(whole, "").otherwise(F.col("p_name")).alias("function"),
        F.lit("function").alias("kind"),
        F.when(whole, "entire file").otherwise(F.concat_ws("-", start, end)).alias("line_range"),
        F.when(whole, "").otherwise(pick(kinds, 5)).alias("gap_type"),
        F.array().cast("array<string>").alias("missing_branches"),
        F.when(whole, F.array().cast("array<int>")).otherwise(F.sequence(start, end)).alias("uncovered_lines"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("suggested_inputs"),
        F.when(whole, 0.8).when(F.col("p_partkey") % 8 == 0, 0.95).otherwise(0.9).alias("confidence"),
    )


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as test events: (run_id, pos, test, action, output)."""
    t = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "skip").otherwise("output")
    return t.select((F.col("user_id") % 40).alias("run_id"), F.col("event_id").alias("pos"), F.col("user_id").alias("test"), action.alias("action"), F.col("props").alias("output"))
