"""Test tasks from coverage gaps: fields, score, order and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V


def path_words(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), r"[/\\\-_.]"), lambda w: w != "")


def path_cost(path: Column) -> Column:
    """-35 for a directory word of costly code, else 18 for a path word of cheap code, else 0."""
    folder = T.directory(path)
    high = F.arrays_overlap(path_words(F.when(folder == ".", "").otherwise(folder)), F.array(*[F.lit(w) for w in V.HIGH_COST]))
    low = F.arrays_overlap(path_words(path), F.array(*[F.lit(w) for w in V.LOW_COST]))
    return F.when(high, -35).when(low, 18).otherwise(0)


def eligible(framework: Column, file: Column) -> Column:
    """Script frameworks get tasks for script files only; all others for every file."""
    script = T.framework_name(framework).isin(*V.SCRIPT_FRAMEWORKS)
    return ~script | F.lower(T.extension(file)).isin(*V.SCRIPT_EXTENSIONS)


def test_file(framework: Column, file: Column) -> Column:
    """Where tests for a file go, by framework (without a look at the file system)."""
    fw, ext, base = T.framework_name(framework), T.extension(file), T.without_extension(file)
    name, low = T.base_name(file), F.regexp_replace(file, "^(src|lib)/", "")
    marked = F.contains(base, F.lit(".test")) | F.contains(base, F.lit(".spec"))
    folder = T.directory(low)
    python = F.when(F.startswith(name, F.lit("test_")), file).when(folder == ".", F.concat(F.lit("tests/test_"), name)).otherwise(F.concat(F.lit("tests/"), folder, F.lit("/test_"), name))
    inner = F.regexp_replace(file, "^src/main/java/", "")
    java = (
        F.when(F.startswith(file, F.lit("src/test/java/")), file)
        .when(F.startswith(file, F.lit("src/main/java/")) | (~F.startswith(file, F.lit("/")) & F.contains(file, F.lit("/"))), F.concat(F.lit("src/test/java/"), T.without_extension(inner), F.lit("Test"), ext))
        .when(ext == ".java", F.concat(base, F.lit("Test"), ext))
        .otherwise("")
    )
    return (
        F.when(fw == "go-test", F.when(F.endswith(file, F.lit("_test.go")), file).when(ext == ".go", F.concat(base, F.lit("_test.go"))).otherwise(""))
        .when(fw == "cargo-test", file)
        .when(fw == "junit", java)
        .when(fw.isin("jest", "vitest", "node-test"), F.when(marked, file).otherwise(F.concat(base, F.lit(".test"), ext)))
        .when(fw == "mocha", F.when(marked, file).otherwise(F.concat(base, F.lit(".spec"), ext)))
        .when(fw == "pytest", python)
        .otherwise("")
    )


def test_name(framework: Column, target: Column) -> Column:
    fw, words = T.framework_name(framework), T.identifier_words(target)
    return (
        F.when(F.size(words) == 0, "")
        .when(fw == "go-test", F.concat(F.lit("Test"), T.pascal_case(words)))
        .when(fw.isin("cargo-test", "pytest"), F.concat(F.lit("test_"), T.snake_case(words), F.lit("_covers_gap")))
        .when(fw == "junit", F.concat(F.lit("shouldCover"), T.pascal_case(words), F.lit("Gap")))
        .when(fw.isin("jest", "vitest", "mocha", "node-test"), F.concat(F.lit("covers "), target, F.lit(" coverage gap")))
        .otherwise("")
    )


def command(framework: Column, file: Column) -> Column:
    fw, folder = T.framework_name(framework), T.directory(file)
    return (
        F.when(fw == "go-test", F.when(folder == ".", "go test ./...").otherwise(F.concat(F.lit("go test ./"), folder)))
        .when(fw == "jest", F.concat(F.lit("npx jest "), file))
        .when(fw == "vitest", F.concat(F.lit("npx vitest run "), file))
        .when(fw == "mocha", F.concat(F.lit("npx mocha "), file))
        .when(fw == "node-test", "node --test")
        .when(fw == "pytest", F.concat(F.lit("python3 -m pytest "), file))
        .when(fw == "cargo-test", "cargo test")
        .when(fw == "junit", "mvn test")
        .otherwise("")
    )


def assertion_focus(gap: Column, branches: Column, lines: Column) -> Column:
    """What a test should assert: the gap's text, its missing branches, its lines."""
    said = F.element_at(F.create_map(*[F.lit(x) for kv in V.GAP_FOCUS.items() for x in kv]), gap)
    covered = F.when(F.size(lines) > 0, F.concat(F.lit(V.FOCUS_LINES), T.ints_csv(lines)))
    return F.filter(F.concat(F.array(said), F.coalesce(branches, F.array().cast("array<string>")), F.array(covered)), lambda x: x.isNotNull())


def priority(s: dict[str, Column]) -> tuple[Column, Column]:
    """(score, reasons) of a gap. s: function, line_range, gap_type, has_inputs, has_lines, test_file, file, confidence."""
    cost = path_cost(s["file"])
    parts = [
        (s["function"] != "", F.lit(40), V.REASON_FUNCTION),
        ((s["function"] == "") & (s["line_range"] == "entire file"), F.lit(-20), V.REASON_WHOLE_FILE),
        *((s["gap_type"] == kind, F.lit(points), reason) for kind, (points, reason) in V.GAP_SCORE.items()),
        (s["has_inputs"], F.lit(10), V.REASON_INPUTS),
        (s["has_lines"], F.lit(8), V.REASON_LINES),
        (s["test_file"] != "", F.lit(6), V.REASON_TEST_FILE),
        (cost < 0, cost, V.REASON_HIGH_COST),
        (cost > 0, cost, V.REASON_LOW_COST),
    ]
    score = sum((F.when(c, points).otherwise(0) for c, points, _ in parts), (s["confidence"] * 10).cast("int"))
    reasons = [F.when(c, reason) for c, _, reason in parts]
    reasons.append(F.when(s["confidence"] > 0, F.format_string(V.REASON_CONFIDENCE, s["confidence"].cast("double"))))
    return F.greatest(score, F.lit(0)), F.array_join(F.filter(F.array(*reasons), lambda r: r.isNotNull()), "；")


def rank_order() -> list[Column]:
    """Tasks by priority and confidence, then file, line range (as text), target and input order."""
    return [F.desc("priority"), F.desc("confidence"), F.asc("file"), F.asc("line_range"), F.asc("target"), F.asc("idx")]


def number_tasks(tasks: DataFrame, report: str) -> DataFrame:
    """Tasks of each report with their ids, <framework>-<n> from 1 in rank order."""
    n = F.row_number().over(Window.partitionBy(report).orderBy(*rank_order()))
    return tasks.withColumn("rank", n).withColumn("id", F.concat(T.slug(F.col("framework")), F.lit("-"), n.cast("string")))


def top_tasks(tasks: DataFrame, report: str, n: int, strict: bool = False) -> DataFrame:
    """The first n tasks of each report; `strict`: the job fails with a report's name if it has fewer."""
    ranked = number_tasks(tasks, report)
    if strict:
        have = tasks.groupBy(report).agg(F.count("*").alias("_have"))
        short = F.raise_error(F.concat(F.lit("report "), F.col(report).cast("string"), F.lit(": "), F.col("_have").cast("string"), F.lit(f" tasks, want at least {n}")))
        checked = have.select(report, F.when(F.col("_have") < n, short.cast("long")).otherwise(F.col("_have")).alias("_have"))
        ranked = ranked.join(checked, report).where("_have > 0").drop("_have")
    return ranked.where(F.col("rank") <= n)


def short_reports(tasks: DataFrame, report: str, n: int) -> DataFrame:
    """(report, have) of the reports with fewer than n tasks."""
    return tasks.groupBy(report).agg(F.count("*").alias("have")).where(F.col("have") < n)


def from_suggestions(rows: DataFrame, report: str) -> DataFrame:
    """Numbered tasks from suggestions (report, framework, idx, file, function, kind, line_range, gap_type,
    missing_branches, uncovered_lines, suggested_inputs, confidence)."""
    fw, file = F.col("framework"), F.col("file")
    rows = rows.where(eligible(fw, file))
    target = F.when(F.coalesce(F.col("function"), F.lit("")) != "", F.col("function")).otherwise(T.base_name(file))
    out = rows.withColumn("target", target).withColumn("test_file", test_file(fw, file))
    score, reasons = priority(
        {
            "function": F.coalesce(F.col("function"), F.lit("")), "line_range": F.col("line_range"), "gap_type": F.coalesce(F.col("gap_type"), F.lit("")),
            "has_inputs": F.coalesce(F.size("suggested_inputs") > 0, F.lit(False)), "has_lines": F.coalesce(F.size("uncovered_lines") > 0, F.lit(False)),
            "test_file": F.col("test_file"), "file": file, "confidence": F.col("confidence"),
        }
    )
    out = out.withColumn("priority", score).withColumn("priority_reason", reasons)
    out = out.withColumn("goal", F.concat(F.lit(V.GOAL_FOR), F.col("target"), F.lit(V.GOAL_COVER), F.col("line_range")))
    out = out.withColumn("command", command(fw, file)).withColumn("test_name", test_name(fw, F.col("target")))
    out = out.withColumn("assertion_focus", assertion_focus(F.col("gap_type"), F.col("missing_branches"), F.col("uncovered_lines")))
    return number_tasks(out, report)


def eligible_files(tasks: DataFrame, contains: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Tasks whose file holds a text and whose id is in a list; either may be left out."""
    if contains:
        tasks = tasks.where(F.contains(F.col("file"), F.lit(contains)))
    return tasks if ids is None else tasks.join(ids.select(T.trim("id").alias("id")), "id", "left_semi")
