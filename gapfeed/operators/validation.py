"""Validation of tasks: result actions, the override cascade, decisions, roll-ups, path joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators.failures import holds_any

#: Flags in the order in which they override an action.
OVERRIDES = ("unreachable", "environment", "protocol", "database", "external_service", "private", "internal", "no_runtime")


def result_action(status: Column, passed: Column, failures: Column, suggestions: Column) -> Column:
    """What to do with a test result."""
    failed = F.when(suggestions > 0, "apply_fix_suggestions").when(failures > 0, "inspect_failures").otherwise("inspect_test_runner")
    return F.when(status == "fail", failed).when(passed == 0, "manual_review").otherwise("ready")


def base_action(status: Column, action: Column, failures: Column, suggestions: Column) -> Column:
    """The action of a validated run before overrides; null status: it did not run."""
    failed = F.when(suggestions > 0, "apply_fix_suggestions").when(failures > 0, "repair_generated_test").otherwise("manual_review")
    return F.when(status.isNull(), "inspect_test_runner").when(status == "pass", F.when(action == "manual_review", "manual_review").otherwise("ready")).otherwise(failed)


def base_status(status: Column) -> Column:
    return F.when(status.isNull(), "run_error").when(status == "pass", "passed").otherwise("failed")


def cascade(status: Column, action: Column, flags: dict[str, Column], target_hit: Column) -> tuple[Column, Column]:
    """(status, action) after the overrides: the first flag that is set, then ready tasks whose target lines weren't hit."""
    out = F.lit(None).cast("string")
    for name in reversed(OVERRIDES):
        out = F.when(flags[name], f"manual_review_{name}").otherwise(out)
    action = F.coalesce(out, action)
    weak = (action == "ready") & F.coalesce(~target_hit, F.lit(False))
    return F.when(weak, "failed").otherwise(status), F.when(weak, "needs_better_input").otherwise(action)


def looks_external(raw_output: Column, target: Column, hints: Column) -> Column:
    """Whether a failed run depends on a live service: its output and its target or hints say so."""
    run = holds_any(F.lower(raw_output), V.EXTERNAL_RUN_MARKERS)
    named = F.contains(F.lower(T.trim(target)), F.lit("producer.")) | holds_any(F.lower(hints), V.EXTERNAL_TARGET_MARKERS)
    return run & named


def preview_flag(preview: Column, status: Column, skipped: Column, name: str) -> Column:
    """Whether a generated test marks itself as manual review of a kind and passed with something skipped."""
    return (status == "pass") & (skipped > 0) & F.contains(preview, F.lit(f"manual_review_{name}:"))


def review_flags(target: Column, file: Column, hints: Column, preview: Column, status: Column, skipped: Column, raw_output: Column, errors: Column) -> dict[str, Column]:
    """The flags of `cascade` from a task, its generated test and its run. hints: the task's branches, inputs and
    focus texts in one string; errors: those of the run's failures in one string. Nulls count as empty."""
    target, file, hints, preview, status, raw_output, errors = (F.coalesce(x, F.lit("")) for x in (target, file, hints, preview, status, raw_output, errors))
    says = lambda text, *marks: holds_any(text, marks)
    passed, failed = status == "pass", status == "fail"
    skips = passed & (F.coalesce(skipped, F.lit(0)) > 0)
    todo, name = skips & says(preview, V.SKIP_TODO), T.trim(target)
    own = {kind: says(preview, f"manual_review_{kind}:") for kind in OVERRIDES}
    in_database = says(target, "Repo.") | says(preview, "*Repo") | says(file, "/repo/", "\\repo\\")
    unreachable = (target == "init") & says(preview, V.SKIP_INIT) & skips | todo & (target == V.UNREACHABLE_TARGET) & says(hints, V.UNREACHABLE_HINT)
    private = says(name, ".#") | says(preview, "instance.#")
    all_hints = F.lower(F.concat_ws(" ", hints, name, preview))
    return {
        "unreachable": skips & own["unreachable"] | unreachable,
        "environment": skips & own["environment"] | todo & target.isin(*V.ENVIRONMENT_TARGETS) & says(hints, V.ERROR_HINT),
        "protocol": todo & says(hints, V.ERROR_HINT) & target.isin(*V.PROTOCOL_TARGETS),
        "database": skips & own["database"] | todo & says(hints, *V.DATABASE_HINTS) & in_database,
        "external_service": failed & looks_external(F.concat_ws("\n", raw_output, errors), name, all_hints),
        "private": private & (own["private"] & passed | failed & says(raw_output, *V.PRIVATE_RUN_MARKERS)),
        "internal": passed & own["internal"],
        "no_runtime": passed & own["no_runtime"],
    }


def public_entries(preview: Column) -> Column:
    """The entry points that a preview lists; null without such a line, or with none detected."""
    line = T.trim(F.regexp_extract(preview, r"(?m)public_entry_candidates:(.*)$", 1))
    parts = F.filter(F.transform(F.split(line, ","), T.trim), lambda x: x != "")
    return F.when((line != "") & ~F.startswith(line, F.lit("none detected")), parts)


def file_of_task(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Each task with the first report file (by pos) whose path equals its own or is a whole-segment suffix
    either way; null without one. tasks: task_id, file; files: path, pos.

    Paths meet on their last element, so the suffix test sees few pairs.
    """
    own = F.regexp_replace(T.trim("file"), r"^.*/src/main/java/", "")
    t = tasks.withColumn("_own", own).withColumn("_name", T.base_name(own)).alias("t")
    f = files.withColumn("_path", T.trim("path")).withColumn("_base", T.base_name(T.trim("path"))).alias("f")
    fits = (F.col("_path") == F.col("_own")) | F.endswith(F.col("_own"), F.concat(F.lit("/"), F.col("_path"))) | F.endswith(F.col("_path"), F.concat(F.lit("/"), F.col("_own")))
    met = t.join(f, (F.col("_name") == F.col("_base")) & fits)
    first = met.groupBy("task_id").agg(F.min_by("path", "pos").alias("path"))
    return tasks.join(first, "task_id", "left")


def histogram(validations: DataFrame, keys: list[str]) -> DataFrame:
    """Validations by status and action, with skipped totals and how many ready ones skipped nothing."""
    return validations.groupBy(*keys, "status", "action").agg(F.count("*").alias("n"), F.sum("skipped").cast("long").alias("skipped_total"), F.count_if((F.col("action") == "ready") & (F.col("skipped") == 0)).alias("ready_zero_skip"))


def unexpected(validations: DataFrame, allowed: list[str]) -> DataFrame:
    """Validations that didn't pass, aren't manual reviews and aren't allowed."""
    return validations.where((F.col("status") != "passed") & ~F.startswith(F.col("action"), F.lit("manual_review_")) & ~F.col("action").isin(*allowed))


def agent_decision(status: Column, action: Column) -> Column:
    """What an agent does next with a validated task."""
    return (
        F.when((status == "passed") & (action == "ready"), "accept")
        .when(F.startswith(action, F.lit("manual_review_")), "manual-review")
        .when(action == "apply_fix_suggestions", "apply-repair")
        .when(action == "needs_better_input", "needs-better-input")
        .when(status == "generation_error", "inspect-generation")
        .when(status == "run_error", "inspect-runner")
        .when(status == "failed", "repair-generated-test")
        .otherwise("inspect")
    )


def section_decision(name: Column) -> Column:
    """What to look at after a verification section failed, by its name."""
    has = lambda w: F.contains(name, F.lit(w))
    return (
        F.when(has("基础安装"), "fix-installation")
        .when(has("MCP 协议"), "inspect-mcp-transport")
        .when(has("Agent 闭环"), "inspect-agent-demo")
        .when(has("showcase"), "inspect-showcase")
        .when(has("用户项目"), "inspect-user-project")
        .otherwise("inspect-verification")
    )


def expectation_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected action of each id against the actual one; missing ids mismatch."""
    joined = expected.select("id", F.col("action").alias("expected")).join(actual.select("id", F.col("action").alias("actual")), "id", "left")
    return joined.withColumn("matches", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def overall_status(sections: DataFrame, keys: list[str]) -> DataFrame:
    """failed if any section failed, with the number of failed ones."""
    failed = F.count_if(F.col("status") == "failed")
    return sections.groupBy(*keys).agg(F.when(failed > 0, "failed").otherwise("passed").alias("overall_status"), failed.alias("failed_count"))
