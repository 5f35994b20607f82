"""The metadata of a validated task: why it is to be reviewed, which lines were hit, what comes next.

Keys are typed columns that are null where a key is absent; a JSON text of them leaves those out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators import validation

#: Columns that `annotated` reads beside the lines; nulls count as empty texts.
INPUTS = ("target", "file", "hints", "preview", "status", "skipped", "raw_output", "errors")


def _said(text: str, target: Column, default: str | None = None) -> Column:
    """A reason about a target, or about what stands for an empty one."""
    name = target if default is None else F.when(target == "", default).otherwise(target)
    return F.replace(F.lit(text), F.lit("{target}"), name)


def reasons(flags: dict[str, Column], target: Column, file: Column, preview: Column, status: Column, framework: Column) -> dict[str, Column]:
    """Why each flag of `validation.review_flags` is set; null where it isn't. framework: the task's, or its context's."""
    raw = F.coalesce(target, F.lit(""))
    name, preview, file = T.trim(raw), F.coalesce(preview, F.lit("")), F.lower(F.coalesce(file, F.lit("")))
    marked = {kind: F.contains(preview, F.lit(f"manual_review_{kind}:")) for kind in V.REVIEW_KEYS}
    framework = T.framework_name(F.coalesce(framework, F.lit("")))
    of_target = F.coalesce(*[F.when(raw == t, r) for t, r in V.REASON_ENVIRONMENT_OF.items()])
    of_init = (raw == "init") & F.contains(preview, F.lit(V.SKIP_INIT))
    java, python = (framework == "junit") | F.endswith(file, F.lit(".java")), (framework == "pytest") | F.endswith(file, F.lit(".py"))
    said = {
        "unreachable": F.when(marked["unreachable"], _said(V.REASON_UNREACHABLE, name, "coverage task")).when(of_init, V.REASON_INIT).otherwise(V.REASON_REMOTE_IP),
        "environment": F.when(marked["environment"], _said(V.REASON_ENVIRONMENT, name, "coverage task")).otherwise(of_target),
        "protocol": _said(V.REASON_PROTOCOL, raw),
        "database": F.when(marked["database"], _said(V.REASON_DATABASE, name, "coverage task")).otherwise(_said(V.REASON_REPOSITORY, raw)),
        "external_service": _said(V.REASON_EXTERNAL, name, "coverage task"),
        "private": F.when(marked["private"] & (status == "pass"), _said(V.REASON_PRIVATE, name)).otherwise(_said(V.REASON_PRIVATE_FAILED, name)),
        "internal": F.when(java, _said(V.REASON_INTERNAL_JAVA, name, "target")).when(python, _said(V.REASON_INTERNAL_PYTHON, name, "target")).otherwise(_said(V.REASON_INTERNAL_SCRIPT, name, "target")),
        "no_runtime": _said(V.REASON_NO_RUNTIME, name, "file"),
    }
    return {kind: F.when(F.coalesce(flags[kind], F.lit(False)), r) for kind, r in said.items()}


def annotated(tasks: DataFrame) -> DataFrame:
    """Tasks with status, action and a struct `metadata` after the cascade of overrides.

    tasks: INPUTS, action and run_status of the run (see validation.base_*), framework, line_range, coverage_requested, test_file (null: nothing was
    generated), and of the target's lines coverage_report, hit_lines, missed_lines (null: not known).
    """
    # flags and reasons are columns of their own: what follows names them several times
    flags = validation.review_flags(*[F.col(c) for c in INPUTS])
    rows = tasks.withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    flags = {k: F.col(f"_{k}") for k in flags}
    why = reasons(flags, F.col("target"), F.col("file"), F.col("preview"), F.col("status"), F.col("framework"))
    known = F.col("coverage_report").isNotNull()
    hit = F.when(known, F.size(F.coalesce("missed_lines", F.array())) == 0)
    missed = _said(V.REASON_MISSED, T.trim(F.coalesce("target", F.lit(""))))
    rows = rows.withColumns({f"_why_{k}": c for k, c in why.items()} | {"_hit": hit, "_missed": F.when(known & ~hit, F.replace(missed, F.lit("{range}"), T.trim(F.coalesce("line_range", F.lit("")))))})
    status, action = validation.cascade(F.col("run_status"), F.col("action"), flags, F.col("_hit"))
    rows = rows.withColumns({"_status": status, "_action": action})
    manual, better = F.startswith("_action", F.lit("manual_review_")), F.col("_action") == "needs_better_input"
    kind = F.when(manual, F.regexp_replace("_action", "^manual_review_", ""))
    review = T.non_empty(F.coalesce(*[F.when(F.col("_action") == f"manual_review_{k}", F.col(f"_why_{k}")) for k in V.REVIEW_KEYS]))
    framework = T.framework_name(F.coalesce("framework", F.lit("")))
    requested, none = F.coalesce("coverage_requested", F.lit(False)), F.lit(None)
    fields = {
        "framework": framework,
        "coverage_target_hit_supported": F.when(requested, framework.isin(*V.HIT_FRAMEWORKS)),
        "coverage_target_hit_supported_frameworks": F.when(requested, F.array(*[F.lit(x) for x in V.HIT_FRAMEWORKS])),
        "test_file": F.col("test_file"),
        "coverage_report": F.col("coverage_report"),
        "coverage_target_lines": F.when(known, F.concat(F.coalesce("hit_lines", F.array().cast("array<int>")), F.coalesce("missed_lines", F.array().cast("array<int>")))),
        "coverage_hit_lines": F.when(known, F.coalesce("hit_lines", F.array().cast("array<int>"))),
        "coverage_missed_lines": F.when(known, F.coalesce("missed_lines", F.array().cast("array<int>"))),
        "coverage_target_hit": F.col("_hit"),
        "coverage_miss_reason": F.col("_missed"),
    }
    for k, (key, reason) in V.REVIEW_KEYS.items():
        fields |= {key: F.when(F.col(f"_{k}"), F.lit(True)), reason: F.col(f"_why_{k}")}
    fields["public_entry_candidates"] = F.when(F.col("_private") & (F.size(F.coalesce(validation.public_entries(F.coalesce("preview", F.lit(""))), F.array())) > 0), validation.public_entries(F.coalesce("preview", F.lit(""))))
    fields["next_action_kind"] = F.when(better, "coverage_target_miss").when(manual, "manual_review").otherwise(none.cast("string"))
    fields["next_action_reason"] = F.when(better, F.col("_missed")).when(manual, review)
    fields["needs_better_input_reason"] = F.when(better, F.col("_missed"))
    fields["manual_review_kind"] = kind
    fields["manual_review_reason"] = F.when(manual, review)
    made = F.struct(*[c.alias(k) for k, c in fields.items()])
    return rows.select(*[c for c in tasks.columns if c not in ("status", "action")], F.col("_status").alias("status"), F.col("_action").alias("action"), made.alias("metadata"))


def as_json(metadata: Column) -> Column:
    """Metadata as JSON text with the keys that are there."""
    return F.to_json(metadata)


