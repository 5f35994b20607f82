"""Metadata of validated tasks: absent keys, precedence, JSON."""

import json

from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.operators import metadata, validation

SCHEMA = "id int, target string, file string, hints string, preview string, status string, skipped int, raw_output string, errors string, framework string, line_range string, coverage_requested boolean, test_file string, coverage_report string, hit_lines array<int>, missed_lines array<int>"


def read(spark, *rows):
    t = spark.createDataFrame(rows, SCHEMA)
    t = t.withColumns({"run_status": validation.base_status(F.col("status")), "action": validation.base_action(F.col("status"), F.lit(""), F.lit(1), F.lit(0))})
    got = metadata.annotated(t).select("id", "status", "action", metadata.as_json(F.col("metadata")).alias("m")).orderBy("id").collect()
    return [(r.status, r.action, json.loads(r.m)) for r in got]


def test_keys(spark):
    rows = [
        (1, " Go ", "a.go", "", "", "pass", 0, "", "", "GO-TEST", "3-4", True, "a_test.go", "cov.out", [3], [4]),
        (2, "T", "a.go", "", "manual_review_unreachable: manual_review_environment:", "pass", 1, "", "", "go-test", "3", False, "t.go", None, None, None),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (4, "x", "a.js", "", "", "pass", 0, "", "", "jest", "9-9", None, None, "r", [9], None),
    ]
    hit, twice, bare, full = read(spark, *rows)
    assert hit[:2] == ("failed", "needs_better_input")
    missed = V.REASON_MISSED.replace("{target}", "Go").replace("{range}", "3-4")
    assert hit[2] == {
        "framework": "go-test", "coverage_target_hit_supported": True, "coverage_target_hit_supported_frameworks": list(V.HIT_FRAMEWORKS), "test_file": "a_test.go", "coverage_report": "cov.out", "coverage_target_lines": [3, 4],
        "coverage_hit_lines": [3], "coverage_missed_lines": [4], "coverage_target_hit": False, "coverage_miss_reason": missed, "next_action_kind": "coverage_target_miss", "next_action_reason": missed, "needs_better_input_reason": missed,
    }
    assert twice[1] == "manual_review_unreachable" and twice[2]["environment_dependent"] and twice[2]["environment_reason"].startswith("T depends")
    assert twice[2]["manual_review_kind"] == "unreachable" and twice[2]["manual_review_reason"] == twice[2]["next_action_reason"] == twice[2]["unreachable_reason"]
    assert bare == ("run_error", "inspect_test_runner", {"framework": ""})
    assert full[:2] == ("passed", "ready") and full[2]["coverage_target_hit"] is True and full[2]["coverage_missed_lines"] == [] and "coverage_miss_reason" not in full[2]


def test_no_rows(spark):
    assert read(spark) == []
