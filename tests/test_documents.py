"""Roll-ups of JSON documents, fixtures against their list, artifacts, conditions of hints, sinks."""

import json

from pyspark.sql import functions as F

from gapfeed import sinks
from gapfeed.functions import vocabulary as V
from gapfeed.operators import conditions as C
from gapfeed.operators import responses as R
from gapfeed.sources.json_values import Json


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def rolled(spark, kind, doc):
    text = doc if doc is None or isinstance(doc, str) else json.dumps(doc)
    return one(R.roll_up(spark.createDataFrame([(text,)], "document string"), kind))


GOOD = {"status": "passed", "schema_version": 1, "failures": [], "fixture_count": 8, "decisions": list(V.EXPECTED_DECISIONS)}


def test_client(spark):
    good = GOOD | {"validator_exit_code": 0, "client_dir": "c", "fixture_dir": "f", "result_json": "r"}
    row = rolled(spark, "client", good)
    assert (row.status, row.agent_next_step, row.failures) == ("passed", "ready", [])
    row = rolled(spark, "client", good | {"validator_exit_code": "0", "status": "", "failures": ["a", None]})
    assert row.failures == ["summary status is missing", "validator_exit_code=0", "client fixture failure: a", "client fixture failure: null"]
    assert row.agent_next_step == "inspect-client-validator"
    row = rolled(spark, "client", good | {"decisions": ["accept"], "fixture_count": None})
    assert row.failures == ["fixture_count=null, want 8", "decisions must be " + ",".join(V.EXPECTED_DECISIONS)]
    assert row.agent_next_step == "inspect-agent-decision-fixtures"
    assert rolled(spark, "client", {k: v for k, v in good.items() if k != "client_dir"}).agent_next_step == "inspect-agent-decision-client-summary"
    for odd in (None, "", "nope", "[1]", "null"):
        row = rolled(spark, "client", odd)
        assert (row.status, row.failures) == ("failed", ["document is no JSON object"])


def test_consumer_and_release(spark):
    good = GOOD | dict.fromkeys(V.CONSUMER_REQUIRED, "x") | dict.fromkeys(V.CONSUMER_EXIT_CODES, 0)
    assert rolled(spark, "consumer", good).status == "passed"
    row = rolled(spark, "consumer", good | {"npm_validator_exit_code": 2, "schema_version": "1", "helper_ref": ""})
    assert row.failures == ["schema_version must be 1", "helper_ref is required", "npm_validator_exit_code=2"]
    assert row.agent_next_step == "inspect-consumer-smoke-validator"
    good = GOOD | {"release_ref": "v1", "installer_url": "https://h/v1/i", "helper_refs": {"install": "v1", "consumer": "v1"}, "agent_next_steps": {"client": "ready", "consumer": "ready"}}
    assert rolled(spark, "release", good).status == "passed"
    row = rolled(spark, "release", good | {"installer_url": "https://h/v2", "helper_refs": [], "agent_next_steps": {"client": "ready", "consumer": "x"}})
    assert row.failures == ["installer_url must include release_ref", "helper_refs.install=missing, want v1", "helper_refs.consumer=missing, want v1", "agent_next_steps.consumer=x, want ready"]
    assert row.agent_next_step == "inspect-release-installer"
    assert rolled(spark, "release", good | {"agent_next_steps": {"client": "ready"}}).agent_next_step == "inspect-release-consumer-response"


def test_keys_at_any_depth(spark):
    docs = ['{"a":[{"b":{"raw_output":1}}]}', '{"raw_output" : 2}', '{"x":"\\"raw_output\\":"}', '{"a\\"raw_output":1}', '{"x":"raw_output"}', "[]", None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string")
    got = df.select("i", Json(F.try_parse_json("t")).has_key("raw_output").alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [True, True, False, False, False, False, False]


def test_fixtures(spark):
    entry = {"kind": "validate_coverage_task", "source": "synthetic", "status": "passed", "action": "ready", "expected_decision": "accept", "client_expectation": "go on", "path": "p.json"}
    manual = entry | {"status": "failed", "action": "manual_review_internal", "expected_decision": "manual-review", "path": "m.json"}
    repair = entry | {"kind": "real_project_agent_loop", "status": "failed", "action": "apply_fix_suggestions", "expected_decision": "apply-repair", "path": "r.json"}
    better = entry | {"status": "failed", "action": "needs_better_input", "expected_decision": "needs-better-input", "path": "b.json"}
    state = lambda e: {"status": e["status"], "action": e["action"]}
    rows = [
        (entry, state(entry)),
        (manual, state(manual) | {"metadata": {"next_action_kind": "manual_review", "next_action_reason": " why ", "manual_review_kind": "internal", "manual_review_reason": " why "}}),
        (repair, state(repair) | {"run_result": {"fix_suggestions": [{"repair_task": None}], "raw_output": "x"}}),
        (better, state(better) | {"metadata": {"next_action_kind": "coverage_target_miss", "next_action_reason": "a", "needs_better_input_reason": "b", "coverage_miss_reason": "c"}}),
        (entry | {"kind": "other", "client_expectation": ""}, {"status": "failed", "action": "ready"}),
        (entry | {"path": "gone.json"}, None),
        ({}, None),
    ]
    table = [("m", i, f"m: fixtures[{i}]", json.dumps(e), None if p is None else json.dumps(p), "x") for i, (e, p) in enumerate(rows)]
    got = R.fixtures(spark.createDataFrame(table, "manifest string, pos int, label string, entry string, payload string, note string")).orderBy("pos").collect()
    assert [r.decision for r in got] == ["accept", "manual-review", "apply-repair", "needs-better-input", "repair-generated-test", None, None]
    assert [r.failures for r in got[:2]] == [[], []] and got[1].reason == "why" and got[0].note == "x"
    assert got[2].failures == ["r.json: real project fixture must not contain raw_output", "r.json: apply_fix_suggestions requires at least one repair_task"]
    assert got[3].failures == ["b.json: next_action_reason must match needs_better_input_reason", "b.json: next_action_reason must match legacy coverage_miss_reason when present"]
    assert got[4].failures == [
        "m: fixtures[4]: kind: expected one of validate_coverage_task, real_project_agent_loop",
        "m: fixtures[4]: client_expectation: expected non-empty string",
        "m: fixtures[4]: duplicate fixture path p.json",
        "p.json: status/action=failed/ready, manifest=passed/ready",
        "p.json: decision=repair-generated-test, expected=accept",
    ]
    assert got[5].failures == ["gone.json: fixture file does not exist"]
    assert len(got[6].failures) == 7 and got[6].failures[-1] == "m: fixtures[6]: path must be a non-empty string"


def test_artifacts(spark):
    signals = "signals array<struct<section:string,action:string>>"
    want = spark.createDataFrame(
        [(1, "f", "ready", "", 0, [("s", "go")]), (2, "g", "", "", None, []), (3, "", "stop", None, None, None), (4, "", "", "x", None, []), (5, "", "", "", 3, []), (6, "", "", "", None, [("s", "go"), ("s", "no")]), (7, "", "", "", None, [])],
        f"artifact int, action_field string, expected_action string, expected_failed_section string, expected_exit_code int, {signals}",
    )
    have = spark.createDataFrame([(i, "f", "ready", "", "0", [("s", "go")]) for i in range(1, 7)], f"artifact int, action_field string, action string, failed_section string, exit_code string, {signals}")
    got = {r.artifact: r.mismatch for r in R.artifact_mismatch(want, have).collect()}
    assert got == {1: None, 2: 'action_field="g", want "f"', 3: 'expected_action="stop", want "ready"', 4: 'expected_failed_section="x", want ""', 5: "expected_exit_code=3, want 0", 6: "missing expected_section_signal s:no", 7: "missing artifact"}


def test_conditions(spark):
    cases = [
        ("python", "try `x == 3 and not done`", {"x": "3", "done": "False"}),
        ("go", "n > 5 && m < 5 && k >= 2 && j != 4", {"n": "6", "m": "4", "k": "2", "j": "5"}),
        ("python", "x is not None", {"x": "object()"}),
        ("javascript", "v !== undefined && w === undefined;", {"v": "{}", "w": "undefined"}),
        ("rust", "!ready", {"ready": "false"}),
        ("java", "`name != null` or `mode.A.equals(kind)`", {"name": '"__other__"', "kind": "mode.A"}),
        ("go", "s != \"a\"", {"s": '"__other__"'}),
        ("go", "flag", {"flag": "true"}),
        ("go", "call with (odd) words", {}),
        ("go", "x == ,", {}),
        ("go", "", {}),
        ("go", None, {}),
        ("go", "x == 1 && x == 2", {"x": "2"}),
        ("go", "big > 9223372036854775807", {"big": "9223372036854775807"}),
    ]
    df = spark.createDataFrame([(i, lang, [hint] if i % 2 else [], [] if i % 2 else [hint]) for i, (lang, hint, _) in enumerate(cases)], "id int, language string, suggested_inputs array<string>, missing_branches array<string>")
    got: dict[int, dict[str, str]] = {i: {} for i in range(len(cases))}
    for r in C.task_inputs(df, ["id"]).collect():
        got[r.id][r.param] = r.value
    assert [got[i] for i in got] == [want for _, _, want in cases]


def test_quotes_and_names(spark):
    df = spark.createDataFrame([(r"""a + "b\"c" + 'd' + `e""",), ("x",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(C.without_quoted(F.col("t"))).collect()]
    assert got == ["a +        +     +   ", "x", "", None]
    names = df.select(C.has_unknown_names(C.without_quoted(F.col("t")), F.array(F.lit("a")))).collect()
    assert [r[0] for r in names] == [False, True, False, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", "failed", 2, 1), (1, "c", "passed", 0, 0), (2, "d", "passed", None, 0)], "run int, name string, status string, exit_code int, pos int")
    got = {r.run: r for r in sinks.section_reports(df, ["run"]).collect()}
    assert got[1].overall_status == "failed" and got[1].failed_count == 1 and got[2].overall_status == "passed"
    assert got[1].markdown.splitlines()[-2:] == ["| c | passed | 0 |", "| a\\|b | failed | 2 |"]
    assert json.loads(got[2].json)["sections"] == [{"name": "d", "status": "passed", "exit_code": None}]
    sinks.write_json_lines(df, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    made = sinks.json_result(df.where("run = 2"), F.concat(F.lit("section "), "name"), "name", "exit_code").collect()
    assert (made[0].text, json.loads(made[0].json)) == ("section d", {"name": "d", "exit_code": None})
    assert [r.decision for r in R.failed_sections(df).collect()] == ["inspect-verification"]
