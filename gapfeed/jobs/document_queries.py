"""Queries of documents: roll-ups, fixtures, artifacts, input hints, reports of sections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed import sinks
from gapfeed.functions import vocabulary as V
from gapfeed.jobs import adapters as A
from gapfeed.jobs.registry import query
from gapfeed.operators import conditions, imports, responses

_DECISIONS = ",".join(V.EXPECTED_DECISIONS)
_LIST = "[" + ",".join(f'"{x}"' for x in V.EXPECTED_DECISIONS) + "]"


def _pick(index: Column, *texts: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS s, o_custkey % 3 AS e, o_orderkey % 7 AS f, o_custkey % 4 AS n, o_custkey % 6 AS d, o_orderkey % 11 AS c FROM orders),
r AS (SELECT o_orderkey, list_filter([CASE s WHEN 0 THEN 'summary status is failed' WHEN 1 THEN 'summary status is missing' END, CASE WHEN e = 0 THEN 'validator_exit_code=1' WHEN e = 1 THEN 'validator_exit_code=undefined' END,
CASE f WHEN 0 THEN 'client fixture failure: f' || o_orderkey WHEN 1 THEN 'failures must be an array' END, CASE WHEN n = 0 THEN 'fixture_count=7, want 8' END, CASE WHEN d = 0 THEN 'decisions must be {_DECISIONS}' END, CASE WHEN c = 0 THEN 'client_dir is required' END], lambda x: x IS NOT NULL) AS v, e, f, n, d FROM o)
SELECT o_orderkey, CASE WHEN len(v) = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN len(v) = 0 THEN 'ready' WHEN e < 2 THEN 'inspect-client-validator' WHEN n = 0 OR d = 0 OR f = 0 THEN 'inspect-agent-decision-fixtures' ELSE 'inspect-agent-decision-client-summary' END AS agent_next_step, array_to_string(v, '; ') AS failures FROM r""")
def client_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as client summaries whose fields vary with their keys."""
    t = A.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    document = F.concat(
        F.lit('{"a":1'),
        F.when(k % 5 == 0, ',"status":"failed"').when(k % 5 == 1, "").otherwise(',"status":"passed"'),
        F.when(c % 3 == 0, ',"validator_exit_code":1').when(c % 3 == 1, "").otherwise(',"validator_exit_code":0'),
        F.when(k % 7 == 0, F.concat(F.lit(',"failures":["f'), k, F.lit('"]'))).when(k % 7 == 1, ',"failures":"none"').otherwise(',"failures":[]'),
        F.when(c % 4 == 0, ',"fixture_count":7').otherwise(',"fixture_count":8'),
        F.when(c % 6 == 0, ',"decisions":["accept"]').otherwise(f',"decisions":{_LIST}'),
        F.when(k % 11 == 0, ',"client_dir":""').otherwise(',"client_dir":"c"'),
        F.lit(',"fixture_dir":"f", "result_json":"r"}'),
    )
    rolled = responses.roll_up(t.select("o_orderkey", document.alias("document")), "client")
    return rolled.select("o_orderkey", "status", "agent_next_step", F.array_join("failures", "; ").alias("failures"))


@query(f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS u, o_custkey % 3 AS i, o_custkey % 5 AS g, o_orderkey % 6 AS a, 'v' || o_custkey AS ref, o_orderkey % 7 AS d FROM orders),
r AS (SELECT o_orderkey, u, i, g, a, d, list_filter([CASE WHEN u = 0 THEN 'installer_url is required' WHEN u = 1 THEN 'installer_url must include release_ref' END, CASE WHEN i = 0 THEN 'helper_refs.install=x, want ' || ref WHEN i = 1 THEN 'helper_refs.install=missing, want ' || ref END,
CASE WHEN i = 1 THEN 'helper_refs.consumer=missing, want ' || ref END, CASE WHEN d = 0 THEN 'decisions must be {_DECISIONS}' END, CASE WHEN g = 0 THEN 'agent_next_steps.client=stop, want ready' END, CASE WHEN a = 0 THEN 'agent_next_steps.consumer=missing, want ready' END], lambda x: x IS NOT NULL) AS v FROM o)
SELECT o_orderkey, CASE WHEN len(v) = 0 THEN 'passed' ELSE 'failed' END AS status, CASE WHEN len(v) = 0 THEN 'ready' WHEN u < 2 OR i < 2 THEN 'inspect-release-installer' WHEN g = 0 THEN 'inspect-release-client-response' WHEN a = 0 THEN 'inspect-release-consumer-response' ELSE 'inspect-agent-decision-fixtures' END AS agent_next_step, array_to_string(v, '; ') AS failures FROM r""")
def release_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as release summaries."""
    t = A.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ref = F.concat(F.lit('"v'), c, F.lit('"'))
    url = F.when(k % 4 == 0, "").when(k % 4 == 1, "https://h/other").when(k % 4 == 2, "folder").otherwise(F.concat(F.lit("https://h/v"), c, F.lit("/i")))
    document = F.concat(
        F.lit('{"schema_version":1,"status":"passed","failures":[],"fixture_count":8,"release_ref":'), ref, F.lit(',"installer_url":"'), url, F.lit('"'),
        F.when(c % 3 == 0, F.concat(F.lit(',"helper_refs":{"install":"x","consumer":'), ref, F.lit("}"))).when(c % 3 == 1, ',"helper_refs":[]').otherwise(F.concat(F.lit(',"helper_refs":{"install":'), ref, F.lit(',"consumer":'), ref, F.lit("}"))),
        F.when(k % 7 == 0, ',"decisions":null').otherwise(f',"decisions":{_LIST}'),
        F.lit(',"agent_next_steps":{"client":"'), F.when(c % 5 == 0, "stop").otherwise("ready"), F.lit('"'), F.when(k % 6 == 0, "").otherwise(',"consumer":"ready"'), F.lit("}}"),
    )
    rolled = responses.roll_up(t.select("o_orderkey", document.alias("document")), "release")
    return rolled.select("o_orderkey", "status", "agent_next_step", F.array_join("failures", "; ").alias("failures"))


@query("""WITH o AS (SELECT o_custkey AS manifest, o_orderkey AS pos, o_custkey || '[' || o_orderkey || ']' AS label, 'p' || o_orderkey % 3 AS path, o_orderkey % 2 = 0 AS own, ['ready','manual_review_internal','apply_fix_suggestions','needs_better_input','odd'][o_orderkey % 5 + 1] AS a,
CASE WHEN o_orderkey % 3 = 0 THEN 'passed' ELSE 'failed' END AS st, CASE WHEN o_custkey % 4 = 0 THEN 'accept' ELSE ['accept','manual-review','apply-repair','needs-better-input','odd'][o_orderkey % 5 + 1] END AS want, o_custkey % 2 = 0 AS kind_ok, o_custkey % 3 AS c, o_custkey % 5 = 0 AS raw FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY manifest, path ORDER BY pos) AS nth, CASE WHEN st = 'passed' AND a = 'ready' THEN 'accept' WHEN a = 'manual_review_internal' THEN 'manual-review' WHEN a = 'apply_fix_suggestions' THEN 'apply-repair' WHEN a = 'needs_better_input' THEN 'needs-better-input' WHEN st = 'failed' THEN 'repair-generated-test' ELSE 'inspect' END AS decision FROM o),
f AS (SELECT *, list_filter([
CASE WHEN a = 'odd' THEN label || ': action: expected one of ready, manual_review_internal, manual_review_environment, manual_review_external_service, apply_fix_suggestions, needs_better_input' END,
CASE WHEN want = 'odd' THEN label || ': expected_decision: expected one of accept, manual-review, apply-repair, needs-better-input' END,
CASE WHEN nth > 1 THEN label || ': duplicate fixture path ' || path END,
CASE WHEN st = 'passed' THEN path || ': status/action=passed/' || a || ', manifest=failed/' || a END,
CASE WHEN decision <> want THEN path || ': decision=' || decision || ', expected=' || want END,
CASE WHEN NOT own AND raw THEN path || ': real project fixture must not contain raw_output' END,
CASE WHEN a = 'apply_fix_suggestions' AND c = 1 THEN path || ': apply_fix_suggestions requires run_result.fix_suggestions[]' WHEN a = 'apply_fix_suggestions' AND c = 2 THEN path || ': apply_fix_suggestions requires at least one repair_task' END,
CASE WHEN a = 'needs_better_input' AND kind_ok THEN path || ': needs_better_input requires metadata.next_action_kind=coverage_target_miss' END,
CASE WHEN a = 'needs_better_input' AND c <> 1 THEN path || ': next_action_reason must match needs_better_input_reason' END,
CASE WHEN own AND a = 'manual_review_internal' AND NOT kind_ok THEN path || ': manual_review_* requires metadata.next_action_kind=manual_review' END,
CASE WHEN own AND a = 'manual_review_internal' AND c <> 0 THEN path || ': next_action_reason must match manual_review_reason' END], lambda x: x IS NOT NULL) AS v FROM n)
SELECT manifest, pos, path, decision, 'r' || c AS reason, array_to_string(v, '; ') AS failures FROM f""")
def fixture_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as fixtures, customers as the lists that name them."""
    t = A.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    action = _pick(k % 5, "ready", "manual_review_internal", "apply_fix_suggestions", "needs_better_input", "odd")
    want = F.when(c % 4 == 0, "accept").otherwise(_pick(k % 5, "accept", "manual-review", "apply-repair", "needs-better-input", "odd"))
    kind = F.when(k % 2 == 0, "validate_coverage_task").otherwise("real_project_agent_loop")
    entry = F.format_string('{"kind":"%s","source":"synthetic","status":"failed","action":"%s","expected_decision":"%s","client_expectation":"c","path":"p%d"}', kind, action, want, k % 3)
    suggestions = F.when(c % 3 == 0, '[{"repair_task":{}}]').when(c % 3 == 1, "[]").otherwise("[{}]")
    payload = F.concat(
        F.format_string('{"status":"%s","action":"%s","run_result":{"fix_suggestions":%s', F.when(k % 3 == 0, "passed").otherwise("failed"), action, suggestions),
        F.when(c % 5 == 0, ',"raw_output":"x"}').otherwise("}"),
        F.format_string(',"metadata":{"next_action_kind":"%s","next_action_reason":"r%d","manual_review_kind":"m","manual_review_reason":"r0","needs_better_input_reason":"r1"}}', F.when(c % 2 == 0, "manual_review").otherwise("coverage_target_miss"), c % 3),
    )
    rows = t.select(c.alias("manifest"), k.alias("pos"), F.format_string("%d[%d]", c, k).alias("label"), entry.alias("entry"), payload.alias("payload"))
    return responses.fixtures(rows).select("manifest", "pos", "path", "decision", "reason", F.array_join("failures", "; ").alias("failures"))


@query("""WITH o AS (SELECT o_orderkey AS artifact, o_custkey % 5 AS a, o_orderkey % 3 AS b, o_custkey % 7 AS s, o_orderkey % 4 AS x, o_custkey % 2 AS g, o_orderkey % 10 <> 0 AS there FROM orders)
SELECT artifact, CASE WHEN NOT there THEN 'missing artifact' WHEN a <> 0 AND a - 1 <> b THEN 'expected_action="a' || (a - 1) || '", want "a' || b || '"' WHEN s = 0 AND b <> 0 THEN 'expected_failed_section="s0", want "s' || b || '"' WHEN x < 2 AND x <> a THEN 'expected_exit_code=' || x || ', want ' || a WHEN g = 1 AND b = 2 THEN 'missing expected_section_signal s:g1' END AS mismatch FROM o""")
def artifact_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as artifacts, all expected and nine of ten there."""
    t = A.table(spark, sf_dir, "orders")
    k, c, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None)
    signal = lambda text: F.array(F.struct(F.lit("s").alias("section"), text.alias("action")))
    empty = F.array().cast("array<struct<section:string,action:string>>")
    want = t.select(
        k.alias("artifact"), F.lit("f").alias("action_field"), F.when(c % 5 != 0, F.concat(F.lit("a"), c % 5 - 1)).alias("expected_action"), F.when(c % 7 == 0, "s0").alias("expected_failed_section"),
        F.when(k % 4 < 2, (k % 4).cast("int")).otherwise(none).alias("expected_exit_code"), F.when(c % 2 == 1, signal(F.lit("g1"))).otherwise(empty).alias("signals"),
    )
    have = t.where(k % 10 != 0).select(
        k.alias("artifact"), F.lit("f").alias("action_field"), F.concat(F.lit("a"), k % 3).alias("action"), F.concat(F.lit("s"), k % 3).alias("failed_section"), (c % 5).cast("string").alias("exit_code"), signal(F.when(k % 3 == 2, "g2").otherwise("g1")).alias("signals")
    )
    return responses.artifact_mismatch(want, have).select("artifact", "mismatch")


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_partkey % 7 AS k, ['go','python','javascript','java','rust'][p_size % 5 + 1] AS l FROM part),
w AS (SELECT p_partkey, k, n, l, CASE l WHEN 'python' THEN 'object()' WHEN 'javascript' THEN '{}' WHEN 'java' THEN '"__other__"' WHEN 'rust' THEN 'Some(0)' ELSE '1' END AS other FROM p)
SELECT p_partkey, 'x' AS param, CASE k WHEN 0 THEN '' || n WHEN 1 THEN '' || (n + 1) WHEN 3 THEN other WHEN 5 THEN '"__other__"' WHEN 6 THEN CASE l WHEN 'python' THEN 'None' WHEN 'rust' THEN 'None' WHEN 'javascript' THEN 'undefined' ELSE 'null' END END AS value FROM w WHERE k NOT IN (2, 4)
UNION ALL SELECT p_partkey, 'x', CASE l WHEN 'python' THEN 'False' ELSE 'false' END FROM w WHERE k = 2
UNION ALL SELECT p_partkey, 'a', '' || (n - 1) FROM w WHERE k = 4
UNION ALL SELECT p_partkey, 'b', other FROM w WHERE k = 4
UNION ALL SELECT p_partkey, 'done', CASE l WHEN 'python' THEN 'True' ELSE 'true' END FROM w""")
def hint_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as tasks with hints of seven forms; of two values for one parameter the later wins."""
    t, n = A.table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    k = F.col("p_partkey") % 7
    hint = (
        F.when(k == 0, F.concat(F.lit("x == "), n)).when(k == 1, F.concat(F.lit("try `x > "), n, F.lit("` here"))).when(k == 2, "x == 7 && !x").when(k == 3, "x !== null;")
        .when(k == 4, F.concat(F.lit("`a < "), n, F.lit(" and b is not None` holds"))).when(k == 5, "x != 'word'").otherwise("x = undefined,")
    )
    hint = F.when(k == 5, 'x != "word"').otherwise(hint)
    language = _pick(F.col("p_size") % 5, "go", "python", "javascript", "java", "rust")
    tasks = t.select("p_partkey", language.alias("language"), F.array(F.lit("some words, no condition"), hint).alias("suggested_inputs"), F.array(F.lit("done")).alias("missing_branches"))
    return conditions.task_inputs(tasks, ["p_partkey"])


@query("""WITH s AS (SELECT o_custkey AS run_id, o_orderkey AS pos, o_orderpriority AS name, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'passed' END AS status, o_orderkey % 4 AS code FROM orders),
r AS (SELECT run_id, count(*) FILTER (status = 'failed') AS failed_count, string_agg('| ' || name || ' | ' || status || ' | ' || code || ' |', chr(10) ORDER BY pos) AS body FROM s GROUP BY 1)
SELECT run_id, CASE WHEN failed_count > 0 THEN 'failed' ELSE 'passed' END AS overall_status, failed_count, 'Overall: ' || CASE WHEN failed_count > 0 THEN 'failed' ELSE 'passed' END || ', failed: ' || failed_count || chr(10) || chr(10) || '| section | status | exit code |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS markdown FROM r""")
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sections, customers as the runs that are reported."""
    t = A.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("passed")
    sections = t.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"), status.alias("status"), (F.col("o_orderkey") % 4).alias("exit_code"))
    return sinks.section_reports(sections, ["run_id"]).select("run_id", "overall_status", "failed_count", "markdown")


@query("""WITH RECURSIVE w(file, m) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT w.file, CAST(w.m // 2 AS BIGINT) FROM w WHERE w.m % 4 <> 0),
t AS (SELECT file, max(m) AS m FROM w JOIN part ON p_partkey = m WHERE m % 4 = 0 GROUP BY 1)
SELECT 'src/u' || p_partkey || '.ts' AS file, 'L' AS local, CASE WHEN m IS NULL THEN NULL WHEN m % 8 = 0 THEN 'src/lib/m' || m || '.ts' ELSE 'src/lib/m' || m || '/index.ts' END AS target, CASE WHEN m IS NOT NULL THEN 'S' END AS symbol FROM part LEFT JOIN t ON p_partkey = file""")
def import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as modules m<n> that declare S (every fourth) or pass it on from m<n/2>, and as their users u<n>."""
    t, n = A.table(spark, sf_dir, "part"), F.col("p_partkey")
    half = F.floor(n / 2).cast("string")
    inner = n % 8 == 4
    passed = F.when(n % 2 == 1, F.concat(F.lit("export * from './m"), half, F.lit("'"))).otherwise(F.concat(F.lit("export { S } from './m"), half, F.lit("';")))
    modules = t.select(F.concat(F.lit("src/lib/m"), n, F.when(inner, "/index.ts").otherwise(".ts")).alias("file"), F.when(n % 4 == 0, "export class S {}").otherwise(passed).alias("source"))
    users = t.select(F.concat(F.lit("src/u"), n, F.lit(".ts")).alias("file"), F.concat(F.lit("import { S as L } from './x/../lib/m"), n, F.lit("'")).alias("source"))
    return imports.resolve_imports(modules.unionByName(users)).select("file", "local", "target", "symbol")


#: What a validated task looks like, by the order's key modulo 16: target, preview, hints, file, framework, whether it passed, skipped, output.
_TASKS = (
    ("F{k}", "manual_review_unreachable: x", "", "a.go", "go-test", True, 1, ""),
    ("init", V.SKIP_INIT, "", "a.go", "go-test", True, 1, ""),
    (V.UNREACHABLE_TARGET, V.SKIP_TODO, "x " + V.UNREACHABLE_HINT, "a.go", "go-test", True, 1, ""),
    (" ", "manual_review_environment: disk", "", "a.py", "pytest", True, 1, ""),
    ("InitCPU", V.SKIP_TODO, "err != nil", "a.go", "go-test", True, 1, ""),
    ("SendControl", V.SKIP_TODO, "err != nil", "a.go", "go-test", True, 2, ""),
    ("UserRepo.Save{k}", V.SKIP_TODO, "gorm", "a.go", "go-test", True, 1, ""),
    (" F{k} ", "manual_review_database: x", "", "a.py", "pytest", True, 1, ""),
    ("Producer.Send", "", "", "a.go", "go-test", False, 0, "dial: connection refused"),
    ("A.#x{k}", "manual_review_private: y\n// public_entry_candidates: run, go ,", "", "a.js", "jest", True, 0, ""),
    ("A.#x", "instance.#x", "", "a.js", "jest", False, 0, "Private field '#x'"),
    ("F{k}", "manual_review_internal: x", "", "a.kt", "JUnit", True, 0, ""),
    ("F{k}", "manual_review_internal: x", "", "a.PY", "", True, 0, ""),
    ("", "manual_review_internal: x", "", "a.ts", "vitest", True, 0, ""),
    ("", "manual_review_no_runtime: types", "", "a.ts", "vitest", True, 0, ""),
    (" F{k} ", "", "", "a.go", " Go-Test ", True, 0, ""),
)
#: Kind and reason of each of them; the last has none of its own.
_REVIEWS = (
    ("unreachable", V.REASON_UNREACHABLE, "F{k}"), ("unreachable", V.REASON_INIT, ""), ("unreachable", V.REASON_REMOTE_IP, ""), ("environment", V.REASON_ENVIRONMENT, "coverage task"), ("environment", V.REASON_ENVIRONMENT_OF["InitCPU"], ""),
    ("protocol", V.REASON_PROTOCOL, "SendControl"), ("database", V.REASON_REPOSITORY, "UserRepo.Save{k}"), ("database", V.REASON_DATABASE, "F{k}"), ("external_service", V.REASON_EXTERNAL, "Producer.Send"), ("private", V.REASON_PRIVATE, "A.#x{k}"),
    ("private", V.REASON_PRIVATE_FAILED, "A.#x"), ("internal", V.REASON_INTERNAL_JAVA, "F{k}"), ("internal", V.REASON_INTERNAL_PYTHON, "F{k}"), ("internal", V.REASON_INTERNAL_SCRIPT, "target"), ("no_runtime", V.REASON_NO_RUNTIME, "file"),
)


def _metadata_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = "[" + ", ".join(quoted(k) for k, _, _ in _REVIEWS) + ", NULL]"
    texts = "[" + ", ".join(quoted(t.replace("{target}", n)) for _, t, n in _REVIEWS) + ", NULL]"
    frameworks = "[" + ", ".join(quoted(t[4].strip().lower()) for t in _TASKS) + "]"
    each = ", ".join(f"CASE WHEN kind = '{k}' THEN why END AS {reason}" for k, (_, reason) in V.REVIEW_KEYS.items())
    missed = quoted(V.REASON_MISSED.replace("{target}", "F{k}").replace("{range}", "5-7"))
    return f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 16 AS INTEGER) + 1 AS i, o_custkey % 3 AS c FROM orders),
r AS (SELECT k, i, c, {kinds}[i] AS kind, replace({texts}[i], '{{k}}', CAST(k AS VARCHAR)) AS why, {frameworks}[i] AS framework, CASE WHEN i = 16 AND c > 0 THEN c = 1 END AS hit FROM o),
m AS (SELECT *, CASE WHEN NOT hit THEN replace({missed}, '{{k}}', CAST(k AS VARCHAR)) END AS missed FROM r)
SELECT k AS o_orderkey, CASE WHEN kind IS NOT NULL THEN 'manual_review_' || kind WHEN NOT hit THEN 'needs_better_input' ELSE 'ready' END AS action, CASE WHEN i IN (9, 11) OR NOT coalesce(hit, true) THEN 'failed' ELSE 'passed' END AS status,
  framework, CASE WHEN c = 0 THEN framework <> '' END AS hit_supported, hit AS target_hit, CASE WHEN hit THEN '5,6,7' WHEN NOT hit THEN '5,6,7' END AS target_lines, missed AS coverage_miss_reason, {each},
  CASE WHEN i = 10 THEN 'run;go' END AS candidates, CASE WHEN kind IS NOT NULL THEN 'manual_review' WHEN NOT hit THEN 'coverage_target_miss' END AS next_action_kind, coalesce(why, missed) AS next_action_reason,
  missed AS needs_better_input_reason, kind AS manual_review_kind, why AS manual_review_reason FROM m"""


@query(_metadata_sql())
def validation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as validated tasks of sixteen kinds, with all keys of their metadata."""
    from gapfeed.operators import metadata, validation

    key, c = F.col("o_orderkey"), F.col("o_custkey") % 3
    of = lambda n: F.replace(F.element_at(F.array(*[F.lit(t[n]) for t in _TASKS]), (key % 16 + 1).cast("int")), F.lit("{k}"), key.cast("string"))
    number = lambda n: F.element_at(F.array(*[F.lit(t[n]) for t in _TASKS]), (key % 16 + 1).cast("int"))
    t = A.table(spark, sf_dir, "orders").select(
        "o_orderkey", of(0).alias("target"), of(1).alias("preview"), of(2).alias("hints"), of(3).alias("file"), of(4).alias("framework"), F.when(number(5), "pass").otherwise("fail").alias("status"), number(6).alias("skipped"), of(7).alias("raw_output"),
        F.lit("").alias("errors"), F.lit(" 5-7").alias("line_range"), (c == 0).alias("coverage_requested"), F.lit("a_test").alias("test_file"), F.when((key % 16 == 15) & (c > 0), "cov.out").alias("coverage_report"),
        F.when(c == 1, F.array(F.lit(5), F.lit(6), F.lit(7))).otherwise(F.array(F.lit(5))).alias("hit_lines"), F.when(c == 2, F.array(F.lit(6), F.lit(7))).alias("missed_lines"),
    )
    t = t.withColumns({"run_status": validation.base_status(F.col("status")), "action": validation.base_action(F.col("status"), F.lit(""), F.lit(1), F.lit(0))})
    m = metadata.annotated(t)
    names = ["coverage_miss_reason", *[r for _, r in V.REVIEW_KEYS.values()], "next_action_kind", "next_action_reason", "needs_better_input_reason", "manual_review_kind", "manual_review_reason"]
    return m.select(
        "o_orderkey", "action", "status", "metadata.framework", F.col("metadata.coverage_target_hit_supported").alias("hit_supported"), F.col("metadata.coverage_target_hit").alias("target_hit"),
        F.array_join("metadata.coverage_target_lines", ",").alias("target_lines"), F.array_join("metadata.public_entry_candidates", ";").alias("candidates"), *[f"metadata.{n}" for n in names],
    )


def _valid_document(kind: str) -> dict:
    """A document of a kind that breaks no rule."""
    plain = {"text": "x/y", "any": {}, "none": [], "decisions": list(V.DECISIONS)}
    doc: dict = {}
    for path, check in V.DOCUMENTS[kind].items():
        parent, _, field = path.rpartition(".")
        value = plain[check] if check in plain else "u" + check[3:] if check.startswith("in:") else "x/y/" + check.split("/", 1)[1] if "below:" in check else json.loads(check.removeprefix("text "))
        (doc[parent] if parent else doc)[field] = {} if value == {} else value
    return doc


def _changed_documents() -> list[str]:
    """Each kind's document as it is, without its status, of another version, with a field too many, with failures."""
    out = []
    for kind in V.DOCUMENTS:
        doc = _valid_document(kind)
        for changed in (doc, {k: v for k, v in doc.items() if k != "status"}, doc | {"schema_version": 2}, doc | {"more{k}": 1}, doc | {"failures": ["f{k}"]}):
            out.append(json.dumps(changed))
    return out


@query(f"""WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % {len(V.DOCUMENTS)} AS INTEGER) + 1 AS d, o_custkey % 5 AS c FROM orders),
m AS (SELECT k, unnest(CASE c WHEN 1 THEN ['missing required field status', 'status must be ' || [{', '.join("'" + json.loads(f["status"]) + "'" for f in V.DOCUMENTS.values())}][d]]
  WHEN 2 THEN ['schema_version must be 1'] WHEN 3 THEN ['unexpected field more' || k] WHEN 4 THEN ['failures must be an empty array'] ELSE [] END) AS message FROM o)
SELECT k AS o_orderkey, message FROM m""")
def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents of eight kinds, four in five of which break a rule."""
    from gapfeed.operators import document_rules

    k = F.col("o_orderkey")
    n, c = k % len(V.DOCUMENTS), F.col("o_custkey") % 5
    text = F.element_at(F.array(*[F.lit(d) for d in _changed_documents()]), (n * 5 + c + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(d) for d in V.DOCUMENTS]), (n + 1).cast("int"))
    docs = A.table(spark, sf_dir, "orders").select(k.alias("doc_id"), kind.alias("kind"), F.replace(text, F.lit("{k}"), k.cast("string")).alias("doc"))
    return document_rules.violations(docs, document_rules.rules(spark)).select(F.col("doc_id").alias("o_orderkey"), "message")
