"""Roll-ups and checks of JSON documents: what each one violates, and what to look at next."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators.validation import agent_decision, section_decision
from gapfeed.sources.json_values import Json, is_truthy


def _unless(holds: Column, message: Column | str) -> Column:
    """A list of this message where a condition is false or null, else an empty one."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(holds, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(text, F.lit(""))))


def _filled(d: Json, path: str) -> Column:
    return F.coalesce(d.text(path), F.lit("")) != ""


def _version(d: Json) -> Column:
    return _unless(d.equals("schema_version", 1), "schema_version must be 1")


def _required(d: Json, *paths: str) -> list[Column]:
    return [_unless(_filled(d, p), f"{p} is required") for p in paths]


def _status(d: Json) -> Column:
    return _unless(d.text("status") == "passed", F.concat(F.lit("summary status is "), d.shown_or("status", "missing")))


def _exit_codes(d: Json, *paths: str) -> list[Column]:
    return [_unless(d.equals(p, 0), F.concat(F.lit(f"{p}="), d.printed(p))) for p in paths]


def _nested(d: Json, what: str) -> Column:
    each = F.transform(d.texts("failures"), lambda x: F.concat(F.lit(f"{what} failure: "), F.coalesce(x, F.lit("null"))))
    return F.when(d.is_list("failures"), each).otherwise(F.array(F.lit("failures must be an array")))


def _decisions(d: Json, expected: list[str]) -> list[Column]:
    count = _unless(d.equals("fixture_count", len(expected)), F.concat(F.lit("fixture_count="), d.printed("fixture_count"), F.lit(f", want {len(expected)}")))
    written = "[" + ",".join(f'"{x}"' for x in expected) + "]"
    return [count, _unless(F.to_json(d.at("decisions")) == written, "decisions must be " + ",".join(expected))]


def _refs(d: Json, path: str) -> Column:
    return _unless(d.same(path, "release_ref"), F.concat(F.lit(f"{path}="), d.shown_or(path, "missing"), F.lit(", want "), d.shown_or("release_ref", "release_ref")))


def _ready(d: Json, path: str) -> Column:
    return _unless(d.text(path) == "ready", F.concat(F.lit(f"{path}="), d.shown_or(path, "missing"), F.lit(", want ready")))


def _client(d: Json, expected: list[str]) -> list[Column]:
    return [_status(d), *_exit_codes(d, "validator_exit_code"), _nested(d, "client fixture"), *_decisions(d, expected), *_required(d, "client_dir", "fixture_dir", "result_json")]


def _consumer(d: Json, expected: list[str]) -> list[Column]:
    return [_version(d), *_required(d, *V.CONSUMER_REQUIRED), _status(d), _nested(d, "consumer smoke"), *_exit_codes(d, *V.CONSUMER_EXIT_CODES), *_decisions(d, expected)]


def _release(d: Json, expected: list[str]) -> list[Column]:
    url = F.coalesce(d.text("installer_url"), F.lit(""))
    within = ~url.rlike("^https?://") | F.contains(url, d.shown_or("release_ref", ""))
    return [
        _version(d), *_required(d, "release_ref", "installer_url"), _unless(within, "installer_url must include release_ref"), _status(d), _nested(d, "release smoke"),
        _refs(d, "helper_refs.install"), _refs(d, "helper_refs.consumer"), *_decisions(d, expected), _ready(d, "agent_next_steps.client"), _ready(d, "agent_next_steps.consumer"),
    ]


_RULES = {"client": _client, "consumer": _consumer, "release": _release}


def next_step(failures: Column, kind: str) -> Column:
    """Where to look: the first step one of whose words is in any failure; ready without failures."""
    steps, last = V.NEXT_STEPS[kind]
    out = F.when(F.size(failures) == 0, "ready").otherwise(last)
    for words, step in reversed(steps):
        out = F.when(F.exists(failures, _holding(words)), step).otherwise(out)
    return out


def _holding(words: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda text: reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words])


def roll_up(docs: DataFrame, kind: str, column: str = "document", expected: list[str] | None = None) -> DataFrame:
    """Each summary document (client, consumer or release) with (status, agent_next_step, failures).

    Failures are listed in the order of the rules; a text that is no JSON object has one failure of its own.
    """
    rows = docs.withColumn("_json", F.try_parse_json(column))
    d = Json(F.col("_json"))
    found = F.concat(*_RULES[kind](d, expected or list(V.EXPECTED_DECISIONS)))
    failures = F.when(d.is_object(), found).otherwise(F.array(F.lit("document is no JSON object")))
    rows = rows.withColumn("_failures", failures)
    status = F.when(F.size("_failures") == 0, "passed").otherwise("failed")
    return rows.select(*docs.columns, status.alias("status"), next_step(F.col("_failures"), kind).alias("agent_next_step"), F.col("_failures").alias("failures"))


def action_reason(d: Json) -> Column:
    """The first reason of a document's metadata that isn't blank; else empty."""
    return F.coalesce(*[F.when(T.trim(d.text(f"metadata.{k}")) != "", T.trim(d.text(f"metadata.{k}"))) for k in V.REASON_KEYS], F.lit(""))


def _one_of(d: Json, path: str, allowed: tuple[str, ...]) -> Column:
    return _unless(d.text(path).isin(*allowed), F.concat(F.col("label"), F.lit(f": {path}: expected one of " + ", ".join(allowed))))


def _says(holds: Column, message: str) -> Column:
    return _unless(holds, F.concat(F.col("path"), F.lit(message)))


def _reasons(d: Json, rule: str, kind: str, own: str) -> list[Column]:
    m = lambda k: f"metadata.{k}"
    return [
        _says(d.is_object("metadata"), ": metadata: expected object"),
        _says(d.text(m("next_action_kind")) == kind, f": {rule} requires metadata.next_action_kind={kind}"),
        _says(_filled(d, m("next_action_reason")), f": {rule} requires metadata.next_action_reason"),
        *([_says(_filled(d, m("manual_review_kind")), f": {rule} requires metadata.manual_review_kind")] if own == "manual_review_reason" else []),
        _says(_filled(d, m(own)), f": {rule} requires metadata.{own}"),
        _says(d.same(m("next_action_reason"), m(own)), f": next_action_reason must match {own}"),
    ]


def fixtures(rows: DataFrame) -> DataFrame:
    """Documents held against the entries that list them.

    rows: manifest, pos, label, entry (JSON of the list), payload (JSON of the file; null: no such file). Adds path,
    decision, reason and failures: closed vocabularies, repeated paths, status, action and decision against the
    entry, keys that must not appear, and what each kind of action requires.
    """
    r = rows.withColumn("_entry", F.try_parse_json("entry")).withColumn("_payload", F.try_parse_json("payload"))
    e, p = Json(F.col("_entry")), Json(F.col("_payload"))
    r = r.withColumn("path", e.text("path")).withColumn("_nth", F.row_number().over(Window.partitionBy("manifest", "path").orderBy("pos")))
    path, status, action, kind = F.coalesce("path", F.lit("")), p.text("status"), F.coalesce(p.text("action"), F.lit("")), F.coalesce(e.text("kind"), F.lit(""))
    decision = agent_decision(F.coalesce(status, F.lit("")), action)
    manual = F.startswith(action, F.lit("manual_review_"))
    none = F.array().cast("array<string>")
    listed = F.concat(
        _unless(e.is_object(), F.concat(F.col("label"), F.lit(": expected object"))),
        *[_one_of(e, k, allowed) for k, allowed in V.ENTRY_VOCABULARIES.items()],
        _unless(_filled(e, "client_expectation"), F.concat(F.col("label"), F.lit(": client_expectation: expected non-empty string"))),
        _unless(path != "", F.concat(F.col("label"), F.lit(": path must be a non-empty string"))),
        _unless((path == "") | (F.col("_nth") == 1), F.concat(F.col("label"), F.lit(": duplicate fixture path "), path)),
    )
    agrees = p.same_as("status", e) & p.same_as("action", e)
    differ = F.concat(path, F.lit(": status/action="), p.printed("status"), F.lit("/"), p.printed("action"), F.lit(", manifest="), e.printed("status"), F.lit("/"), e.printed("action"))
    suggestions = p.items("run_result.fix_suggestions")
    repairs = [
        _says(p.is_object("run_result"), ": run_result: expected object"),
        _says(F.size(suggestions) > 0, ": apply_fix_suggestions requires run_result.fix_suggestions[]"),
        _says((F.size(suggestions) == 0) | F.exists(suggestions, lambda x: is_truthy(F.try_variant_get(x, "$.repair_task", "variant"))), ": apply_fix_suggestions requires at least one repair_task"),
    ]
    legacy = _says(~p.truthy("metadata.coverage_miss_reason") | p.same("metadata.next_action_reason", "metadata.coverage_miss_reason"), ": next_action_reason must match legacy coverage_miss_reason when present")
    held = F.concat(
        _unless(agrees, differ),
        _unless(decision == e.text("expected_decision"), F.concat(path, F.lit(": decision="), decision, F.lit(", expected="), e.printed("expected_decision"))),
        _says(~((kind == "real_project_agent_loop") & p.has_key("raw_output")), ": real project fixture must not contain raw_output"),
        F.when(action == "apply_fix_suggestions", F.concat(*repairs)).otherwise(none),
        F.when(action == "needs_better_input", F.concat(*_reasons(p, "needs_better_input", "coverage_target_miss", "needs_better_input_reason"), legacy)).otherwise(none),
        F.when(manual & (decision != "manual-review"), F.array(F.concat(path, F.lit(": manual_review_* must map to manual-review")))).otherwise(none),
        F.when((kind == "validate_coverage_task") & manual, F.concat(*_reasons(p, "manual_review_*", "manual_review", "manual_review_reason"))).otherwise(none),
    )
    absent = F.when(path == "", none).when(F.col("payload").isNull(), F.array(F.concat(path, F.lit(": fixture file does not exist")))).otherwise(F.array(F.concat(path, F.lit(": no JSON"))))
    there = (path != "") & F.col("_payload").isNotNull()
    return r.select(*[c for c in rows.columns if c != "path"], "path", F.when(there, decision).alias("decision"), F.when(there & (action_reason(p) != ""), action_reason(p)).alias("reason"), F.concat(listed, F.when(there, held).otherwise(absent)).alias("failures"))


def artifact_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """The first thing in which an artifact differs from what its manifest expects; null if it agrees.

    expected: artifact, action_field, expected_action, expected_failed_section, expected_exit_code int, signals;
    actual: artifact, action_field, action, failed_section, exit_code string, signals; signals are lists of
    (section, action). Empty or null expectations expect nothing; an artifact without actual values is missing.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    a = actual.select("artifact", F.lit(True).alias("_there"), blank("action_field").alias("_field"), blank("action").alias("_action"), blank("failed_section").alias("_section"), blank("exit_code").alias("_code"), F.coalesce("signals", F.array().cast("array<struct<section:string,action:string>>")).alias("_signals"))
    r = expected.join(a, "artifact", "left")
    differs = lambda want, have: (blank(want) != "") & (F.col(want) != F.col(have))
    said = lambda what, want, have: F.format_string(what + '="%s", want "%s"', F.col(want), F.col(have))
    lost = F.get(F.filter("signals", lambda s: ~F.exists("_signals", lambda x: (x["section"] == s["section"]) & (x["action"] == s["action"]))), 0)
    code = F.col("expected_exit_code").cast("string")
    mismatch = (
        F.when(F.col("_there").isNull(), "missing artifact")
        .when(differs("action_field", "_field"), said("action_field", "action_field", "_field"))
        .when(differs("expected_action", "_action"), said("expected_action", "expected_action", "_action"))
        .when(differs("expected_failed_section", "_section"), said("expected_failed_section", "expected_failed_section", "_section"))
        .when(code != F.col("_code"), F.concat(F.lit("expected_exit_code="), code, F.lit(", want "), F.col("_code")))
        .when(lost.isNotNull(), F.concat(F.lit("missing expected_section_signal "), lost["section"], F.lit(":"), lost["action"]))
    )
    return r.select(*expected.columns, mismatch.alias("mismatch"))


def failed_sections(sections: DataFrame) -> DataFrame:
    """The sections that failed, with what to look at."""
    return sections.where(F.col("status") == "failed").withColumn("decision", section_decision(F.col("name")))
