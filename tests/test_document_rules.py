"""Documents against rules as rows."""

import json

import pytest

from gapfeed.functions import vocabulary as V
from gapfeed.operators import document_rules as R


def valid(kind):
    doc = {}
    for path, check in V.DOCUMENTS[kind].items():
        parent, _, field = path.rpartition(".")
        into = doc.setdefault(parent, {}) if parent else doc
        value = {"text": "x/y", "any": {}, "none": [], "decisions": list(V.DECISIONS)}.get(check)
        if value is None:
            value = "u" + check[3:] if check.startswith("in:") else "x/y/" + check.split("/", 1)[1] if "below:" in check else json.loads(check.removeprefix("text "))
        if not (path == "evidence" and "evidence" in doc):
            into[field] = value
    return doc


@pytest.fixture(scope="module")
def found(spark):
    docs = []
    for kind in V.DOCUMENTS:
        good = valid(kind)
        docs.append((f"{kind}", kind, json.dumps(good)))
        docs.append((f"{kind}/status", kind, json.dumps({k: v for k, v in good.items() if k != "status"})))
        docs.append((f"{kind}/more", kind, json.dumps({**good, "zz": 1, "schema_version": 1.0, "failures": ["no"], "fixture_count": "8"})))
    ci, response = valid("client-ci-summary"), valid("client-ci-response")
    docs += [
        ("path", "client-ci-summary", json.dumps({**ci, "client_dir": "a/../b", "result_json": "./b//agent-decision-fixtures-result.json", "result_schema": 7})),
        ("deep", "client-ci-response", json.dumps({**response, "evidence": {**response["evidence"], "decisions": ["accept"], "q": 1, "client_dir": ""}})),
        ("flat", "client-ci-response", json.dumps({**response, "evidence": []})),
        ("bad", "client-ci-response", "{"), ("list", "client-ci-response", "[1]"), ("null", "client-ci-response", None), ("other", "no such kind", "{}"),
    ]
    rows = R.violations(spark.createDataFrame(docs, "doc_id string, kind string, doc string"), R.rules(spark)).collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add(r.message)
    return out


def test_every_kind(found):
    for kind, fields in V.DOCUMENTS.items():
        assert kind not in found
        said = json.loads(fields["status"])
        assert found[f"{kind}/status"] == {"missing required field status", f"status must be {said}"}
        want = {"unexpected field zz", "failures must be an empty array"}
        want |= {"fixture_count must be 8"} if "fixture_count" in fields else {"unexpected field fixture_count"}
        assert found[f"{kind}/more"] == want


def test_single_rules(found):
    assert found["path"] == {"result_schema: expected non-empty string", "result_schema must be x/y/docs/fixtures/agent-decision-fixtures-result.schema.json"}
    assert found["deep"] == {"evidence.decisions must be " + ",".join(V.DECISIONS), "evidence unexpected field q", "evidence.client_dir: expected non-empty string"}
    inner = [p.split(".")[1] for p in V.DOCUMENTS["client-ci-response"] if p.startswith("evidence.")]
    assert {f"evidence missing required field {f}" for f in inner} <= found["flat"]
    assert found["bad"] == found["list"] == found["null"] == {"expected a JSON object"} and "other" not in found
