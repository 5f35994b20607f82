"""Dialects of runner output on small captured texts."""

import json

import pytest

from gapfeed.sources import results as R

JEST = """FAIL ./sum.test.js
  ● math › adds 1 + 2 to equal 3

    expect(received).toBe(expected)

    Expected: 3
    Received: 4

      4 |   expect(sum(1, 2)).toBe(3)
    at Object.<anonymous> (sum.test.js:5:15)

Tests:       1 failed, 2 passed, 1 skipped, 4 total
"""
VITEST = """ FAIL  src/sum.test.ts > sum > adds values
AssertionError: expected 4 to be 3 // Object.is equality
 ❯ src/sum.test.ts:8:18

 Tests  1 failed (2)
"""
PYTEST = """test_calc.py::test_add PASSED
test_calc.py::test_divide FAILED
test_calc.py::test_divide PASSED
test_calc.py::test_skip SKIPPED
=========== FAILURES ===========
_________ test_divide _________
    def test_divide():
>       divide(1, 0)

calc.py:7: in divide
E       ZeroDivisionError: division by zero
calc.py:9: ZeroDivisionError
====== 1 failed in 0.01s ======
"""
MOCHA = """  calc
    ✓ adds
    1) divide() should handle zero

  1 passing (9ms)
  1 failing

  1) calc
       divide() should handle zero:

      AssertionError: expected 4 to equal 3
      at Context.<anonymous> (test/calc.test.js:12:18)
"""
NODE = """# Subtest: adds values
not ok 1 - adds values
  ---
  duration_ms: 1.2
  location: 'test/sum.test.js:6:10'
  error: 'Expected values to be strictly equal:'
  expected: 3
  actual: 4
  ...
not ok 2 - all
  ---
  type: 'suite'
  ...
# tests 2
# pass 1
# fail 1
# skipped 0
# todo 1
"""
CARGO = """test tests::a ... ok
test tests::b ... FAILED
---- tests::b stdout ----
thread panicked at 'assertion failed', src/lib.rs:10:5

test result: FAILED. 1 passed; 1 failed; 0 ignored
"""
JUNIT = """Tests run: 5, Failures: 1, Errors: 1, Skipped: 1
Failed tests:
  testAdd(com.example.CalcTest)

[FAILED] com.example.Other::x
"""
GO = """=== RUN   TestAdd
    calc_test.go:42: got -1, want 0
--- FAIL: TestAdd (0.00s)
--- PASS: TestSub (0.00s)
FAIL
"""
GO_JSON = "\n".join(
    json.dumps(e)
    for e in [
        {"Action": "run", "Test": "TestA"},
        {"Action": "output", "Test": "TestA", "Output": "    a_test.go:7: got 1, want 2\n"},
        {"Action": "output", "Test": "TestA", "Output": "more\n"},
        {"Action": "fail", "Test": "TestA"},
        {"Action": "pass", "Test": "TestB"},
        {"Action": "skip", "Test": "TestC"},
    ]
)
GO_PACKAGE = "\n".join(json.dumps(e) for e in [{"Action": "build-output", "Output": "# pkg\n"}, {"Action": "build-output", "Output": "x.go:3:2: undefined: y\n"}, {"Action": "fail", "Package": "pkg"}])
BROKEN = "CACError: Unknown option `--x`\n"

CASES = {
    "jest": (JEST, (2, 1, 1, 4, "fail"), ("adds 1 + 2 to equal 3", "sum.test.js", 5, 15, "expect(received).toBe(expected)", "3", "4")),
    "vitest": (VITEST, (0, 1, 0, 1, "fail"), ("sum > adds values", "src/sum.test.ts", 8, 18, "AssertionError: expected 4 to be 3 // Object.is equality", "", "")),
    "pytest": (PYTEST, (1, 1, 1, 3, "fail"), ("test_divide", "calc.py", 9, 0, "ZeroDivisionError: division by zero", "divide(1, 0)", "")),
    "mocha": (MOCHA, (1, 1, 0, 2, "fail"), ("calc divide() should handle zero", "test/calc.test.js", 12, 18, "AssertionError: expected 4 to equal 3", "3", "4")),
    "node-test": (NODE, (1, 1, 1, 2, "fail"), ("adds values", "test/sum.test.js", 6, 10, "Expected values to be strictly equal:", "3", "4")),
    "cargo-test": (CARGO, (1, 1, 0, 2, "fail"), ("tests::b", "", 0, 0, "assertion failed", "", "")),
    "junit": (JUNIT, (2, 2, 1, 5, "fail"), ("com.example.CalcTest#testAdd", "", 0, 0, "", "", "")),
    "go-test": (GO, (1, 1, 0, 2, "fail"), ("TestAdd", "calc_test.go", 42, 0, "got -1, want 0", "", "")),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(f"{k}", k, v[0]) for k, v in CASES.items()] + [("gojson", "go-test", GO_JSON), ("gopackage", "", GO_PACKAGE), ("broken", "vitest", BROKEN), ("empty", "jest", "")]
    results, failures = R.parse_results(spark.createDataFrame(rows, "run_id string, framework string, raw string"))
    return {r.run_id: r for r in results.collect()}, failures.collect()


@pytest.mark.parametrize("name", CASES)
def test_dialect(parsed, name):
    results, failures = parsed
    r = results[name]
    assert (r.passed, r.failed, r.skipped, r.total, r.status) == CASES[name][1]
    f = min((f for f in failures if f.run_id == name), key=lambda f: f.ord)
    assert (f.test_name, f.file, f.line, f.col, f.error, f.expected, f.received) == CASES[name][2]


def test_go_events(parsed):
    results, failures = parsed
    r = results["gojson"]
    assert (r.passed, r.failed, r.skipped, r.total, r.status) == (1, 1, 1, 3, "fail")
    (f,) = [f for f in failures if f.run_id == "gojson"]
    assert (f.test_name, f.file, f.line, f.error) == ("TestA", "a_test.go", 7, "got 1, want 2\nmore")
    (f,) = [f for f in failures if f.run_id == "gopackage"]
    assert (f.test_name, f.file, f.line, f.error) == ("pkg", "x.go", 3, "2: undefined: y")
    assert results["gopackage"].status == "fail"


def test_command_error_and_empty_output(parsed):
    results, failures = parsed
    assert (results["broken"].failed, results["broken"].total, results["broken"].status) == (1, 1, "fail")
    (f,) = [f for f in failures if f.run_id == "broken"]
    assert f.test_name == "test command" and f.error.startswith("CACError")
    assert (results["empty"].total, results["empty"].status) == (0, "pass")
