"""Owners and ends by indentation against a stack."""

import random

import pytest

from gapfeed.sources import scopes


def indent(line):
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + 3 * lead.count("\t")


def python_by_stack(text):
    lines, stack, out = text.split("\n"), [], []
    for i, line in enumerate(lines):
        t, d = line.strip(), indent(line)
        while stack and t and d <= stack[-1][1]:
            stack.pop()
        if t.startswith("class "):
            stack.append((t[6:].split("(")[0].split(":")[0], d))
            continue
        if not t.startswith("def "):
            continue
        end = i + 1
        for j in range(i + 1, len(lines)):
            if lines[j].strip() and not lines[j].strip().startswith("#"):
                if indent(lines[j]) <= d:
                    break
                end = j + 1
        name = t[4:].split("(")[0]
        out.append((f"{stack[-1][0]}.{name}" if stack else name, i + 1, end))
    return out


def script_by_stack(text):
    lines, stack, out = text.split("\n"), [], []
    for i, line in enumerate(lines):
        t, d = line.strip(), indent(line)
        while stack and t.startswith("}") and d <= stack[-1][1]:
            stack.pop()
        if t.startswith("class "):
            stack.append((t[6:].split(" ")[0], d))
            continue
        if not t.startswith("function "):
            continue
        depth, opened, end = 0, False, len(lines)
        for j in range(i, len(lines)):
            for c in lines[j]:
                depth += (c == "{") - (c == "}")
                opened = opened or c == "{"
                if opened and depth == 0 and c == "}":
                    end = j + 1
                    break
            else:
                continue
            break
        name = t[9:].split("(")[0]
        out.append((f"{stack[-1][0]}.{name}" if stack and d > stack[-1][1] else name, i + 1, end))
    return out


@pytest.mark.parametrize("split", [3, 1 << 18])
def test_python_equals_a_stack(spark, split):
    rng = random.Random(1)
    files = []
    for k in range(40):
        lines = []
        for n in range(rng.randint(0, 30)):
            lead = rng.choice(["", "  ", "    ", "\t", "      "])
            lines.append(lead + rng.choice([f"class C{n}(B):", f"class D{n}:", f"def f{n}(self, a=1):", "x = 1", "# note", "", "y("]))
        files.append((f"{k}.py", "\n".join(lines)))
    got = scopes.python_scopes(spark.createDataFrame(files, "file string, source string"), split=split).collect()
    for file, text in files:
        assert sorted((s.name, s.start_line, s.end_line) for s in got if s.file == file) == sorted(python_by_stack(text))


@pytest.mark.parametrize("split", [3, 1 << 18])
def test_scripts_equal_a_stack(spark, split):
    rng = random.Random(2)
    files = []
    for k in range(40):
        lines, depth = [], 0
        for n in range(rng.randint(0, 25)):
            lead = rng.choice(["", "  ", "    ", "\t"])
            lines.append(lead + rng.choice([f"class C{n} {{", f"class D{n} {{}}", f"function f{n}(a, b) {{", f"function g{n}() {{ return {{}} }}", "}", "}" if depth else "x()", ""]))
            depth = max(0, depth + lines[-1].count("{") - lines[-1].count("}"))
            if sum(x.count("{") - x.count("}") for x in lines) < 0:
                lines.pop()
        files.append((f"{k}.js", "\n".join(lines)))
    got = scopes.script_scopes(spark.createDataFrame(files, "file string, source string"), split=split).collect()
    for file, text in files:
        assert sorted((s.name, s.start_line, s.end_line) for s in got if s.file == file) == sorted(script_by_stack(text))


def test_parameters_and_odd_files(spark):
    py = "class A:\n\tdef m(self, a: int, *, b=2, *c):\n\t\tpass\n\tdef __init__(self): pass\nasync def n(self, x):\n  return ("
    js = "export const go = async (a, b) => {\n  return '}'\n}\nlet one = q => {\n}\nfunction testX() {}\nconst v = 1"
    files = spark.createDataFrame([("a.py", py), ("b.py", None), ("c.py", "")], "file string, source string")
    assert [(s.name, s.kind, s.start_line, s.end_line, s.params) for s in scopes.python_scopes(files).orderBy("start_line").collect()] == [("A.m", "method", 2, 3, ["a", "*", "b=2", "*c"]), ("n", "function", 5, 6, ["x"])]
    files = spark.createDataFrame([("a.js", js), ("b.js", None)], "file string, source string")
    assert [(s.name, s.start_line, s.end_line, s.params) for s in scopes.script_scopes(files).orderBy("start_line").collect()] == [("go", 1, 3, ["a", "b"]), ("one", 4, 5, ["q"])]
    assert scopes.python_scopes(files.limit(0)).count() == 0


def test_no_side_of_lines_is_broadcast(spark):
    """Spark takes rows of lines for no larger than the files they come from, and would hold them in the driver."""
    files = spark.range(2).selectExpr("concat('a', id) as file", "'class A:\\n  def f(self):\\n    return 1' as source")
    for found in (scopes.python_scopes(files), scopes.script_scopes(files)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
