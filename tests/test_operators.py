"""Operators on small inputs with known answers."""

import datetime as dt

from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.operators import blocks, detection, failures, gaps, tasks, validation
from gapfeed.sources import coverage_formats as formats
from gapfeed.sources import documents, spans
from gapfeed.streaming import events


def raw(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "run_id string, raw string")


def test_go_profile(spark):
    got = formats.go_profile(raw(spark, "mode: set\nexample.com/p/calc.go:3.20,5.2 2 1\nexample.com/p/calc.go:7.1,9.2 1 0\nbad line\n")).orderBy("start_line").collect()
    assert [(r.file, r.start_line, r.end_line, r["count"], r.covered, r.statements) for r in got] == [("example.com/p/calc.go", 3, 5, 1, True, 2), ("example.com/p/calc.go", 7, 9, 0, False, 1)]


def test_report_and_file_percent_differ(spark):
    b = formats.go_profile(raw(spark, "a.go:1.1,10.2 1 1\na.go:11.1,11.9 9 0\n"))
    assert blocks.report_totals(b, ["run_id"]).first()["percent"] == 10.0
    assert round(blocks.file_percent_by_span(b, ["run_id", "file"]).first()["percent"], 2) == 90.91


def test_lcov(spark):
    got = formats.lcov(raw(spark, "DA:1,1\nSF:src/lib.rs\nDA:5,0\nDA:8,1\nDA:x\nend_of_record\nDA:9,1\nSF:b.rs\nDA:1,2\n")).orderBy("file", "start_line").collect()
    assert [(r.file, r.start_line, r.covered) for r in got] == [("b.rs", 1, True), ("src/lib.rs", 5, False), ("src/lib.rs", 8, True)]


def test_node_table(spark):
    text = "# file | line % | branch % | funcs % | uncovered lines\n# src/a.js | 66.67 | 50 | 50 | 2,5-7,9-8,x\n# all files | 83.33 | 1 | 1 |\n"
    from gapfeed.sources.lines import to_lines

    table = formats.node_table(to_lines(raw(spark, text)))
    assert table.where("file = 'src/a.js'").first()["uncovered"] == [2, 5, 6, 7, 9]
    assert formats.node_totals(table).first()["percent"] == 83.33
    assert [(r.start_line, r.end_line) for r in formats.node_blocks(table).orderBy("start_line").collect()] == [(2, 2), (5, 7), (9, 9)]


def test_coverage_py(spark):
    text = '{"files": {"a.py": {"executed_lines": [1,2,3,8], "missing_lines": [3,4,5], "summary": {"percent_covered": 80.0, "num_statements": 6, "covered_lines": 4}}}}'
    got = formats.coverage_py(raw(spark, text)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.covered) for r in got] == [(1, 3, True), (4, 5, False), (8, 8, True)]


def test_istanbul_and_jacoco(spark):
    text = '{"k": {"path": "a.ts", "statementMap": {"0": {"start": {"line": 1}, "end": {"line": 2}}, "1": {"start": {"line": 3}, "end": {"line": 3}}}, "s": {"0": 2, "7": 1}}}'
    assert [(r.file, r.start_line, r.end_line, r.covered) for r in formats.istanbul(raw(spark, text)).collect()] == [("a.ts", 1, 2, True)]
    xml = '<?xml version="1.0"?><!DOCTYPE report PUBLIC "x" "y"><report name="r"><package name="com.a"><sourcefile name="B.java"><line nr="3" mi="0" ci="2"/><line nr="4" mi="1" ci="0"/></sourcefile></package></report>'
    assert [(r.file, r.start_line, r.covered) for r in formats.jacoco(raw(spark, xml)).orderBy("start_line").collect()] == [("com/a/B.java", 3, True), ("com/a/B.java", 4, False)]


def test_read_all_takes_every_format(spark):
    rows = spark.createDataFrame([("1", " Go-Test ", "a.go:1.1,2.2 1 1"), ("2", "cargo-test", "SF:x\nDA:1,1")], "run_id string, framework string, raw string")
    assert {(r.run_id, r.framework) for r in formats.read_all(rows).collect()} == {("1", "go-test"), ("2", "cargo-test")}


def test_every_framework_is_read_or_refused(spark):
    rows = spark.createDataFrame([("1", "node-test", "# a.js | 50 | 1 | 1 | 2,5-7"), ("2", "nyc", "x"), ("3", None, "x")], "run_id string, framework string, raw string")
    assert sorted((r.file, r.start_line, r.end_line, r.covered) for r in formats.read_all(rows).collect()) == [("a.js", 2, 2, False), ("a.js", 5, 7, False)]
    assert {(r.run_id, r.error) for r in formats.read_errors(rows).collect()} == {("2", "不支持的覆盖率框架: nyc"), ("3", "不支持的覆盖率框架: ")}


def test_jacoco_totals(spark):
    source = '<package name="a.b"><sourcefile name="C.java"><line nr="1" mi="0" ci="2"/><line nr="2" mi="1" ci="0"/>{}</sourcefile></package>'
    counter = '<counter type="LINE" missed="3" covered="1"/>'
    got = formats.jacoco_totals(raw(spark, f"<report>{source.format('')}{counter}</report>", f"<report>{source.format(counter)}</report>", f"<report>{source.format('')}</report>")).orderBy("run_id").collect()
    assert [(r.total, r.hit, r.percent) for r in got] == [(4, 1, 25.0), (4, 1, 25.0), (2, 1, 50.0)]


def test_assertion_values(spark):
    cases = [("Add(1, 2) = 4, want 3", "4", "3"), ("expected 4 to be 3 // Object.is equality", "4", "3"), ("expected a to deep equal b", "a", "b"), ("got 3, want 4", "", ""), ("x = 1", "", ""), ("a\n  f() = nil, want error \n", "nil", "error")]
    rows = spark.createDataFrame(cases, "e string, g string, w string")
    got, want = failures.got_and_want(F.col("e"))
    assert all((r.got, r.want) == (r.g, r.w) for r in rows.withColumn("got", got).withColumn("want", want).collect())


def test_merge_adjacent_unites_lines_and_inputs(spark):
    rows = spark.createDataFrame([("f", 0, 4, 5, 0.9, [4, 5], ["b", "a"]), ("f", 1, 5, 6, 0.95, [5, 6], ["a", "c"]), ("f", 2, 9, 9, 0.9, [9], [])], "file string, idx int, start_line int, end_line int, confidence double, uncovered_lines array<int>, suggested_inputs array<string>")
    got = gaps.merge_adjacent(rows, ["file"]).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.idx, r.confidence, r.uncovered_lines, r.suggested_inputs) for r in got] == [(4, 6, 0, 0.95, [4, 5, 6], ["b", "a", "c"]), (9, 9, 2, 0.9, [9], [])]


def test_gap_kinds(spark):
    cases = {"  if (x > 0) {": "branch", "match x {": "branch", "return Err(e)": "error_path", "throw new Exception()": "error_path", "return 1": "return_path", "Ok(1)": "return_path", "x = 1": "statement"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", gaps.gap_type(F.col("s"))).collect())
    assert spark.createDataFrame([("if (x > 0) { y",), ("if x < 1 {",), ("if",)], "s string").select(gaps.condition(F.col("s"), "if").alias("c")).toPandas()["c"].tolist() == ["x > 0", "x < 1", "条件表达式"]
    go = spark.createDataFrame([("if", False, "x"), (None, True, "return nil, err"), (None, True, "return 1"), (None, False, "return 2"), (None, False, "x()")], "k string, r boolean, s string")
    assert go.select(gaps.go_gap_type(F.col("k"), F.col("r"), F.col("s")).alias("g")).toPandas()["g"].tolist() == ["branch", "error_path", "return_path", "return_path", "statement"]


def test_task_priority_and_order(spark):
    schema = "report int, framework string, idx int, file string, function string, kind string, line_range string, gap_type string, missing_branches array<string>, uncovered_lines array<int>, suggested_inputs array<string>, confidence double"
    rows = [
        (1, "go-test", 0, "controller/user.go", "Login", "function", "4-4", "branch", ["b"], [4], ["x"], 0.95),
        (1, "go-test", 1, "utils/calc.go", "Add", "function", "10-10", "return_path", [], [10], ["x"], 0.95),
        (1, "go-test", 2, "pkg/calc.go", "Sub", "function", "4-4", "branch", ["未覆盖 if 分支: a > b"], [4], ["x"], 0.95),
        (1, "jest", 3, "src/a.css", "", "", "entire file", "", [], [], [], 0.8),
    ]
    got = tasks.from_suggestions(spark.createDataFrame(rows, schema), "report").orderBy("rank").collect()
    assert [(r.id, r.target, r.priority) for r in got] == [("go-test-1", "Add", 111), ("go-test-2", "Sub", 103), ("go-test-3", "Login", 68)]
    assert got[1].test_file == "pkg/calc_test.go" and got[1].test_name == "TestSub" and got[1].command == "go test ./pkg"
    assert got[1].assertion_focus[-1] == "覆盖未执行行: 4" and got[1].priority_reason.endswith("置信度 0.95")


def test_test_files(spark):
    cases = [("junit", "src/main/java/com/A.java", "src/test/java/com/ATest.java"), ("junit", "com/A.java", "src/test/java/com/ATest.java"), ("pytest", "src/pkg/a.py", "tests/pkg/test_a.py"), ("pytest", "a.py", "tests/test_a.py"), ("pytest", "x/test_a.py", "x/test_a.py"), ("mocha", "src/a.js", "src/a.spec.js"), ("jest", "src/a.test.ts", "src/a.test.ts"), ("cargo-test", "src/lib.rs", "src/lib.rs"), ("go-test", "a_test.go", "a_test.go")]
    rows = spark.createDataFrame(cases, "fw string, file string, want string").withColumn("got", tasks.test_file(F.col("fw"), F.col("file"))).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_path_cost_looks_at_folders_first(spark):
    rows = spark.createDataFrame([("src/service.py", 0), ("service/a.py", -35), ("src/date_utils.py", 18), ("db/utils.py", -35)], "p string, want int")
    assert all(r.got == r.want for r in rows.withColumn("got", tasks.path_cost(F.col("p"))).collect())


def test_fix_suggestions(spark):
    schema = "test_name string, file string, line int, error string, expected string, received string, source_file string, test_file string"
    rows = [("Test Add", "calc_test.go", 7, "got 3, want 4", "", "", "calc.go", "calc_test.go"), (" ", "", 0, "integer divide by zero", "", "", "pkg/calc.py", ""), ("t", "x.js", 1, "boom", "1", "2", "x.js", None), ("u", "a.go", 1, "Cannot find module 'y'", "", "", "a.go", "")]
    got = failures.fix_suggestions(spark.createDataFrame(rows, schema)).collect()
    assert [r.category for r in got] == ["expectation_mismatch", "divide_by_zero", "expectation_mismatch", "module_resolution"]
    assert got[0].repair_id == "repair-expectation_mismatch-test-add" and got[0].context_file == "calc_test.go" and got[0].suggested_command == "go test ./..."
    assert got[1].repair_id == "repair-divide_by_zero-calc-py" and got[1].file == "pkg/calc.py" and got[1].suggested_command == "pytest" and got[1].confidence == 0.95


def test_line_hits(spark):
    b = spark.createDataFrame([("f", 0, 1, 5, True), ("f", 1, 4, 6, False)], "file string, pos int, start_line int, end_line int, covered boolean")
    t = spark.createDataFrame([("a", "f", 3, 7), ("b", "f", 1, 2), ("c", "g", 1, 1)], "task_id string, file string, start_line int, end_line int")
    got = {r.task_id: r for r in blocks.line_hits(t, b, ["file"]).collect()}
    assert got["a"].hit_lines == [3] and got["a"].missed_lines == [4, 5, 6, 7] and got["b"].target_hit and got["c"].missed_lines == [1]
    got = {r.task_id: r for r in blocks.line_hits(t, b, ["file"], absent_is_hit=True).collect()}
    assert got["a"].hit_lines == [3, 7] and got["c"].missed_lines == [1] and not got["c"].target_hit


def test_file_of_task(spark):
    t = spark.createDataFrame([("1", "mod/src/main/java/com/A.java"), ("2", "b.py"), ("3", "zz.py")], "task_id string, file string")
    f = spark.createDataFrame([("com/A.java", 0), ("src/b.py", 2), ("lib/b.py", 1)], "path string, pos int")
    assert {r.task_id: r.path for r in validation.file_of_task(t, f).collect()} == {"1": "com/A.java", "2": "lib/b.py", "3": None}


def test_cascade_and_decisions(spark):
    rows = spark.createDataFrame([("pass", True, False, None), ("pass", False, True, False), ("pass", False, False, False), ("fail", False, False, None), (None, False, False, None)], "s string, env boolean, db boolean, hit boolean")
    flags = {name: F.lit(False) for name in validation.OVERRIDES} | {"environment": F.col("env"), "database": F.col("db")}
    s, a = validation.cascade(validation.base_status(F.col("s")), validation.base_action(F.col("s"), F.lit(""), F.lit(1), F.lit(0)), flags, F.col("hit"))
    got = rows.select(s.alias("status"), a.alias("action")).withColumn("d", validation.agent_decision(F.col("status"), F.col("action"))).collect()
    assert [tuple(r) for r in got] == [
        ("passed", "manual_review_environment", "manual-review"),
        ("passed", "manual_review_database", "manual-review"),
        ("failed", "needs_better_input", "needs-better-input"),
        ("failed", "repair_generated_test", "repair-generated-test"),
        ("run_error", "inspect_test_runner", "inspect-runner"),
    ]


def test_ranges_and_names(spark):
    rows = spark.createDataFrame([("5-3",), ("7",), ("a-b",), (" entire file ",), ("2-4",)], "x string")
    got = rows.select(T.strict_range("x").alias("s"), T.lenient_range("x").alias("l")).collect()
    assert [(r.s and tuple(r.s), r.l and tuple(r.l)) for r in got] == [((5, 5), (3, 5)), (None, (7, 7)), (None, None), (None, None), ((2, 4), (2, 4))]
    row = spark.range(1).select(T.pascal_case(T.identifier_words(F.lit("get_userName v2"))).alias("p"), T.snake_case(T.identifier_words(F.lit("Get User"))).alias("s"), T.slug(F.lit(" A!!b ")).alias("g"), T.parameter_names(F.lit("&self, a: i32, int b")).alias("n")).first()
    assert (row.p, row.s, row.g, row.n) == ("GetUserNameV2", "get_user", "a-b", ["a", "b"])


def test_spans():
    py = "def a(x, *ys, **kw):\n    return 1\n\nclass C:\n    @property\n    def m(self, y):\n        pass\n    def __init__(self): pass\n"
    assert [s[2:7] for s in spans.spans_of("a.py", py)] == [("a", "function", 1, 2, ["x", "ys", "kw"]), ("C.m", "method", 6, 7, ["y"])]
    assert [s[1:3] for s in spans.spans_of("a.py", "def a(x):\n  return (")] == [(-1, None)]
    js = "export function add(a, b) {\n  return a\n}\nconst f = (x) => {\n}\nclass K {\n  run(q) {\n  }\n}\ndescribe('x', () => {})\n"
    assert [s[2:6] for s in spans.spans_of("a.ts", js)] == [("add", "function", 1, 3), ("f", "function", 4, 5), ("K.run", "method", 7, 8)]
    java = "class A {\n  public int f(int x, String y) {\n    if (x > 0) {\n    }\n  }\n}\n"
    assert [s[2:7] for s in spans.spans_of("A.java", java)] == [("A.f", "method", 2, 5, ["x", "y"])]
    rust = "pub fn f(x: i32) -> i32 {\n  x\n}\n"
    assert [s[2:7] for s in spans.spans_of("l.rs", rust)] == [("f", "function", 1, 3, ["x"])]
    quoted = "function a() {\n  const s = '}' + \"}\" + `}\n}` // }\n  /* } */\n  return s\n}\nfunction b() {}\n"
    assert [s[2:6] for s in spans.spans_of("q.js", quoted)] == [("a", "function", 1, 6), ("b", "function", 7, 7)]
    life = "fn a<'x>(s: &'x str) -> char {\n  let c = '}'; // }\n  c\n}\nfn b() {}\n"
    assert [s[2:6] for s in spans.spans_of("q.rs", life)] == [("a", "function", 1, 4), ("b", "function", 5, 5)]
    assert spans.spans_of("a.go", "func a() {}") == [] and spans.spans_of("a.txt", "x") == [] and spans.spans_of("a.py", None) == []


def test_python_that_does_not_parse(spark):
    files = spark.createDataFrame([("a.py", "def a(x):\n  return (\nclass B:\n  def c(self, z):\n    pass"), ("b.py", "def ok(): pass")], "file string, source string")
    got = spans.source_spans(files).orderBy("file", "span_pos").collect()
    assert [(s.file, s.span_pos, s.name, s.approx) for s in got] == [("a.py", 0, "a", True), ("a.py", 1, "B.c", True), ("b.py", 0, "ok", False)]


def test_detect_framework(spark):
    paths = spark.createDataFrame([("p/src/a.ts",), ("q/x/y.md",), ("a.go",), ("z/b.txt",)], "path string")
    files = spark.createDataFrame([("p", "package.json", '{"devDependencies": {"mocha": "1"}}'), ("q", "pyproject.toml", "# pytest\n[tool.pytest.ini_options]"), ("q", "pom.xml", "")], "folder string, name string, content string")
    assert {r.path: r.framework for r in detection.detect_framework(paths, files).collect()} == {"p/src/a.ts": "mocha", "q/x/y.md": "pytest", "a.go": "go-test", "z/b.txt": "go-test"}


def test_documents(spark):
    lines = spark.createDataFrame([('{"id": "a", "target": "f"}',), ('{"status": "passed", "action": "ready", "coverage_task": {"id": "b"}, "run_result": {"skipped": 2}}',), ("  ",), ('{"x": 1}',)], "line string")
    got = documents.task_lines(lines).collect()
    assert [(r.id, r.valid) for r in got] == [("a", True), ("b", True), (None, False)]
    assert documents.validation_lines(lines).where("id = 'b'").first()["skipped"] == 2
    section = documents.section_lines(spark.createDataFrame([('n\tfailed\t2\twhy\t{"k": "v"}',)], "line string")).first()
    assert (section.status, section.exit_code, section.signals) == ("failed", 2, {"k": "v"})


def test_streamed_counts(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 1)
    spark.createDataFrame([("r", at, "a", "pass"), ("r", at, "b", "fail"), ("r", at + dt.timedelta(hours=1), "c", "skip")], "run_id string, ts timestamp, test string, action string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, ts timestamp, test string, action string").parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("counts").collect()
    assert [(r.passed, r.failed, r.status) for r in got] == [(1, 1, "fail")]


def test_empty_inputs(spark):
    none = raw(spark).limit(0)
    for reader in (formats.go_profile, formats.lcov, formats.istanbul, formats.coverage_py, formats.jacoco):
        assert reader(none).count() == 0
