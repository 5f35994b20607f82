"""From reports and sources to tasks, failures to advice, generated code to its metadata."""

from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.operators import advice, blocks, gaps, generated, report, sources
from gapfeed.sources import coverage_formats as formats

GO = "package calc\n\nfunc Add(a, b int) int {\n\tif a == 0 {\n\t\treturn b\n\t}\n\treturn a + b\n}\n"
RUST = "pub struct Validator;\n\nimpl Validator {\n    pub fn check(&self, value: Option<i32>) -> Result<i32, String> {\n        match value {\n            Some(v) if v > 0 => Ok(v),\n            _ => Err(\"invalid\".to_string()),\n        }\n    }\n}\n"


def tasks_of(found, files, framework):
    """Tasks of parsed blocks (run_id, file, start_line, covered) of one report."""
    if "end_line" not in found.columns:
        found = found.withColumn("end_line", F.col("start_line"))
    found = found.withColumn("report", F.col("run_id")).withColumn("block_id", F.monotonically_increasing_id())
    percents = blocks.file_percent_by_span(found, ["report", "file"]).select("report", "file", "percent", F.lit(framework).alias("framework"))
    return report.coverage_tasks(percents, found, files).orderBy("rank").collect()


def test_go_report_to_task(spark):
    raw = spark.createDataFrame([("r", "mode: set\nexample.com/m/pkg/calc.go:4.2,4.10 1 0\nexample.com/m/pkg/calc.go:7.2,7.14 1 1\n")], "run_id string, raw string")
    files = spark.createDataFrame([("pkg/calc.go", GO), ("x.go", "package x")], "file string, source string")
    (t,) = tasks_of(formats.go_profile(raw), files, "go-test")
    assert (t.id, t.target, t.kind, t.line_range, t.gap_type, t.missing_branches, t.uncovered_lines) == ("go-test-1", "Add", "function", "4-4", "branch", [V.MISSING_IF + "a == 0"], [4])
    assert t.suggested_inputs == [V.HINT_CONDITION + "a == 0" + V.HINT_INPUT, V.HINT_SET + "a" + V.HINT_TO_COVER, V.HINT_SET + "b" + V.HINT_TO_COVER]
    assert (t.test_name, t.command, t.test_file, t.priority, t.confidence, t.reason) == ("TestAdd", "go test ./example.com/m/pkg", "example.com/m/pkg/calc_test.go", 103, 0.95, "Add" + V.REASON_IN_GO)


def test_rust_report_to_task(spark):
    raw = spark.createDataFrame([("r", "TN:\nSF:crates/core/src/lib.rs\nDA:5,0\nDA:8,1\nend_of_record\n")], "run_id string, raw string")
    files = spark.createDataFrame([("crates/core/src/lib.rs", RUST)], "file string, source string")
    (t,) = tasks_of(formats.lcov(raw), files, "cargo-test")
    assert (t.id, t.target, t.kind, t.line_range, t.gap_type, t.missing_branches, t.suggested_inputs) == ("cargo-test-1", "Validator.check", "method", "5-5", "branch", [V.MISSING_MATCH], [V.HINT_SET + "value" + V.HINT_TO_COVER])
    assert (t.test_name, t.command, t.test_file, t.priority, t.confidence) == ("test_validator_check_covers_gap", "cargo test", "crates/core/src/lib.rs", 103, 0.9)


def test_unknown_source_keeps_plain_suggestions(spark):
    raw = spark.createDataFrame([("r", "mode: set\nm/a.go:1.1,3.2 1 0\nm/a.go:4.1,5.2 1 0\nm/a.go:9.1,9.2 1 1\n")], "run_id string, raw string")
    none = spark.createDataFrame([], "file string, source string")
    got = tasks_of(formats.go_profile(raw), none, "go-test")
    assert [(t.line_range, t.target, t.gap_type, t.reason) for t in got] == [("1-5", "a.go", "", V.REASON_BLOCK), ("entire file", "a.go", "", V.REASON_LOW_FILE % (100 / 6))]


def test_reversed_ranges(spark):
    blocks_ = spark.createDataFrame([(1, "a", 10, 5), (2, "a", 20, 19), (3, "a", 1, 2)], "block_id int, file string, start_line int, end_line int")
    branches = spark.createDataFrame([("a", 0, 8, 12), ("a", 1, 20, 3)], "file string, branch_pos int, start_line int, end_line int")
    assert {r.block_id: r.branch_pos for r in gaps.branch_of_block(blocks_, branches, ["file"]).collect()} == {1: 0, 2: 1, 3: None}
    returns = branches.select("file", "start_line", "end_line")
    assert {r.block_id for r in gaps.blocks_with_return(blocks_, returns, ["file"]).collect()} == {1, 2}


def test_go_returns_decide(spark):
    """A block on the second line of a return is a return path, in one with `err` an error path."""
    code = "package p\n\nfunc F(a int) (int, error) {\n\treturn a +\n\t\t1,\n\t\tnil\n}\n\nfunc G() {\n\tx := 1\n\t_ = x\n}\n\nfunc H() int {\n\treturn 1 +\n\t\t2\n}\n"
    raw = spark.createDataFrame([("r", "mode: set\np/a.go:6.3,6.6 1 0\np/a.go:10.1,10.3 1 0\np/a.go:16.2,16.4 1 0\np/a.go:1.1,1.2 9 1\n")], "run_id string, raw string")
    got = tasks_of(formats.go_profile(raw), spark.createDataFrame([("p/a.go", code)], "file string, source string"), "go-test")
    assert {(t.target, t.line_range): t.gap_type for t in got if t.line_range != "entire file"} == {("F", "6-6"): "return_path", ("G", "10-10"): "statement", ("H", "16-16"): "return_path"}


def test_texts_of_ranges(spark):
    files = spark.createDataFrame([("a", "1\n2\n3"), ("b", "x")], "file string, source string")
    rows = spark.createDataFrame([(1, "a", 0, 2), (2, "a", 3, 2), (3, "a", 2, 900_000_000), (4, "a", 4, 9), (5, "c", 1, 1)], "key int, file string, start_line int, end_line int")
    assert {r.key: r.text for r in sources.texts_of(rows, files).collect()} == {1: "1\n2", 2: "3", 3: "2\n3", 4: "", 5: ""}


def test_advice(spark):
    def one(category, error, source="", test=""):
        row = spark.range(1).select(advice.advice(*(F.lit(x) for x in (category, error, "", "", source, test))).alias("a")).first()
        return row.a

    got = one("expectation_mismatch", "value GOT 3, but we want 4!", " x := 1 ")
    assert got.startswith(V.ADVICE["expectation_mismatch"][0] + "\n" + V.ADVICE_GOT + "3\n" + V.ADVICE_WANT + "4\n\n" + V.ADVICE_CAUSES) and got.endswith("\n" + V.ADVICE_SOURCE + "\nx := 1\n")
    assert V.ADVICE_UNKNOWN in one("expectation_mismatch", "no values")
    assert V.ADVICE_INDEX not in one("index_out_of_range", "index out of range") and V.ADVICE_SYMBOL not in one("undefined_symbol", "undefined: ")
    assert one("module_resolution", "e", "src", "tst").count("src") == 0 and one("generic_failure", "e", "", "tst").endswith("tst\n")


def test_generated_code(spark):
    rows = spark.createDataFrame([("a.mjs", "it('a')\nit(\"b\")"), ("a.py", "def test_a():\n    def test_b():\n        def test_c():"), ("a.rs", "fn test_x() {}"), ("a.go", "x"), (".java", "import org.junit.jupiter.api.Test;"), ("a.c", "int x;")], "path string, code string")
    got = rows.select("path", generated.case_count(F.col("code"), F.col("path")).alias("n"), generated.looks_like_tests(F.col("code"), F.col("path")).alias("t")).collect()
    assert [(r.path, r.n, r.t) for r in got] == [("a.mjs", 2, True), ("a.py", 2, True), ("a.rs", 0, True), ("a.go", 0, False), (".java", 0, True), ("a.c", 0, True)]


def test_names_comments_and_paths(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert value(generated.distinct_paths(F.array(*[F.lit(x) for x in (" ", "pkg/a.go", "./pkg//a.go", "/r/pkg/a.go", "b.go")]))) == ["pkg/a.go", "b.go"]
    assert value(generated.comment(F.lit("  a\n\tb  "))) == "a b" and value(generated.comment(F.lit("x" * 500))) == "x" * 400 + "..."
    names = {"def test_a b()": "test_a_b", "9lives!": "test_lives", "--": "test_gap", "": "test_gap", "a__b--c": "test_a__b_c", "x_-y": "test_x_y"}
    assert {n: value(generated.python_test_name(F.lit(n), F.lit("gap"))) for n in names} == names
    assert value(generated.missing_imports(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == ["b"]
    assert value(generated.provider_action(F.lit("llm_json_error"))) == "retry_model_or_fallback_static" and value(generated.provider_action(F.lit("?"))) == "inspect_provider"
    assert value(generated.database_dependent(F.lit("db.commit"), F.lit(" error_path"))) is True and value(generated.database_dependent(F.lit("db.query"), F.lit(""))) is False


def test_equal_blocks_are_read_once(spark, monkeypatch):
    """Blocks of equal lines become one before they meet functions, texts and neighbours; the first keeps its place."""
    n = 400
    found = spark.range(n).select(F.lit("r").alias("run_id"), F.lit("a.rs").alias("file"), (F.col("id") % 2 + 2).cast("int").alias("start_line"), (F.col("id") % 2 + 2).cast("int").alias("end_line"), F.lit(False).alias("covered"), F.col("id").alias("block_id"), F.lit("r").alias("report"))
    files = blocks.file_percent_by_span(found, ["report", "file"]).select("report", "file", "percent", F.lit("cargo-test").alias("framework"))
    code = spark.createDataFrame([("a.rs", "fn f() {\n    x();\n    y();\n}\n")], "file string, source string")
    seen, located = [], report.located
    monkeypatch.setattr(report, "located", lambda b, *more: seen.append(b.count()) or located(b, *more))
    got = report.coverage_suggestions(files, found, code)
    assert seen == [2]
    (row,) = got.where("line_range != 'entire file'").collect()
    assert (row.line_range, row.function, row.idx, row.uncovered_lines) == ("2-3", "f", 0, [2, 3])


def test_texts_of_equal_ranges_meet_lines_once(spark):
    from tests.test_hot_files import rows_of

    files = spark.createDataFrame([("a", "\n".join(str(i) for i in range(1, 101)))], "file string, source string")
    ranges = spark.range(500).select(F.col("id").alias("key"), F.lit("a").alias("file"), F.lit(1).alias("start_line"), F.lit(90).alias("end_line"))
    got = sources.texts_of(ranges, files)
    assert {r.text for r in got.collect()} == {"\n".join(str(i) for i in range(1, 91))}
    assert rows_of(got._jdf.queryExecution().executedPlan(), "Join") <= 500
