"""Go functions, branches and returns from block structure, and masking."""

import pytest
from pyspark.sql import functions as F

from gapfeed.sources.go_source import go_structure, parameter_names
from gapfeed.sources.structure import masked

GO = '''package calc

// func hidden() { if a { return 1 } }
func Add(a, b int) int {
\ts := "}" + `{
}` // }
\tif a == 0 { return b }
\treturn a +
\t\tb
}

/* func no() {
*/
func (s *Server[T]) Run(ctx context.Context, f func(x int) error, opts ...Option) (err error) {
\tif x := g("a;b"); x > 1 && s.ok(struct{}{}) {
\t\ta()
\t} else if y != '{' {
\t\treturn nil
\t} else {
\t\tc(func() { return })
\t}
\tif f := func() bool { return true }(); f {
\t\tpanic("\\"}")
\t}
\tswitch v := x.(type) {
\tcase interface{ Foo() }:
\t\treturn map[string]int{
\t\t\t"a": 1,
\t\t}
\t}
\tselect {
\t}
\treturn
}

func external(x int) int

type T struct {
\tf func() int
}

var lit = func(int, string) {}

func Pair(int, *T, chan int) interface{} { return nil }
'''


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("a.go", GO), ("b.go", None), ("c.go", ""), ("d.go", "func only() {"), ("e.py", "func x() {}")], "file string, source string")
    return [[r.asDict() for r in t.orderBy("file", "start_line", "end_line").collect()] for t in go_structure(files)]


def test_functions(found):
    got = [(s["file"], s["span_pos"], s["name"], s["kind"], s["start_line"], s["end_line"], s["params"]) for s in found[0]]
    assert got == [
        ("a.go", 0, "Add", "function", 4, 10, ["a", "b"]),
        ("a.go", 1, "Server.Run", "method", 14, 34, ["ctx", "f", "opts"]),
        ("a.go", 2, "Pair", "function", 44, 44, ["arg", "arg", "arg"]),
        ("d.go", 0, "only", "function", 1, 1, []),
    ]


def test_branches(found):
    assert [(b["kind"], b["condition"], b["start_line"], b["end_line"]) for b in found[1]] == [
        ("if", "a == 0", 7, 7), ("if", "x > 1 && s.ok(struct{}{})", 15, 21), ("if", "y != '{'", 17, 21), ("if", "f", 22, 24), ("switch", "", 25, 30), ("select", "", 31, 32),
    ]
    assert [b["branch_pos"] for b in found[1]] == list(range(6))


def test_returns(found):
    assert [(r["start_line"], r["end_line"]) for r in found[2]] == [(7, 7), (8, 9), (18, 18), (20, 20), (22, 22), (27, 29), (33, 33), (44, 44)]


def test_masking_keeps_lines_and_length(spark):
    texts = [GO, 'a "x\\"y" b', "c 'q' // z\nd", "`raw \\` e", '"open\nnext', "/* open", "", "x / y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masked(F.col("t")).alias("m")).collect()
    for r in rows:
        assert len(r.m) == len(r.t) and [len(x) for x in r.m.split("\n")] == [len(x) for x in r.t.split("\n")]
    assert [r.m for r in rows[1:]] == ['a "    " b', "c ' '     \nd", "`     ` e", '"    \nnext', "       ", "", "x / y"]


def test_string_of_many_escapes(spark):
    text = 'var a = "' + "\\x00" * 50_000 + '}"\nfunc f() {\n\treturn\n}\n'
    spans, _, _ = go_structure(spark.createDataFrame([("big.go", text)], "file string, source string"))
    assert [(s.name, s.start_line, s.end_line) for s in spans.collect()] == [("f", 2, 4)]


def test_parameters(spark):
    lists = {"a, b int, c ...string": ["a", "b", "c"], "int, *T, chan int": ["arg"] * 3, "": [], "f func(a, b int) (int, error), m map[string]struct{ x, y int }": ["f", "m"]}
    rows = spark.createDataFrame(list(lists.items()), "raw string, want array<string>").select("want", parameter_names(F.col("raw")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_levels_read_each_row_once(spark):
    """A frame that reaches to the last row is read anew for each row, which made files quadratic."""
    from gapfeed.sources.go_source import levels

    plan = levels(spark.createDataFrame([("a.go", GO)], "file string, source string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_headers_on_several_lines(spark):
    head = "package p\n\n" + "func pad() {}\n" * 40
    code = head + "func (s *S) Wide(a int,\n\tb string,\n) error {\n\tif x := f(\n\t\t1); x &&\n\t\ty {\n\t}\n\treturn nil\n}\nfunc Z(q int) {}"
    spans, branches, _ = ([r.asDict() for r in t.orderBy("start_line").collect()] for t in go_structure(spark.createDataFrame([("w.go", code)], "file string, source string")))
    assert [(s["name"], s["params"], s["start_line"]) for s in spans[-2:]] == [("S.Wide", ["a", "b"], 43), ("Z", ["q"], 52)] and len(spans) == 42
    assert [(b["kind"], b["condition"], b["start_line"], b["end_line"]) for b in branches] == [("if", "x &&\n\t\ty", 46, 49)]
