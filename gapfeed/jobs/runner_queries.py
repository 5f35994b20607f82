"""Queries over captured output and report files: all dialects in one job, reports read from files in byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed.jobs import adapters as A
from gapfeed.jobs.registry import query
from gapfeed.shipping import scratch_path
from gapfeed.sources import coverage_formats as formats
from gapfeed.sources import reports, results, scopes

#: The dialect of a run is its number modulo 8.
_FRAMEWORKS = ("go-test", "go-json", "pytest", "jest", "mocha", "node-test", "cargo-test", "junit")


def _output(run: Column, pos: Column, test: Column, action: Column) -> Column:
    """An event as a line of its run's dialect: texts for pass, fail, skip and output."""
    n = lambda k, plus=0: (pos % k + plus).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    event = lambda a, **more: F.to_json(F.struct(F.lit(a).alias("Action"), say("T", test).alias("Test"), *[v.alias(k) for k, v in more.items()]))
    id_ = say("tests/test_x.py::test_", test, " ")
    maven = say("Tests run: ", (pos % 9 + pos % 3 + 52).cast("string"), ", Failures: ", n(3), ", Errors: 0, Skipped: 2")
    lines = {
        "go-test": (say("--- PASS: T", test, " (0.0s)"), say("--- FAIL: T", test, " (0.0s)"), say("=== RUN   T", test), say("    x_test.go:", n(90, 1), ": got ", pos)),
        "go-json": (event("pass"), event("fail"), event("skip"), event("output", Output=F.lit("x_test.go:3: got 1, want 2"))),
        "pytest": (say(id_, "PASSED"), say(id_, "FAILED"), say(id_, "SKIPPED"), say(id_, "ran")),
        "jest": (say("  expect(x).toBe(", pos, ")"), say("  ● suite › T", test), say("Tests:       2 failed, ", n(10), " passed, ", n(10, 2), " total"), say("    at fn (src/t.js:", n(90, 1), ":7)")),
        "mocha": (say("  ", n(7), " passing (9ms)"), say("  ", n(50, 1), ") T", test), say("  ", n(5), " failing"), say("      AssertionError: expected ", n(9), " to equal ", test)),
        "node-test": (say("# pass ", n(100)), say("# fail ", n(7)), say("# todo ", n(10)), say("# tests ", n(50))),
        "cargo-test": (say("test T", test, "::p", pos, " ... ok"), say("test T", test, "::p", pos, " ... FAILED"), say("---- T", test, " stdout ----"), say("thread panicked at 'boom ", pos, "', src/lib.rs:1:1")),
        "junit": (maven, maven, maven, F.lit("INFO")),
    }
    of = lambda four: F.when(action == "pass", four[0]).when(action == "fail", four[1]).when(action == "skip", four[2]).otherwise(four[3])
    return F.coalesce(*[F.when(run % 8 == i, of(lines[f])) for i, f in enumerate(_FRAMEWORKS)])


def _runner_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_results(spark, sf_dir)
    framework = F.element_at(F.array(*[F.lit(f.replace("go-json", "go-test")) for f in _FRAMEWORKS]), (F.col("run_id") % 8 + 1).cast("int"))
    return e.select("run_id", framework.alias("framework"), "pos", _output(F.col("run_id"), F.col("pos"), F.col("test"), F.col("action")).alias("line"))


_EVENTS = """e AS (SELECT user_id % 40 AS run_id, event_id AS pos, user_id AS test, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'output' END AS a FROM events)"""


@query(f"""WITH {_EVENTS}, c AS (SELECT run_id, run_id % 8 AS d, count_if(a = 'pass') AS np, count_if(a = 'fail') AS nf, count_if(a = 'skip') AS ns,
  max(pos) FILTER (a = 'pass') AS lp, max(pos) FILTER (a = 'fail') AS lf, max(pos) FILTER (a = 'skip') AS ls, max(pos) FILTER (a = 'output') AS lo, max(pos) FILTER (a <> 'output') AS lm,
  min(pos) FILTER (a = 'skip') AS fs, coalesce(sum(pos % 10) FILTER (a = 'skip'), 0) AS todo FROM e GROUP BY run_id),
l AS (SELECT run_id, count(*) AS n FROM e JOIN c USING (run_id) WHERE a = 'fail' AND pos > fs GROUP BY run_id),
f AS (SELECT run_id, test, arg_min(a, pos) AS s FROM e WHERE a <> 'output' GROUP BY 1, 2),
p AS (SELECT run_id, count_if(s = 'pass') AS p, count_if(s = 'fail') AS f, count_if(s = 'skip') AS s FROM f GROUP BY run_id),
m AS (SELECT c.*, coalesce(lp % 7, 0) AS mp, coalesce(ls % 5, 0) AS mf, coalesce(l.n, nf) AS blocks FROM c LEFT JOIN l USING (run_id)),
r AS (SELECT run_id, d,
  CASE d WHEN 0 THEN np WHEN 1 THEN np WHEN 2 THEN coalesce(p.p, 0) WHEN 3 THEN coalesce(ls % 10, 0) WHEN 4 THEN mp WHEN 5 THEN coalesce(lp % 100, 0) WHEN 6 THEN np ELSE CASE WHEN lm IS NULL THEN 0 ELSE 50 + lm % 9 END END AS passed,
  CASE d WHEN 0 THEN nf WHEN 1 THEN nf WHEN 2 THEN coalesce(p.f, 0) WHEN 3 THEN CASE WHEN ls IS NULL THEN nf ELSE 2 END WHEN 4 THEN CASE WHEN mf > 0 THEN mf WHEN mp = 0 THEN nf ELSE blocks END WHEN 5 THEN coalesce(lf % 7, 0) WHEN 6 THEN nf ELSE coalesce(lm % 3, 0) END AS failed,
  CASE d WHEN 1 THEN ns WHEN 2 THEN coalesce(p.s, 0) WHEN 5 THEN todo WHEN 7 THEN CASE WHEN lm IS NULL THEN 0 ELSE 2 END ELSE 0 END AS skipped,
  CASE d WHEN 5 THEN coalesce(lo % 50, 0) ELSE 0 END AS said FROM m LEFT JOIN p USING (run_id))
SELECT run_id, ['go-test','go-test','pytest','jest','mocha','node-test','cargo-test','junit'][d + 1] AS framework, CAST(passed AS INTEGER) AS passed, CAST(failed AS INTEGER) AS failed, CAST(skipped AS INTEGER) AS skipped,
  CAST(CASE WHEN said > 0 THEN said ELSE passed + failed + skipped END AS INTEGER) AS total, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status FROM r""")
def runner_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as output of 40 runs in eight dialects, all read in one job."""
    return results.parse_result_lines(results.with_dialect(_runner_lines(spark, sf_dir)))[0]


@query(f"""WITH {_EVENTS}, d AS (SELECT *, run_id % 8 AS d FROM e WHERE run_id % 8 IN (0, 3, 4, 6)),
b AS (SELECT *, count_if(a = 'fail') OVER w AS block, count_if(a = 'skip') OVER w AS skips, last_value(CASE WHEN a <> 'output' THEN test END IGNORE NULLS) OVER w AS named,
  coalesce(last_value(CASE WHEN a = 'fail' THEN false WHEN a = 'skip' OR a = 'pass' AND d = 4 THEN true END IGNORE NULLS) OVER w, false) AS stopped
  FROM d WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
g AS (SELECT run_id, d, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS ord, 'T' || named AS test_name, 'x_test.go' AS file, pos % 90 + 1 AS line, 0 AS col, 'got ' || pos AS error, '' AS expected, '' AS received FROM b WHERE d = 0 AND a = 'output' AND named IS NOT NULL),
k AS (SELECT run_id, d, block, min(pos) AS head_pos, arg_min(test, pos) AS test, max(pos) FILTER (a = 'output') AS o, max(pos) FILTER (a = 'pass') AS p, arg_max(test, pos) FILTER (a = 'output') AS ot
  FROM b WHERE d IN (3, 4) AND block > 0 AND NOT stopped AND (d = 3 OR skips > 0) GROUP BY 1, 2, 3),
j AS (SELECT run_id, d, row_number() OVER (PARTITION BY run_id ORDER BY head_pos) AS ord, 'T' || test AS test_name, CASE WHEN d = 3 AND o IS NOT NULL THEN 'src/t.js' ELSE '' END AS file, CASE WHEN d = 3 AND o IS NOT NULL THEN o % 90 + 1 ELSE 0 END AS line, CASE WHEN d = 3 AND o IS NOT NULL THEN 7 ELSE 0 END AS col,
  CASE WHEN d = 3 THEN CASE WHEN p IS NULL THEN '{results.NO_DETAIL}' ELSE 'expect(x).toBe(' || p || ')' END WHEN o IS NULL THEN '{results.NO_DETAIL_MOCHA}' ELSE 'AssertionError: expected ' || (o % 9) || ' to equal ' || ot END AS error,
  CASE WHEN d = 4 AND o IS NOT NULL THEN CAST(ot AS VARCHAR) ELSE '' END AS expected, CASE WHEN d = 4 AND o IS NOT NULL THEN CAST(o % 9 AS VARCHAR) ELSE '' END AS received FROM k),
x AS (SELECT run_id, skips AS ord, max(pos) FILTER (a = 'output') AS o FROM b WHERE d = 6 AND skips > 0 GROUP BY 1, 2),
c AS (SELECT run_id, d, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS ord, 'T' || test || '::p' || pos AS test_name FROM b WHERE d = 6 AND a = 'fail'),
u AS (SELECT * FROM g UNION ALL SELECT * FROM j UNION ALL SELECT c.run_id, c.d, c.ord, c.test_name, '', 0, 0, coalesce('boom ' || x.o, ''), '', '' FROM c LEFT JOIN x ON c.run_id = x.run_id AND c.ord = x.ord)
SELECT run_id, ['go-test','','','jest','mocha','','cargo-test'][d + 1] AS framework, CAST(ord AS INTEGER) AS ord, test_name, file, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, error, expected, received FROM u""")
def runner_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of runs of go test, Jest, Mocha and cargo."""
    lines = _runner_lines(spark, sf_dir).where((F.col("run_id") % 8).isin(0, 3, 4, 6))
    return results.parse_result_lines(results.with_dialect(lines))[1]


@query("""SELECT 'pkg/f' || (o_custkey % 50) || '.go' AS file, CAST(o_orderkey % 500 + 1 AS INTEGER) AS start_line, CAST(o_orderkey % 500 + 1 + o_custkey % 9 AS INTEGER) AS end_line,
CAST(o_custkey % 5 + 1 AS INTEGER) AS statements, CAST(o_orderkey % 3 AS INTEGER) AS count, o_orderkey % 3 > 0 AS covered FROM orders""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders written as coverprofile files and read back in ranges of 64 KB."""
    t = A.table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 500 + 1
    line = F.concat(F.lit("pkg/f"), F.col("o_custkey") % 50, F.lit(".go:"), start, F.lit(".2,"), start + F.col("o_custkey") % 9, F.lit(".9 "), F.col("o_custkey") % 5 + 1, F.lit(" "), F.col("o_orderkey") % 3)
    head = spark.createDataFrame([("mode: count",)], "line string")
    path = scratch_path(spark, "profiles")
    head.unionByName(t.select(line.alias("line"))).write.text(path)
    lines = reports.lines_of_files(spark, path, split_bytes=64 << 10)
    return formats.go_profile_lines(lines).select("file", "start_line", "end_line", "statements", "count", "covered")


#: Files that no parser takes, by a part's key.
_PYTHON = ("class A:", "    class B(Base):", "        def inner{k}(self, a):", "            return a", "", "    def outer(self, b, c: int):", "        # note", "        return b", "# closes A", "    def loose(d):", "        return d", "def top(e):")
_SCRIPT = ("class K {", "  const go{k} = (a) => {", '    return "}"', "  }", "}", "function free(b) { return {} }", "class L {}", "  const late = x => {", "  }", "function same() {", "}")


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_size % 5 AS INTEGER) AS n FROM part),
s AS (SELECT k, n, unnest([{'i': 0, 'm': 'B.inner', 'q': true, 'a': 3, 'e': 4, 'p': 'a'}, {'i': 1, 'm': 'A.outer', 'q': false, 'a': 6, 'e': 8, 'p': 'b,c'}, {'i': 2, 'm': 'loose', 'q': false, 'a': 10, 'e': 11, 'p': 'd'}, {'i': 3, 'm': 'top', 'q': false, 'a': 12, 'e': 12, 'p': 'e'}]) AS x FROM p),
j AS (SELECT k, unnest([{'i': 0, 'm': 'K.go', 'q': true, 'a': 2, 'e': 4, 'p': 'a'}, {'i': 1, 'm': 'free', 'q': false, 'a': 6, 'e': 6, 'p': 'b'}, {'i': 2, 'm': 'L.late', 'q': false, 'a': 8, 'e': 9, 'p': 'x'}, {'i': 3, 'm': 'same', 'q': false, 'a': 10, 'e': 11, 'p': ''}]) AS x FROM p)
SELECT 'pkg/m' || k || '.py' AS file, x.i AS span_pos, x.m || CASE WHEN x.q THEN CAST(k AS VARCHAR) ELSE '' END AS name, CASE WHEN contains(x.m, '.') THEN 'method' ELSE 'function' END AS kind, x.a AS start_line, CAST(CASE WHEN x.i = 3 THEN 12 + n ELSE x.e END AS INTEGER) AS end_line, x.p AS params FROM s
UNION ALL SELECT 'web/m' || k || '.js', x.i, x.m || CASE WHEN x.q THEN CAST(k AS VARCHAR) ELSE '' END, CASE WHEN contains(x.m, '.') THEN 'method' ELSE 'function' END, x.a, x.e, x.p FROM j""")
def indent_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as Python files that don't parse and as scripts, both read by indentation."""
    from gapfeed.sources.spans import source_spans

    t = A.table(spark, sf_dir, "part")
    code = lambda lines: F.replace(F.lit("\n".join(lines)), F.lit("{k}"), F.col("p_partkey").cast("string"))
    python = F.concat(code(_PYTHON), F.repeat(F.lit("\n    e"), (F.col("p_size") % 5).cast("int")), F.lit("\nx = ("))
    read = source_spans(t.select(F.concat(F.lit("pkg/m"), "p_partkey", F.lit(".py")).alias("file"), python.alias("source")))
    scripts = scopes.script_scopes(t.select(F.concat(F.lit("web/m"), "p_partkey", F.lit(".js")).alias("file"), code(_SCRIPT).alias("source")))
    return read.unionByName(scripts).select("file", "span_pos", "name", "kind", "start_line", "end_line", F.array_join("params", ",").alias("params"))


#: Sources of four languages, by a part's key.
_FACTS = (
    ("py", "import os\nfrom q.m{k} import C{k}, other as o\nimport os\n\nclass C{k}(Base):\n    import inner\n    class D:\n        pass\n"),
    ("ts", "import { A } from './a{k}';\nconst x = require('y');\nimport B from 'b'\nexport class K{k} {}\n interface I {\ntype T = 1\nexport class K{k} {}\n"),
    ("go", 'package p\n\nimport (\n\t"fmt" // x\n\tm "a/b{k}"\n)\nimport "os"\n\nfunc f() {}\n'),
    ("java", "import java.util.List;\nclass J{k} {}\n"),
)


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 4 AS INTEGER) + 1 AS i FROM part)
SELECT 'f' || k || ['.py','.ts','.go','.java'][i] AS file, ['python','typescript','go','java'][i] AS language,
replace(['import os|from q.m{k} import C{k}, other as o|import inner', 'import { A } from ''./a{k}''|import B from ''b''|const x = require(''y'')', '"fmt"|"a/b{k}"|"os"', ''][i], '{k}', CAST(k AS VARCHAR)) AS imports,
replace(['C{k}|D', 'K{k}|I|T', '', ''][i], '{k}', CAST(k AS VARCHAR)) AS types FROM p""")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as source files of four languages."""
    from gapfeed.operators import facts

    k = F.col("p_partkey")
    of = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in _FACTS]), (k % 4 + 1).cast("int"))
    files = A.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k, F.lit("."), of(0)).alias("file"), F.replace(of(1), F.lit("{k}"), k.cast("string")).alias("source"))
    return facts.source_facts(files).select("file", "language", F.array_join("imports", "|").alias("imports"), F.array_join("types", "|").alias("types"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 6 AS c FROM part)
SELECT k AS p_partkey, CASE c WHEN 0 THEN 'pkg/f' || k || '.go' WHEN 1 THEN 'f' || k || '.go' WHEN 2 THEN '/other/f' || k || '.go' WHEN 3 THEN '.' WHEN 4 THEN '../f' || k || '.go' ELSE '..f' || k END AS command_path,
CASE c WHEN 0 THEN '/copy/pkg/f' || k || '.go' WHEN 1 THEN '/copy/f' || k || '.go' WHEN 2 THEN '/other/f' || k || '.go' WHEN 3 THEN '/copy' WHEN 4 THEN '/f' || k || '.go' ELSE '/work/app/..f' || k END AS moved_path,
'if ' || k || ' > n1 && ' || k || '.n_x(n1, $n)' AS expression FROM p""")
def path_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as paths that commands and copies of a project name, and as names to replace."""
    from gapfeed.functions import text as T
    from gapfeed.operators import sources

    k, c = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    path = F.when(c == 0, F.concat(F.lit("/work/app/./pkg//f"), k, F.lit(".go"))).when(c == 1, F.concat(F.lit("f"), k, F.lit(".go"))).when(c == 2, F.concat(F.lit("/other/f"), k, F.lit(".go"))).when(c == 3, "/work/x/../app").when(c == 4, F.concat(F.lit("../f"), k, F.lit(".go"))).otherwise(F.concat(F.lit("/work/app/..f"), k))
    root = F.lit("/work/app/")
    expression = T.replace_identifier(F.lit("if n > n1 && n.n_x(n1, $n)"), F.lit("n"), k)
    kept = F.concat(F.substring_index(expression, "$", 1), F.lit("$n)"))
    return A.table(spark, sf_dir, "part").select("p_partkey", sources.command_path(path, root, root).alias("command_path"), sources.moved_path(path, root, F.lit("/copy")).alias("moved_path"), kept.alias("expression"))


@query("""SELECT o_orderkey, 'order ' || o_orderkey || ': ' || o_orderstatus AS text, '{"o_orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":' || CASE WHEN o_orderkey % 2 = 0 THEN '"n' || o_custkey || '"' ELSE 'null' END || '}' AS json FROM orders""")
def json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as results, written as one JSON object a line and read back as text."""
    from gapfeed import sinks

    t = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("n"), "o_custkey")).alias("note"))
    path = scratch_path(spark, "json-lines")
    sinks.write_json_lines(sinks.json_result(t, F.concat(F.lit("order "), "o_orderkey", F.lit(": "), "status"), "o_orderkey", "status", "note", keep=["o_orderkey"]), path)
    lines = reports.lines_of_files(spark, path, split_bytes=1 << 20)
    return lines.select(F.from_json("line", "o_orderkey long, text string, json string").alias("r")).select("r.*")


@query("""WITH t AS (SELECT p_partkey % 13 AS report, p_partkey AS idx FROM part), c AS (SELECT report, count(*) AS have FROM t GROUP BY 1) SELECT report, have FROM c WHERE have < (SELECT avg(have) FROM c)""")
def short_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with fewer tasks than there are on average."""
    from gapfeed.operators import tasks

    t = A.table(spark, sf_dir, "part").select((F.col("p_partkey") % 13).alias("report"), F.col("p_partkey").alias("idx"))
    n, reports_ = t.count(), 13
    return tasks.short_reports(t, "report", -(-n // reports_))
