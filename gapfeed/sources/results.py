"""Captured runner output as results and failures.

A dialect reads lines (run_id, pos, line) and yields two tables:
results (run_id, passed, failed, skipped, total, status) and failures
(run_id, ord, test_name, file, line, col, error, expected, received), with ""
and 0 for what is missing. What a line's meaning takes from the lines before it
(the block it lies in, the test named last, a section it opens) is state that
`stated` carries along in one pass for all dialects, split by split, so that a
run of very many lines is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.operators.failures import holds_any
from gapfeed.operators.scans import running
from gapfeed.shipping import Scratch, materialize
from gapfeed.sources.lines import to_lines

#: Messages of failures without one.
NO_DETAIL, NO_DETAIL_MOCHA, COMMAND_FAILED = "测试失败，请查看详细输出", "测试失败", "test command failed"
JEST_COMMAND_ERRORS = ("CACError:", "Unknown option", "No test files found", "Cannot find module", "SyntaxError:", "TypeError:", "ReferenceError:", "Transform failed", "failed to load config")
NODE_COMMAND_ERRORS = ("Could not find", "Cannot find module", "SyntaxError:", "TypeError:", "ERR_")

_PAREN_PLACE = r"\(([^():]+(?:/[^():]+)*):(\d+):(\d+)\)"
_AT_PLACE = r"^\s*at\s+([^():]+(?:/[^():]+)*):(\d+):(\d+)"
_BARE_PLACE = r"^[\s❯]*([^():]+(?:/[^():]+)*):(\d+):(\d+)"

def stated(lines: DataFrame, dialect: str | None = None, **how) -> DataFrame:
    """Lines with the trimmed line t and their state, by the marks of a dialect (or of each line's own, column `dialect`).

    block: how many headers there were; stopped: whether a stop line came after
    the last header; carried: the last name a line gave; listed: the last switch; late: whether the late mark was met.
    """
    rows = _trimmed(lines)
    names = [dialect] if dialect else [d for d in DIALECTS if d in _MARKS]
    own = (lambda d, c: c) if dialect else (lambda d, c: F.when(F.col("dialect") == d, c))
    marks = {d: _MARKS[d]() if d in _MARKS else {} for d in names}

    def any_of(key: str, kind: str) -> Column:
        given = [own(d, m[key]) for d, m in marks.items() if key in m]
        return F.coalesce(*given, F.lit(None).cast(kind)) if given else F.lit(None).cast(kind)

    header = F.coalesce(any_of("header", "boolean"), F.lit(False))
    out = running(
        rows,
        [k for k in ("run_id", "dialect") if k in rows.columns],
        sums={"block": header.cast("int")},
        lasts={"stopped": F.when(header, F.lit(False)).when(any_of("stop", "boolean"), F.lit(True)), "carried": any_of("carry", "string"), "listed": any_of("switch", "boolean")},
        most={"late": any_of("late", "boolean")},
        **how,
    )
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("stopped", "listed", "late")})


def _blocks(rows: DataFrame) -> DataFrame:
    """The lines of blocks: from a header to before the next header or stop line."""
    return rows.where((F.col("block") > 0) & ~F.col("stopped"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ord, their number within the run by position and name."""
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


def _trimmed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("t", T.trim("line"))


def starts(*prefixes: str) -> Column:
    t = F.col("t")
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(t, F.lit(p))
    return out


def _group(pattern: str, i: int, on: Column | None = None) -> Column:
    """A group of a pattern; null where it doesn't match."""
    on = F.col("t") if on is None else on
    return F.when(on.rlike(pattern), F.regexp_extract(on, pattern, i))


def first(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("pos")))


def last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("pos")))


def _after(prefix: str) -> Column:
    t = F.col("t")
    return F.when(starts(prefix), T.trim(F.substring(t, len(prefix) + 1, 1 << 30)))


def _unquoted(prefix: str) -> Column:
    return F.btrim(_after(prefix), F.lit("'\""))


def _place(patterns: list[str], ok: Callable[[Column], Column] | None = None) -> tuple[Column, Column, Column]:
    """File, line and column of the first pattern that fits (and whose file passes `ok`)."""
    t = F.col("t")
    file, line, col = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for p in reversed(patterns):
        fits = t.rlike(p) if ok is None else t.rlike(p) & ok(F.regexp_extract(t, p, 1))
        file = F.when(fits, F.regexp_extract(t, p, 1)).otherwise(file)
        line = F.when(fits, F.regexp_extract(t, p, 2).try_cast("int")).otherwise(line)
        col = F.when(fits, F.regexp_extract(t, p, 3).try_cast("int")).otherwise(col)
    return file, line, col


def _failures(blocks: DataFrame, name: Column, **fields: Column) -> DataFrame:
    """One failure for each block; fields are aggregates over its lines, error before defaults."""
    none = {"file": F.lit(""), "line": F.lit(0), "col": F.lit(0), "error": F.lit(""), "expected": F.lit(""), "received": F.lit("")}
    aggs = [F.coalesce(fields.get(k, v), v).alias(k) for k, v in none.items()]
    found = blocks.groupBy("run_id", "block").agg(F.min("pos").alias("_at"), name.alias("test_name"), *aggs)
    ord_ = F.row_number().over(Window.partitionBy("run_id").orderBy("_at"))
    return found.withColumn("ord", ord_).select("run_id", "ord", "test_name", *none)


def _finish(counts: DataFrame, failures: DataFrame, runs: DataFrame, total: Column | None = None) -> DataFrame:
    """Counts (run_id, passed, failed, skipped[, total]) of all runs; failures count where no count does."""
    n = failures.groupBy("run_id").agg(F.count("*").cast("int").alias("n"))
    rows = runs.join(counts, "run_id", "left").join(n, "run_id", "left").fillna(0)
    rows = rows.withColumn("failed", F.when((F.col("failed") == 0) & (F.col("n") > 0), F.col("n")).otherwise(F.col("failed")))
    whole = F.col("passed") + F.col("failed") + F.col("skipped")
    rows = rows.withColumn("total", F.when(F.col("total") == 0, whole).otherwise(F.col("total")) if "total" in counts.columns else whole)
    return rows.select("run_id", *[F.col(c).cast("int").alias(c) for c in ("passed", "failed", "skipped", "total")], F.when(F.col("failed") > 0, "fail").otherwise("pass").alias("status"))


def _runs(lines: DataFrame) -> DataFrame:
    return lines.select("run_id").distinct()


def _count(value: Column) -> Column:
    return F.coalesce(last(value.try_cast("int")), F.lit(0))


# dialects ----------------------------------------------------------------


def go_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`go test -json`: one event a line; malformed lines are passed over."""
    return _go_json(_trimmed(lines))


def _go_json(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    e = lines.withColumn("e", F.from_json("t", "Action string, Package string, Test string, Output string")).where("e.Action is not null")
    e = e.select("run_id", "pos", F.col("e.Action").alias("action"), F.coalesce("e.Package", F.lit("")).alias("package"), F.coalesce("e.Test", F.lit("")).alias("test"), F.coalesce("e.Output", F.lit("")).alias("output"))
    of_test = F.col("test") != ""
    counts = e.groupBy("run_id").agg(*[F.count_if(of_test & (F.col("action") == a)).alias(c) for a, c in (("pass", "passed"), ("fail", "failed"), ("skip", "skipped"))])
    detail = e.where((F.col("action") == "output") & of_test & ~F.contains("output", F.lit("coverage:"))).withColumn("t", T.trim("output")).where((t != "") & ~starts("===", "---"))
    place = _go_place(t)
    detail = detail.withColumn("at", place).withColumn("say", F.when(F.col("at").isNotNull(), F.when(F.col("at.message") != "", F.col("at.message"))).otherwise(t))
    said = detail.groupBy("run_id", "test").agg(
        first(F.col("at.file")).alias("file"),
        first(F.col("at.line")).alias("line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("say").isNotNull(), F.struct("pos", "say")))), lambda x: x["say"]), "\n").alias("error"),
    )
    failed = e.where((F.col("action") == "fail") & of_test).groupBy("run_id", "test").agg(F.min("pos").alias("_at"))
    tests = failed.join(said, ["run_id", "test"], "left").select("run_id", "_at", F.col("test").alias("test_name"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.when(F.coalesce(T.trim("error"), F.lit("")) == "", "test failed").otherwise(T.trim("error")).alias("error"))
    # a package that fails without a failed test speaks for itself
    package = e.where(((F.col("action") == "build-output") | ((F.col("action") == "output") & ~of_test & ~F.contains("output", F.lit("coverage:")))) | ((F.col("action") == "fail") & ~of_test))
    package = package.withColumn("t", F.when(F.col("action") == "fail", F.lit(None)).otherwise(T.trim("output")))
    clean = F.when((t != "") & (t != "FAIL") & ~starts("FAIL\t"), t)
    place = F.when(~starts("# "), _go_place(clean))
    package = package.groupBy("run_id").agg(F.max(F.when(F.col("action") == "fail", F.col("package"))).alias("test_name"), F.max("pos").alias("_at"), first(place).alias("at"), first(clean).alias("any"))
    package = package.where("test_name is not null").join(tests.select("run_id").distinct(), "run_id", "left_anti")
    package = package.select("run_id", "_at", "test_name", F.coalesce("at.file", F.lit("")).alias("file"), F.coalesce("at.line", F.lit(0)).alias("line"), F.coalesce("at.message", "any", F.lit("package failed")).alias("error"))
    ord_ = F.row_number().over(Window.partitionBy("run_id").orderBy("_at", "test_name"))
    failures = tests.unionByName(package).withColumn("ord", ord_).select("run_id", "ord", "test_name", "file", "line", F.lit(0).alias("col"), "error", F.lit("").alias("expected"), F.lit("").alias("received"))
    results = _finish(counts, failures.limit(0), _runs(lines))
    return _fail_if_any(results, failures), failures


def _go_place(x: Column) -> Column:
    pattern = r"^([^:]+):([^:]*):?(.*)$"
    line = F.regexp_extract(x, r"^[^:]+:([+-]?\d+):", 1).try_cast("int")
    return F.when(line.isNotNull(), F.struct(F.regexp_extract(x, pattern, 1).alias("file"), line.alias("line"), T.trim(F.regexp_extract(x, r"^[^:]+:[^:]+:(?s)(.*)$", 1)).alias("message")))


def _fail_if_any(results: DataFrame, failures: DataFrame) -> DataFrame:
    some = failures.select("run_id").distinct().withColumn("_some", F.lit(True))
    return results.join(some, "run_id", "left").withColumn("status", F.when(F.col("_some") | (F.col("failed") > 0), "fail").otherwise("pass")).drop("_some")


def go_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`go test -v`: an indented file:line: message belongs to the test named last, passed or not."""
    return _go_text(stated(lines, "go-test"))


def _go_test_named() -> Column:
    return F.when(starts("=== RUN", "--- PASS:", "--- FAIL:"), F.get(F.split("t", r"\s+"), 2))


def _go_text(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    rows = rows.withColumnRenamed("carried", "test")
    has = _go_test_named().isNotNull()
    counts = rows.groupBy("run_id").agg(F.count_if(starts("--- PASS:") & has).alias("passed"), F.count_if(starts("--- FAIL:") & has).alias("failed"), F.lit(0).alias("skipped"))
    marks = starts("=== RUN", "--- PASS:", "--- FAIL:")
    at = rows.where(~marks & F.col("test").isNotNull() & F.col("line").rlike(r"^[\t ]")).withColumn("at", _go_place(t)).where("at is not null")
    ord_ = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    failures = at.select("run_id", ord_.alias("ord"), F.col("test").alias("test_name"), "at.file", "at.line", F.lit(0).alias("col"), F.col("at.message").alias("error"), F.lit("").alias("expected"), F.lit("").alias("received"))
    return _finish(counts, failures.limit(0), _runs(rows)), failures


def pytest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pytest -v`: the first status of each id; without any, the last line that counts."""
    return _pytest(stated(lines, "pytest"))


def _pytest_name() -> Column:
    return T.trim(F.regexp_extract("t", r"^_+\s+(.+?)\s+_+$", 1))


def _pytest_header() -> Column:
    name = _pytest_name()
    return F.col("t").rlike(r"^_+\s+(.+?)\s+_+$") & (T.trim(F.regexp_replace(name, "_", "")) != "") & ~F.upper(name).isin("FAILURES", "ERRORS")


def _pytest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    pattern = r"^(\S+::\S+(?:\[[^\]]+\])?)\s+(PASSED|FAILED|ERROR|SKIPPED)\b"
    ids = rows.where(t.rlike(pattern)).groupBy("run_id", F.regexp_extract(t, pattern, 1).alias("id")).agg(F.min_by(F.regexp_extract(t, pattern, 2), "pos").alias("s"))
    by_id = ids.groupBy("run_id").agg(F.count_if(F.col("s") == "PASSED").alias("passed"), F.count_if(F.col("s").isin("FAILED", "ERROR")).alias("failed"), F.count_if(F.col("s") == "SKIPPED").alias("skipped"))
    number = r"(\d+)\s+(passed|failed|errors?|skipped)"
    summary = rows.where(t.rlike(number)).groupBy("run_id").agg(F.max_by("t", "pos").alias("t"))
    said = lambda word: F.transform(F.regexp_extract_all("t", F.lit(rf"(\d+)\s+{word}"), 1), lambda x: x.cast("int"))
    by_line = summary.select("run_id", F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), said("passed")), -1), F.lit(0)).alias("passed"), F.aggregate(F.concat(said("failed"), said("errors?")), F.lit(0), lambda a, x: a + x).alias("failed"), F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), said("skipped")), -1), F.lit(0)).alias("skipped"))
    counts = by_id.unionByName(by_line.join(by_id.select("run_id"), "run_id", "left_anti"))
    name, header = _pytest_name(), _pytest_header()
    blocks = _blocks(rows)
    inside = ~header & (t != "")
    place = r"^([^:\s]+\.py):(\d+):\s*(.+)$"
    at = inside & t.rlike(place)
    error = F.when(inside & ~at & t.rlike(r"^E\s+(.+)$"), T.trim(F.regexp_extract(t, r"^E\s+(.+)$", 1))).when(inside & ~at & starts("AssertionError:", "ValueError:", "TypeError:"), t)
    plain = F.when(inside & ~starts(">", "|", "_"), t)
    failures = _failures(
        blocks,
        first(F.when(header, name)),
        file=last(F.when(at, F.regexp_extract(t, place, 1))),
        line=last(F.when(at, F.regexp_extract(t, place, 2).cast("int"))),
        error=F.coalesce(last(error), first(F.when(at, T.trim(F.regexp_extract(t, place, 3)))), first(plain), F.lit(NO_DETAIL)),
        expected=first(F.when(inside & ~at, _group(r"^>\s+(.+)$", 1))),
    )
    return _finish(counts, failures, _runs(rows)), failures


def jest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jest and Vitest: summary lines, then marks of single tests; a command that never ran is one failure."""
    return _jest(stated(lines, "jest"))


def _jest_header() -> Column:
    return starts("●") | (starts("FAIL") & F.contains("t", F.lit(" > ")))


def _jest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t, line = F.col("t"), F.col("line")
    summary = F.when(F.contains(line, F.lit("Tests:")), F.get(F.split(line, ":"), 1))
    said = lambda w: F.coalesce(F.regexp_extract(summary, rf"(?:^|,)\s*(\d+)\s+{w}\b", 1), F.lit(""))
    vite = r"^\s*Tests\s+(\d+)\s+(passed|failed|skipped)"
    other = ~F.contains(line, F.lit("Tests:")) & line.rlike(vite)
    value = lambda w: F.when(said(w) != "", said(w)).when(other & (F.regexp_extract(line, vite, 2) == w), F.regexp_extract(line, vite, 1))
    counted = rows.groupBy("run_id").agg(
        *[_count(value(w)).alias(w) for w in ("passed", "failed", "skipped", "total")],
        F.count_if(starts("✓", "√")).alias("ok"),
        F.count_if(starts("✕", "×")).alias("bad"),
        F.count_if(starts("↓")).alias("down"),
    )
    header, blocks = _jest_header(), _blocks(rows)
    bare = T.trim(F.regexp_replace(F.regexp_replace(t, "^●", ""), "^FAIL", ""))
    name = F.when(F.contains(bare, F.lit("›")), T.trim(F.substring_index(bare, "›", -1))).when(F.contains(bare, F.lit(" > ")), F.regexp_replace(bare, r"^.*? > ", "")).otherwise(bare)
    inside = ~header & (t != "") & ~starts("Expected:", "Received:")
    path = lambda p: F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\")) | p.rlike(r"\.[^./]*$")
    file, at, col = _place([_PAREN_PLACE, _AT_PLACE, _BARE_PLACE], path)
    frame = _group(r"^\s*>\s*(\d+)\s*\|", 1, line).try_cast("int")
    plain = F.when(~header & (t != "") & ~starts("at ", ">") & ~F.contains(t, F.lit("|")), t)
    failures = _failures(
        blocks,
        first(F.when(header, name)),
        file=last(F.when(inside, file)),
        line=F.coalesce(last(F.when(inside, at)), first(F.when(inside & file.isNull(), frame))),
        col=last(F.when(inside, col)),
        error=F.coalesce(last(F.when(inside & starts("expect(", "AssertionError:", "Error:"), t)), first(plain), F.lit(NO_DETAIL)),
        expected=last(F.when(~header, _after("Expected:"))),
        received=last(F.when(~header, _after("Received:"))),
    )
    n = failures.groupBy("run_id").agg(F.count("*").alias("n"))
    c = counted.join(n, "run_id", "left").fillna(0)
    unmarked = (F.col("passed") + F.col("failed") + F.col("skipped") + F.col("total") + F.col("n")) == 0
    counts = c.select("run_id", F.when(unmarked, F.col("ok")).otherwise(F.col("passed")).alias("passed"), F.when(unmarked, F.col("bad")).otherwise(F.col("failed")).alias("failed"), F.when(unmarked, F.col("down")).otherwise(F.col("skipped")).alias("skipped"), "total")
    return _with_command_errors(rows, _finish(counts, failures, _runs(rows)), failures, JEST_COMMAND_ERRORS)


def _with_command_errors(rows: DataFrame, results: DataFrame, failures: DataFrame, markers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Runs that counted nothing but show a command error get one failure."""
    t = F.col("t")
    telling = F.when(holds_any(t, ("Error:", "Unknown option", "No test files found")), t)
    plain = F.when((t != "") & ~starts("at ", "Node.js "), t)
    broken = rows.groupBy("run_id").agg(F.max(holds_any(t, markers)).alias("broken"), F.coalesce(first(telling), first(plain), F.lit(COMMAND_FAILED)).alias("error"))
    broken = broken.where("broken").join(results.where("total = 0").select("run_id"), "run_id", "left_semi")
    more = broken.select("run_id", F.lit(1).alias("ord"), F.lit("test command").alias("test_name"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), "error", F.lit("").alias("expected"), F.lit("").alias("received"))
    hit = broken.select("run_id", F.lit(True).alias("_hit"))
    out = results.join(hit, "run_id", "left")
    out = out.select("run_id", "passed", F.when(F.col("_hit"), 1).otherwise(F.col("failed")).alias("failed"), "skipped", F.when(F.col("_hit"), 1).otherwise(F.col("total")).alias("total"), F.when(F.col("_hit"), "fail").otherwise(F.col("status")).alias("status"))
    return out, failures.unionByName(more)


def mocha(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mocha: passing/failing/pending counts; details are the numbered blocks after "N failing"."""
    return _mocha(stated(lines, "mocha"))


def _mocha_numbered() -> Column:
    return F.col("t").rlike(r"^(\d+)\)\s+(.+)$")


def _mocha(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    counter = lambda w: rf"^(\d+)\s+{w}\b"
    numbered = _mocha_numbered()
    fail_line = starts("✗", "✘") | numbered
    counted = rows.groupBy("run_id").agg(_count(_group(counter("passing"), 1)).alias("passed"), _count(_group(counter("failing"), 1)).alias("failed"), _count(_group(counter("pending"), 1)).alias("skipped"), F.count_if(starts("✓", "✔")).alias("ok"), F.count_if(fail_line).alias("bad"))
    none = (F.col("passed") + F.col("failed") + F.col("skipped")) == 0
    counts = counted.select("run_id", F.when(none, F.col("ok")).otherwise(F.col("passed")).alias("passed"), F.when(none, F.col("bad")).otherwise(F.col("failed")).alias("failed"), "skipped")
    # the line that says how many fail stops the blocks before it, so only later headers open any
    header = numbered
    blocks = _blocks(rows.where("late"))
    inside = ~header & (t != "")
    title = inside & F.endswith(t, F.lit(":")) & ~starts("AssertionError", "Error:")
    pieces = F.array_sort(F.collect_list(F.struct("pos", F.when(header, T.trim(F.regexp_extract(t, r"^(\d+)\)\s+(.+)$", 2))).when(title, F.substring(t, F.lit(1), F.char_length(t) - 1)).alias("x"))))
    name = F.aggregate(F.filter(pieces, lambda p: p["x"].isNotNull()), F.lit(""), lambda a, p: F.when(a == "", p["x"]).when(F.contains(a, p["x"]), a).otherwise(F.concat(a, F.lit(" "), p["x"])))
    file, at, col = _place([_PAREN_PLACE, _AT_PLACE])
    error = inside & ~title & (starts("AssertionError", "Error:") | F.contains(t, F.lit(" expected ")))
    pattern = r"(?i)^AssertionError:\s+expected\s+(.+?)\s+to\s+(?:be|equal|deep\s+equal)\s+(.+?)(?:\s*//.*)?$"
    detailed = _failures(
        blocks, name, file=last(F.when(inside & ~title, file)), line=last(F.when(inside & ~title, at)), col=last(F.when(inside & ~title, col)),
        error=F.coalesce(last(F.when(error, t)), F.lit(NO_DETAIL_MOCHA)), expected=last(F.when(error, _group(pattern, 2))), received=last(F.when(error, _group(pattern, 1))),
    )
    spec = rows.where(fail_line).join(detailed.select("run_id").distinct(), "run_id", "left_anti")
    short = spec.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("pos")).alias("ord"), T.trim(F.regexp_replace(t, r"^(\d+)\)\s+", "")).alias("test_name"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(NO_DETAIL_MOCHA).alias("error"), F.lit("").alias("expected"), F.lit("").alias("received"))
    failures = detailed.unionByName(short)
    return _finish(counts, failures, _runs(rows)), failures


def node_tap(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`node --test`: counter lines and "not ok" blocks; blocks that only sum up a suite are dropped."""
    return _node_tap(stated(lines, "node-test"))


_NODE_HEAD = r"^not ok\s+\d+\s+-\s+(.+)$"


def _node_tap(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    counter = r"^#\s+(tests|pass|fail|skipped|todo|cancelled)\s+(\d+)\s*$"
    said = lambda w: F.when(t.rlike(counter) & (F.regexp_extract(t, counter, 1) == w), F.regexp_extract(t, counter, 2))
    added = F.when(t.rlike(counter) & F.regexp_extract(t, counter, 1).isin("skipped", "todo", "cancelled"), F.regexp_extract(t, counter, 2).try_cast("int"))
    counts = rows.groupBy("run_id").agg(_count(said("pass")).alias("passed"), _count(said("fail")).alias("failed"), F.coalesce(F.sum(added), F.lit(0)).alias("skipped"), _count(said("tests")).alias("total"))
    rows = rows.withColumnRenamed("carried", "sub")
    head = _NODE_HEAD
    header = t.rlike(head)
    blocks = _blocks(rows)
    suite = t.isin("type: 'suite'", 'type: "suite"', "failureType: 'subtestsFailed'", 'failureType: "subtestsFailed"')
    whole = blocks.groupBy("run_id", "block").agg(F.max(suite).alias("suite")).where("suite").select("run_id", "block")
    blocks = blocks.join(whole, ["run_id", "block"], "left_anti")
    inside = ~header & ~t.isin("", "---", "...")
    scalar = lambda c: F.when(~c.isin("|-", "|", ">", ">-"), c)
    error = F.coalesce(scalar(_unquoted("error: ")), scalar(_unquoted("message: ")))
    fixed = starts("error: ", "message: ", "expected: ", "actual: ")
    file, at, col = _place([r"^location:\s+'?([^']+):(\d+):(\d+)'?\s*$", _PAREN_PLACE, r"^\s*at\s+(?:.+?\s+)?([^():]+(?:/[^():]+)*):(\d+):(\d+)"])
    noise = starts("at ", "duration_ms:", "failureType:", "code:", "name:", "expected:", "actual:", "operator:", "location:", "stack:") | F.contains(t, F.lit("|-"))
    plain = F.when(inside & ~noise & ~starts("error: ", "message: "), F.btrim(t, F.lit("'\"")))
    failures = _failures(
        blocks, first(F.when(header, F.coalesce(T.non_empty(F.regexp_extract(t, head, 1)), F.col("sub")))),
        file=last(F.when(inside & ~fixed, file)), line=last(F.when(inside & ~fixed, at)), col=last(F.when(inside & ~fixed, col)),
        error=F.coalesce(last(F.when(inside, error)), first(plain), F.lit(NO_DETAIL)), expected=last(F.when(inside, _unquoted("expected: "))), received=last(F.when(inside, _unquoted("actual: "))),
    )
    return _with_command_errors(rows, _finish(counts, failures, _runs(rows)), failures, NODE_COMMAND_ERRORS)


def cargo(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`cargo test`: test lines and the last summary; the i-th panic block belongs to the i-th failed test."""
    return _cargo(stated(lines, "cargo-test"))


_CARGO_TEST, _CARGO_TOTAL = r"^test\s+(\S+)\s+\.\.\.\s+(ok|FAILED)", r"test result:\s*(ok|FAILED)\.\s*(\d+) passed;\s*(\d+) failed"


def _cargo_header() -> Column:
    t = F.col("t")
    return ~t.rlike(_CARGO_TEST) & ~t.rlike(_CARGO_TOTAL) & starts("---- ") & F.contains(t, F.lit(" ----"))


def _cargo(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    test, total = _CARGO_TEST, _CARGO_TOTAL
    is_test = t.rlike(test)
    result = ~is_test & t.rlike(total)
    counted = rows.groupBy("run_id").agg(F.count_if(is_test & (F.regexp_extract(t, test, 2) == "ok")).alias("ok"), F.count_if(is_test & (F.regexp_extract(t, test, 2) == "FAILED")).alias("bad"), last(F.when(result, F.regexp_extract(t, total, 2).cast("int"))).alias("p"), last(F.when(result, F.regexp_extract(t, total, 3).cast("int"))).alias("f"))
    counts = counted.select("run_id", F.coalesce("p", "ok").alias("passed"), F.coalesce("f", "bad").alias("failed"), F.lit(0).alias("skipped"))
    ord_ = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    failed = rows.where(is_test & (F.regexp_extract(t, test, 2) == "FAILED")).select("run_id", ord_.alias("ord"), F.regexp_extract(t, test, 1).alias("test_name"))
    blocks = _blocks(rows)
    panic = blocks.groupBy("run_id", F.col("block").cast("int").alias("ord")).agg(last(_group(r"panicked at\s+'([^']+)'", 1)).alias("error"))
    failures = failed.join(panic, ["run_id", "ord"], "left").select("run_id", "ord", "test_name", F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.coalesce("error", F.lit("")).alias("error"), F.lit("").alias("expected"), F.lit("").alias("received"))
    return _finish(counts, failures.limit(0), _runs(rows)), failures


def junit(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Maven, Gradle and JUnit consoles: the last summary of any form, and the failed tests they list."""
    return _junit(stated(lines, "junit"))


def _junit_opened() -> Column:
    return T.trim(F.regexp_replace("t", r"^\[ERROR\]", "")).rlike("^(Failed tests:|Errors:)")


def _junit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = F.col("t")
    maven = r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+),\s*Skipped:\s*(\d+)"
    gradle, five = r"(\d+)\s+tests?\s+completed,\s*(\d+)\s+failed", r"tests found:\s*(\d+).*tests succeeded:\s*(\d+).*tests failed:\s*(\d+)"
    n = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    failed = F.when(t.rlike(maven), n(maven, 2) + n(maven, 3)).when(t.rlike(gradle), n(gradle, 2)).when(t.rlike(five), n(five, 3))
    total = F.when(t.rlike(maven), n(maven, 1)).when(t.rlike(gradle), n(gradle, 1)).when(t.rlike(five), n(five, 1))
    skipped = F.when(t.rlike(maven), n(maven, 4))
    passed = F.when(t.rlike(maven), n(maven, 1) - n(maven, 2) - n(maven, 3) - n(maven, 4)).when(t.rlike(gradle), n(gradle, 1) - n(gradle, 2)).when(t.rlike(five), n(five, 2))
    counts = rows.groupBy("run_id").agg(*[F.coalesce(last(c), F.lit(0)).alias(k) for k, c in (("passed", passed), ("failed", failed), ("skipped", skipped), ("total", total))])
    opened = _junit_opened()
    method = r"^(\w+)\((\S+)\)$"
    name = F.when(F.col("listed") & ~opened & t.rlike(method), F.concat(F.regexp_extract(t, method, 2), F.lit("#"), F.regexp_extract(t, method, 1))).when(~F.col("listed"), _group(r"\[FAILED\]\s+(\S+)", 1))
    ord_ = F.row_number().over(Window.partitionBy("run_id").orderBy("pos"))
    failures = rows.withColumn("test_name", name).where("test_name is not null").select("run_id", ord_.alias("ord"), "test_name", F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit("").alias("error"), F.lit("").alias("expected"), F.lit("").alias("received"))
    return _finish(counts, failures.limit(0), _runs(rows)), failures


#: What carries state in each dialect; see `stated`.
_MARKS: dict[str, Callable[[], dict[str, Column]]] = {
    "go-test": lambda: {"carry": _go_test_named()},
    "pytest": lambda: {"header": _pytest_header(), "stop": starts("====") & F.contains("t", F.lit(" in "))},
    "jest": lambda: {"header": _jest_header(), "stop": starts("Test Suites:", "Tests:", "Snapshots:", "Time:", "Ran all test")},
    "mocha": lambda: {"header": _mocha_numbered(), "stop": F.col("t").rlike(r"^(\d+)\s+(passing|failing|pending)\b"), "late": F.col("t").rlike(r"^(\d+)\s+failing\b")},
    "node-test": lambda: {"header": F.col("t").rlike(_NODE_HEAD), "stop": starts("ok ", "1..") | (starts("not ok ") & ~F.col("t").rlike(_NODE_HEAD)), "carry": _group(r"^#\s+Subtest:\s+(.+)$", 1)},
    "cargo-test": lambda: {"header": _cargo_header(), "stop": F.col("t") == ""},
    "junit": lambda: {"switch": F.when(_junit_opened(), F.lit(True)).when((F.col("t") == "") | starts("Tests run:"), F.lit(False))},
}
_MARKS["vitest"] = _MARKS["jest"]

#: Each dialect over lines with their state.
DIALECTS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {
    "go-test": _go_text, "go-json": _go_json, "pytest": _pytest, "jest": _jest, "vitest": _jest, "mocha": _mocha, "node-test": _node_tap, "cargo-test": _cargo, "junit": _junit,
}


def dialect_of(framework: Column, raw: Column) -> Column:
    """The dialect of an output: its framework, unknown ones as go-test; go output whose first line is a JSON event is go-json."""
    name = T.framework_name(framework)
    go = F.when(~name.isin(*[d for d in DIALECTS if d not in ("go-test", "go-json")]), F.lit(True)).otherwise(F.lit(False))
    head = T.trim(F.regexp_extract(raw, r"^\s*([^\n]*)", 1))
    events = F.startswith(head, F.lit("{")) & F.contains(head, F.lit('"Action"'))
    return F.when(go & events, "go-json").when(go, "go-test").otherwise(name)


def with_dialect(lines: DataFrame) -> DataFrame:
    """Lines (run_id, framework, pos, line) with their run's dialect, which its first line that isn't blank may decide."""
    heads = lines.groupBy("run_id").agg(F.max("framework").alias("framework"), F.min_by("line", F.when(T.trim("line") != "", F.col("pos"))).alias("head"))
    told = heads.select("run_id", dialect_of(F.col("framework"), F.coalesce("head", F.lit(""))).alias("dialect"))
    return lines.select("run_id", "pos", "line").join(told, "run_id")


def parse_result_lines(lines: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Results and failures of lines (run_id, dialect, pos, line), each with its framework.

    The input is read once: its lines and their state are written by dialect, and each
    dialect reads its own folder of them.
    """
    keep = ["run_id", "pos", "line", "t", "block", "stopped", "carried", "listed", "late"]
    with Scratch(lines.sparkSession) as scratch:
        rows = scratch.table(stated(lines, **how).select("dialect", *keep), "result-lines", by="dialect")
        results = failures = None
        for name, dialect in DIALECTS.items():
            r, f = dialect(rows.where(F.col("dialect") == name).select(keep))
            framework = F.lit("go-test" if name == "go-json" else name)
            r, f = r.withColumn("framework", framework), f.withColumn("framework", framework)
            results = r if results is None else results.unionByName(r)
            failures = f if failures is None else failures.unionByName(f)
        return materialize(results, "results"), materialize(failures, "failures")


def parse_results(raw: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Results and failures of outputs (run_id, framework, raw) in any dialect, each with its framework."""
    told = raw.select("run_id", "raw", dialect_of(F.col("framework"), F.col("raw")).alias("dialect"))
    return parse_result_lines(to_lines(told), **how)
