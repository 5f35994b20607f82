"""Coverage reports of several tools as blocks and files.

Every reader takes rows (run_id, raw) of whole reports, or lines of them, and
returns (run_id, file, pos, start_line, end_line, count, covered, statements);
lines that don't fit a format are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.functions.text import trim
from gapfeed.operators.blocks import merge_states, percent, run_blocks
from gapfeed.operators.scans import running
from gapfeed.sources.lines import to_lines

#: path:line.column,line.column statements count
_GO_LINE = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+)\s+(\d+)\s+(\d+)$"

ISTANBUL = "map<string,struct<path:string,statementMap:map<string,struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>>,s:map<string,int>>>"
COVERAGE_PY = "totals struct<covered_lines:int,num_statements:int,percent_covered:double,missing_lines:int>, files map<string,struct<executed_lines:array<int>,missing_lines:array<int>,summary:struct<covered_lines:int,num_statements:int,percent_covered:double,missing_lines:int>>>"
JACOCO = "package array<struct<_name:string,sourcefile:array<struct<_name:string,line:array<struct<_nr:int,_mi:int,_ci:int>>,counter:array<struct<_type:string,_missed:int,_covered:int>>>>>>, counter array<struct<_type:string,_missed:int,_covered:int>>"


def go_profile_lines(lines: DataFrame) -> DataFrame:
    """Blocks of coverprofile lines (run_id, pos, line)."""
    # one match a line: the path and the numbers, apart by a character that no line holds
    parts = F.split(F.regexp_replace(trim("line"), _GO_LINE, "$1\u0001$2\u0001$4\u0001$6\u0001$7"), "\u0001")
    rows = lines.select("run_id", "pos", parts.alias("_p")).where((F.size("_p") == 5) & ~F.startswith(F.get("_p", 0), F.lit("mode:")))
    number = lambda i: F.get("_p", i).try_cast("int")
    return rows.select("run_id", F.get("_p", 0).alias("file"), "pos", number(1).alias("start_line"), number(2).alias("end_line"), number(4).alias("count"), (number(4) > 0).alias("covered"), number(3).alias("statements"))


def go_profile(raw: DataFrame) -> DataFrame:
    return go_profile_lines(to_lines(raw))


def lcov_lines(lines: DataFrame, **how) -> DataFrame:
    """One-line blocks of LCOV lines (run_id, pos, line): DA records within SF ... end_of_record."""
    rows = lines.withColumn("_t", trim("line"))
    marker = F.when(F.startswith("_t", F.lit("SF:")), F.substring("_t", 4, 1 << 30)).when(F.col("_t") == "end_of_record", "")
    rows = running(rows, ["run_id"], lasts={"file": marker}, **how)
    line, count = F.regexp_extract("_t", r"^DA:(\d+),(-?\d+)", 1).try_cast("int"), F.regexp_extract("_t", r"^DA:(\d+),(-?\d+)", 2).try_cast("int")
    rows = rows.where(F.startswith("_t", F.lit("DA:")) & (F.col("file") != "")).withColumn("start_line", line).withColumn("count", count)
    return rows.where("start_line is not null and count is not null").select("run_id", "file", "pos", "start_line", F.col("start_line").alias("end_line"), "count", (F.col("count") > 0).alias("covered"), F.lit(1).alias("statements"))


def lcov(raw: DataFrame) -> DataFrame:
    return lcov_lines(to_lines(raw))


def uncovered_cell(cell: Column | str) -> Column:
    """The lines of a cell like "2,5-7": distinct and in order, bad tokens passed over, reversed ranges as their start."""
    c = F.col(cell) if isinstance(cell, str) else cell
    tokens = F.filter(F.transform(F.split(c, ","), trim), lambda t: t.rlike(r"^\d+(-\d+)?$"))
    start = lambda t: F.substring_index(t, "-", 1).cast("int")
    end = lambda t: F.substring_index(t, "-", -1).cast("int")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.sequence(start(t), F.greatest(start(t), end(t)))))))


def node_table(lines: DataFrame) -> DataFrame:
    """(run_id, file, percent, uncovered) of the rows "file | line % | branch % | funcs % | uncovered lines"."""
    bare = F.regexp_replace(F.col("line"), r"^\s*(#|ℹ)\s?", "")
    cells = F.split(bare, r"\|")
    rows = lines.withColumn("_c", cells).where((F.size("_c") >= 5) & trim(F.get("_c", 1)).rlike(r"^\d+(\.\d+)?$"))
    return rows.select("run_id", "pos", trim(F.get("_c", 0)).alias("file"), trim(F.get("_c", 1)).cast("double").alias("percent"), uncovered_cell(F.get("_c", 4)).alias("uncovered"))


def node_files(table: DataFrame) -> DataFrame:
    """(run_id, file, percent) of a node table without its totals, in order of run and path."""
    return table.where(F.lower("file") != "all files").select("run_id", "file", "percent").orderBy("run_id", "file")


def node_totals(table: DataFrame) -> DataFrame:
    """The percent of each run: of its "all files" row, else the mean of its files'."""
    whole = F.max(F.when(F.lower("file") == "all files", F.col("percent")))
    return table.groupBy("run_id").agg(F.coalesce(whole, F.avg(F.when(F.lower("file") != "all files", F.col("percent")))).alias("percent"))


def node_blocks(table: DataFrame) -> DataFrame:
    """Uncovered blocks of a node table (covered ones aren't known)."""
    lines = table.where(F.lower("file") != "all files").select("run_id", "file", F.explode("uncovered").alias("line")).distinct().withColumn("covered", F.lit(False))
    return run_blocks(lines, ["run_id", "file"])


def istanbul(raw: DataFrame) -> DataFrame:
    """Statement blocks of Istanbul JSON; statements without a hit count or a place are dropped."""
    files = raw.select("run_id", F.explode(F.from_json("raw", ISTANBUL)).alias("key", "f"))
    hits = files.select("run_id", F.col("f.path").alias("file"), F.col("f.statementMap").alias("m"), F.explode("f.s").alias("id", "count"))
    placed = hits.withColumn("at", F.try_element_at("m", F.col("id"))).where("at is not null")
    return placed.select("run_id", "file", F.col("id").try_cast("int").alias("pos"), F.col("at.start.line").alias("start_line"), F.col("at.end.line").alias("end_line"), "count", (F.col("count") > 0).alias("covered"), F.lit(1).alias("statements"))


def coverage_py_files(raw: DataFrame) -> DataFrame:
    """(run_id, file, percent, executed, missing, statements, hit) of coverage.py JSON; percents are the report's own."""
    files = raw.select("run_id", F.explode(F.from_json("raw", COVERAGE_PY)["files"]).alias("file", "f"))
    return files.select("run_id", "file", F.col("f.summary.percent_covered").alias("percent"), F.col("f.executed_lines").alias("executed"), F.col("f.missing_lines").alias("missing"), F.col("f.summary.num_statements").alias("statements"), F.col("f.summary.covered_lines").alias("hit"))


def coverage_py(raw: DataFrame) -> DataFrame:
    """Run-length blocks of coverage.py JSON."""
    files, keys = coverage_py_files(raw), ["run_id", "file"]
    states = merge_states(files.select(*keys, F.explode("executed").alias("line")), files.select(*keys, F.explode("missing").alias("line")), keys)
    blocks = run_blocks(states, keys)
    return blocks.select(*keys, F.col("start_line").alias("pos"), "start_line", "end_line", F.col("covered").cast("int").alias("count"), "covered", (F.col("end_line") - F.col("start_line") + 1).alias("statements"))


def jacoco(raw: DataFrame) -> DataFrame:
    """One-line blocks of JaCoCo XML; a line is covered if any instruction of it is."""
    packages = raw.select("run_id", F.explode(F.from_xml("raw", JACOCO)["package"]).alias("p"))
    files = packages.select("run_id", F.col("p._name").alias("package"), F.explode("p.sourcefile").alias("f"))
    name = F.regexp_replace(F.coalesce("package", F.lit("")), r"\.", "/")
    path = F.when(name == "", F.col("f._name")).otherwise(F.concat(name, F.lit("/"), F.col("f._name")))
    lines = files.select("run_id", path.alias("file"), F.explode("f.line").alias("l"))
    return lines.select("run_id", "file", F.col("l._nr").alias("pos"), F.col("l._nr").alias("start_line"), F.col("l._nr").alias("end_line"), F.col("l._ci").alias("count"), (F.col("l._ci") > 0).alias("covered"), F.lit(1).alias("statements"))


def jacoco_files(raw: DataFrame) -> DataFrame:
    """(run_id, file, total, hit, percent) of JaCoCo XML: the source file's own LINE counter, else its lines counted."""
    packages = raw.select("run_id", F.explode(F.from_xml("raw", JACOCO)["package"]).alias("p"))
    files = packages.select("run_id", F.regexp_replace(F.coalesce("p._name", F.lit("")), r"\.", "/").alias("package"), F.explode("p.sourcefile").alias("f"))
    own = F.get(F.filter("f.counter", lambda c: c["_type"] == "LINE"), 0)
    stated = F.coalesce(own["_missed"] + own["_covered"], F.lit(0))
    lines = F.coalesce(F.col("f.line"), F.array())
    total = F.when(stated > 0, stated).otherwise(F.size(lines)).cast("long")
    hit = F.when(stated > 0, own["_covered"]).otherwise(F.size(F.filter(lines, lambda x: x["_ci"] > 0))).cast("long")
    path = F.when(F.col("package") == "", F.col("f._name")).otherwise(F.concat("package", F.lit("/"), F.col("f._name")))
    return files.select("run_id", path.alias("file"), total.alias("total"), hit.alias("hit")).withColumn("percent", percent(F.col("hit"), F.col("total")))


def jacoco_totals(raw: DataFrame) -> DataFrame:
    """(run_id, total, hit, percent) of JaCoCo XML: the report's own LINE counter, else the sum of its files."""
    own = F.get(F.filter(F.from_xml("raw", JACOCO)["counter"], lambda c: c["_type"] == "LINE"), 0)
    stated = raw.select("run_id", (own["_missed"] + own["_covered"]).alias("t"), own["_covered"].alias("h"))
    summed = jacoco_files(raw).groupBy("run_id").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    both = summed.join(stated, "run_id")
    out = both.select("run_id", F.when(F.col("t") > 0, F.col("t")).otherwise(F.col("total")).cast("long").alias("total"), F.when(F.col("t") > 0, F.col("h")).otherwise(F.col("hit")).cast("long").alias("hit"))
    return out.withColumn("percent", percent(F.col("hit"), F.col("total")))


def node_report(raw: DataFrame) -> DataFrame:
    """Uncovered blocks of a Node table in the columns of the other readers."""
    blocks = node_blocks(node_table(to_lines(raw)))
    return blocks.select("run_id", "file", F.col("start_line").alias("pos"), "start_line", "end_line", F.lit(0).alias("count"), "covered", (F.col("end_line") - F.col("start_line") + 1).alias("statements"))


#: Readers by framework name.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "go-test": go_profile,
    "cargo-test": lcov,
    "jest": istanbul,
    "vitest": istanbul,
    "mocha": istanbul,
    "node-test": node_report,
    "pytest": coverage_py,
    "junit": jacoco,
}


def read_all(raw: DataFrame) -> DataFrame:
    """Blocks of reports (run_id, framework, raw) in any format that READERS names, in one plan; `read_errors` has the rest."""
    out = None
    for framework, reader in READERS.items():
        part = reader(raw.where(F.lower(trim("framework")) == framework).select("run_id", "raw")).withColumn("framework", F.lit(framework))
        out = part if out is None else out.unionByName(part)
    return out


def read_errors(raw: DataFrame) -> DataFrame:
    """(run_id, framework, error) of reports whose framework no reader knows."""
    name = F.lower(trim(F.coalesce("framework", F.lit(""))))
    return raw.where(~name.isin(*READERS)).select("run_id", name.alias("framework"), F.concat(F.lit(V.UNKNOWN_FRAMEWORK), name).alias("error"))
