"""Registered queries over the star-schema and event tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.jobs import adapters as A
from gapfeed.operators import blocks, failures, gaps, scans, tasks, validation
from gapfeed.shipping import ship
from gapfeed.sources import coverage_formats as formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Adapter tables in SQL.
_LINES = """lines AS (SELECT l_partkey % 97 AS file, CAST(l_orderkey % 400 + 1 AS INTEGER) AS line, max(l_returnflag = 'R') AS covered FROM lineitem GROUP BY 1, 2)"""
_BLOCKS = """blocks AS (SELECT o_custkey % 7 AS run_id, o_custkey % 50 AS file, o_orderkey AS block_id, CAST(o_orderkey % 500 + 1 AS INTEGER) AS start_line,
  CAST(o_orderkey % 500 + 1 + o_custkey % 9 AS INTEGER) AS end_line, CAST(o_custkey % 5 + 1 AS INTEGER) AS statements, o_orderstatus = 'F' AS covered FROM orders)"""
_SPANS = """spans AS (SELECT p_partkey % 50 AS file, p_partkey AS span_pos, p_name AS name, CAST(p_partkey * 7 % 500 + 1 AS INTEGER) AS start_line,
  CAST(p_partkey * 7 % 500 + 1 + p_size AS INTEGER) AS end_line FROM part)"""


@query(f"""WITH {_LINES} SELECT file, count(*) AS total, count_if(covered) AS hit, CAST(count_if(covered) AS DOUBLE) * 100 / CAST(count(*) AS DOUBLE) AS percent FROM lines GROUP BY file""")
def cov_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.file_line_stats(A.covered_lines(spark, sf_dir), ["file"])


@query(f"""WITH {_LINES}, i AS (SELECT *, line - row_number() OVER (PARTITION BY file, covered ORDER BY line) AS island FROM lines)
SELECT file, covered, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY file, covered, island""")
def cov_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.run_blocks(A.covered_lines(spark, sf_dir), ["file"])


@query(f"""WITH {_BLOCKS} SELECT run_id, CAST(sum(statements) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN covered THEN statements END), 0) AS BIGINT) AS hit,
CAST(coalesce(sum(CASE WHEN covered THEN statements END), 0) AS DOUBLE) * 100 / CAST(sum(statements) AS DOUBLE) AS percent FROM blocks GROUP BY run_id""")
def cov_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.report_totals(A.order_blocks(spark, sf_dir), ["run_id"])


@query(f"""WITH {_BLOCKS} SELECT file, CAST(sum(greatest(1, end_line - start_line + 1)) AS BIGINT) AS total,
CAST(coalesce(sum(CASE WHEN covered THEN greatest(1, end_line - start_line + 1) END), 0) AS BIGINT) AS hit,
CAST(coalesce(sum(CASE WHEN covered THEN greatest(1, end_line - start_line + 1) END), 0) AS DOUBLE) * 100 / CAST(sum(greatest(1, end_line - start_line + 1)) AS DOUBLE) AS percent FROM blocks GROUP BY file""")
def cov_file_percent_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.file_percent_by_span(A.order_blocks(spark, sf_dir), ["file"])


@query(f"""WITH {_LINES}, f AS (SELECT file, CAST(count_if(covered) AS DOUBLE) * 100 / count(*) AS percent FROM lines GROUP BY file)
SELECT file % 5 AS run_id, count_if(percent > 0) AS covered_files, count_if(percent <= 0) AS uncovered_count FROM f GROUP BY 1""")
def cov_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = blocks.file_line_stats(A.covered_lines(spark, sf_dir), ["file"]).select((F.col("file") % 5).alias("run_id"), F.col("file").cast("string").alias("path"), "percent")
    return blocks.file_summary(files, ["run_id"]).drop("uncovered_files")


@query(f"""WITH {_LINES}, i AS (SELECT *, line - row_number() OVER (PARTITION BY file, covered ORDER BY line) AS island FROM lines),
b AS (SELECT file, covered, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY file, covered, island),
f AS (SELECT file, CAST(count_if(covered) AS DOUBLE) * 100 / CAST(count(*) AS DOUBLE) AS percent FROM lines GROUP BY file)
SELECT b.file, start_line || '-' || end_line AS line_range, CAST(0.9 AS DOUBLE) AS confidence FROM b JOIN f ON b.file = f.file WHERE NOT covered AND percent < 100
UNION ALL SELECT file, 'entire file', CAST(0.8 AS DOUBLE) FROM f WHERE percent < 50""")
def gap_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.covered_lines(spark, sf_dir)
    return gaps.suggestions(blocks.file_line_stats(lines, ["file"]), blocks.run_blocks(lines, ["file"]), ["file"]).select("file", "line_range", F.col("confidence").cast("double").alias("confidence"))


@query("""SELECT 'pkg/f' || (l_partkey % 97) || '.go' AS file, CAST(l_orderkey % 400 + 1 AS INTEGER) AS start_line, CAST(l_orderkey % 400 + 1 + l_linenumber AS INTEGER) AS end_line,
CAST(l_linenumber AS INTEGER) AS statements, CAST(l_quantity AS INTEGER) % 3 AS count, CAST(l_quantity AS INTEGER) % 3 > 0 AS covered FROM lineitem""")
def goprofile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "lineitem")
    start = F.col("l_orderkey") % 400 + 1
    line = F.concat(F.lit("pkg/f"), F.col("l_partkey") % 97, F.lit(".go:"), start, F.lit(".2,"), start + F.col("l_linenumber"), F.lit(".9 "), F.col("l_linenumber"), F.lit(" "), F.col("l_quantity").cast("int") % 3)
    lines = t.select(F.lit("run").alias("run_id"), F.lit(0).alias("pos"), line.alias("line"))
    return formats.go_profile_lines(lines).select("file", "start_line", "end_line", "statements", "count", "covered")


@query("""WITH d AS (SELECT l_suppkey % 20 AS run_id, l_partkey % 10 AS f, CAST(l_orderkey % 400 + 1 AS INTEGER) AS line, CAST(max(l_linenumber) % 3 AS INTEGER) AS count FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(run_id AS VARCHAR) AS run_id, 'src/f' || f || '.rs' AS file, line AS start_line, count, count > 0 AS covered FROM d""")
def lcov_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "lineitem")
    d = t.groupBy((F.col("l_suppkey") % 20).alias("run_id"), (F.col("l_partkey") % 10).alias("f"), (F.col("l_orderkey") % 400 + 1).alias("n")).agg((F.max("l_linenumber") % 3).alias("count"))
    records = d.select(F.col("run_id").cast("string").alias("run_id"), (F.col("f") * 1000 + F.col("n")).cast("long").alias("pos"), F.concat(F.lit("DA:"), F.col("n"), F.lit(","), F.col("count")).alias("line"))
    heads = d.select("run_id", "f").distinct()
    start = heads.select(F.col("run_id").cast("string").alias("run_id"), (F.col("f") * 1000).cast("long").alias("pos"), F.concat(F.lit("SF:src/f"), F.col("f"), F.lit(".rs")).alias("line"))
    end = heads.select(F.col("run_id").cast("string").alias("run_id"), (F.col("f") * 1000 + 999).cast("long").alias("pos"), F.lit("end_of_record").alias("line"))
    return formats.lcov_lines(records.unionByName(start).unionByName(end)).select("run_id", "file", "start_line", "count", "covered")


@query("""WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 50 AS INTEGER) AS a, CAST(o_custkey % 30 AS INTEGER) AS b, CAST(o_orderkey % 50 + o_custkey % 4 AS INTEGER) AS e FROM orders),
l AS (SELECT o_orderkey, unnest(list_concat([b], range(a, greatest(a, e) + 1))) AS n FROM c)
SELECT o_orderkey, count(DISTINCT n) AS n_lines, CAST(min(n) AS INTEGER) AS first_line, CAST(max(n) AS INTEGER) AS last_line, CAST(sum(DISTINCT n) AS BIGINT) AS sum_lines FROM l GROUP BY o_orderkey""")
def node_uncovered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "orders")
    cell = F.concat(F.col("o_custkey") % 30, F.lit(", "), F.col("o_orderkey") % 50, F.lit("-"), F.col("o_orderkey") % 50 + F.col("o_custkey") % 4, F.lit(",x"))
    n = formats.uncovered_cell(cell)
    return t.select("o_orderkey", n.alias("n")).select("o_orderkey", F.size("n").cast("long").alias("n_lines"), F.get("n", 0).alias("first_line"), F.element_at("n", -1).alias("last_line"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_lines"))


@query("""WITH f AS (SELECT o_custkey % 9 AS run_id, o_custkey % 100 AS f, max(CASE WHEN o_custkey % 100 = 0 THEN CAST(round(o_totalprice) AS BIGINT) % 100 END) AS whole, max(CAST(o_orderkey % 101 AS DOUBLE)) AS p FROM orders GROUP BY 1, 2)
SELECT run_id, coalesce(max(CASE WHEN f = 0 AND run_id % 2 = 0 THEN p END), avg(CASE WHEN NOT (f = 0 AND run_id % 2 = 0) THEN p END)) AS percent FROM f GROUP BY run_id""")
def node_table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "orders")
    f = t.groupBy((F.col("o_custkey") % 9).alias("run_id"), (F.col("o_custkey") % 100).alias("f")).agg(F.max(F.col("o_orderkey") % 101).alias("p"))
    name = F.when((F.col("f") == 0) & (F.col("run_id") % 2 == 0), "all files").otherwise(F.concat(F.lit("src/"), F.col("f"), F.lit(".js")))
    lines = f.select("run_id", F.col("f").alias("pos"), F.concat(F.lit("# "), name, F.lit(" | "), F.col("p"), F.lit(".00 | 50.00 | 50.00 | 3-4")).alias("line"))
    return formats.node_totals(formats.node_table(lines))


@query("""WITH d AS (SELECT l_partkey % 97 AS file, CAST(l_orderkey % 400 + 1 AS INTEGER) AS line, max(l_returnflag = 'R') AS ran FROM lineitem GROUP BY 1, 2),
s AS (SELECT file, line, max(covered) AS covered FROM (SELECT file, line, true AS covered FROM d WHERE ran UNION ALL SELECT file, line, false FROM d WHERE NOT ran OR line % 10 = 0) GROUP BY 1, 2),
i AS (SELECT *, line - row_number() OVER (PARTITION BY file, covered ORDER BY line) AS island FROM s)
SELECT 'f' || file || '.py' AS file, covered, min(line) AS start_line, max(line) AS end_line FROM i GROUP BY file, covered, island""")
def coverage_py_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.covered_lines(spark, sf_dir)
    file = lines.groupBy("file").agg(F.collect_list(F.when(F.col("covered"), F.col("line"))).alias("e"), F.collect_list(F.when(~F.col("covered") | (F.col("line") % 10 == 0), F.col("line"))).alias("m"))
    body = F.to_json(F.struct(F.create_map(F.concat(F.lit("f"), F.col("file"), F.lit(".py")), F.struct(F.col("e").alias("executed_lines"), F.col("m").alias("missing_lines"))).alias("files")))
    return formats.coverage_py(file.select(F.col("file").alias("run_id"), body.alias("raw"))).select("file", "covered", "start_line", "end_line")


@query("""SELECT l_orderkey % 200 AS run_id, 'src/p' || (l_partkey % 97) || '.ts' AS file, CAST(l_orderkey % 400 + 1 AS INTEGER) AS start_line, CAST(l_quantity AS INTEGER) % 2 AS count, CAST(l_quantity AS INTEGER) % 2 > 0 AS covered
FROM lineitem WHERE l_orderkey % 3 <> 0""")
def istanbul_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "lineitem")
    line = (F.col("l_orderkey") % 400 + 1).cast("int")
    at = F.struct(line.alias("line"), F.lit(0).alias("column"))
    # every third statement has a hit count but no place, and one place has no count
    places = F.when(F.col("l_orderkey") % 3 != 0, F.create_map(F.lit("0"), F.struct(at.alias("start"), at.alias("end")), F.lit("9"), F.struct(at.alias("start"), at.alias("end")))).otherwise(F.create_map(F.lit("9"), F.struct(at.alias("start"), at.alias("end"))))
    file = F.concat(F.lit("src/p"), F.col("l_partkey") % 97, F.lit(".ts"))
    raw = F.to_json(F.create_map(F.concat(F.lit("/abs/"), file), F.struct(file.alias("path"), places.alias("statementMap"), F.create_map(F.lit("0"), F.col("l_quantity").cast("int") % 2).alias("s"))))
    return formats.istanbul(t.select((F.col("l_orderkey") % 200).alias("run_id"), raw.alias("raw"))).select("run_id", "file", "start_line", "count", "covered")


@query("""SELECT o_orderkey AS run_id, 'com/example/p' || (o_custkey % 7) || '/C' || (o_custkey % 11) || '.java' AS file, CAST(n AS INTEGER) AS start_line, CAST((o_orderkey + n) % 3 AS INTEGER) AS count, (o_orderkey + n) % 3 > 0 AS covered
FROM orders, unnest([1, 2, 3]) AS u(n)""")
def jacoco_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "orders")
    line = lambda n: F.concat(F.lit(f'<line nr="{n}" mi="1" ci="'), (F.col("o_orderkey") + n) % 3, F.lit('"/>'))
    raw = F.concat(F.lit('<report name="r"><package name="com.example.p'), F.col("o_custkey") % 7, F.lit('"><sourcefile name="C'), F.col("o_custkey") % 11, F.lit('.java">'), line(1), line(2), line(3), F.lit("</sourcefile></package></report>"))
    return formats.jacoco(t.select(F.col("o_orderkey").alias("run_id"), raw.alias("raw"))).select("run_id", "file", "start_line", "count", "covered")


@query(f"""WITH {_BLOCKS}, o AS (SELECT *, max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM blocks),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start_line, end_line, block_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT file, min(start_line) AS start_line, max(end_line) AS end_line, arg_min(block_id, (start_line, end_line, block_id)) AS idx, max(CAST(0.8 + (statements % 2) * 0.1 AS DOUBLE)) AS confidence, count(*) AS members FROM i GROUP BY file, island""")
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.order_blocks(spark, sf_dir).select("file", F.col("block_id").alias("idx"), "start_line", "end_line", F.when(F.col("statements") % 2 == 1, 0.9).otherwise(0.8).alias("confidence"))
    return gaps.merge_adjacent(rows, ["file"])


@query(f"""WITH {_BLOCKS}, {_SPANS}, b AS (SELECT * FROM blocks),
n AS (SELECT block_id, arg_min(s.name, s.span_pos) AS name, min(s.span_pos) AS span_pos FROM b JOIN spans s ON b.file = s.file AND b.start_line <= s.end_line AND s.start_line <= b.end_line GROUP BY block_id)
SELECT b.block_id, n.name, n.span_pos FROM b LEFT JOIN n USING (block_id)""")
def span_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.span_of_block(A.order_blocks(spark, sf_dir), A.part_spans(spark, sf_dir), ["file"]).select("block_id", "name", "span_pos")


@query(f"""WITH {_BLOCKS}, {_SPANS}, n AS (SELECT block_id, arg_min(s.span_pos, (s.end_line - s.start_line, s.span_pos)) AS branch_pos FROM blocks b JOIN spans s ON b.file = s.file AND b.start_line <= s.end_line AND s.start_line <= b.end_line GROUP BY block_id)
SELECT b.block_id, n.branch_pos FROM blocks b LEFT JOIN n USING (block_id)""")
def branch_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = A.part_spans(spark, sf_dir).withColumnRenamed("span_pos", "branch_pos")
    return gaps.branch_of_block(A.order_blocks(spark, sf_dir), branches, ["file"]).select("block_id", "branch_pos")


@query(f"""WITH {_BLOCKS}, {_SPANS}, r AS (SELECT file, start_line AS a, start_line + CASE WHEN span_pos % 2 = 0 THEN 1 ELSE -5 END AS e FROM spans)
SELECT block_id FROM blocks b WHERE EXISTS (SELECT 1 FROM r WHERE b.file = r.file AND b.start_line <= greatest(r.a, r.e) AND r.a <= b.end_line)""")
def return_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function's first line is a return's; every other range is reversed, which leaves its start."""
    end = F.col("start_line") + F.when(F.col("span_pos") % 2 == 0, 1).otherwise(-5)
    return gaps.blocks_with_return(A.order_blocks(spark, sf_dir), A.part_spans(spark, sf_dir).withColumn("end_line", end), ["file"]).select("block_id")


_HITS = f"""{_BLOCKS}, t AS (SELECT o_orderkey AS task_id, o_custkey % 50 AS file, CAST(o_orderkey * 3 % 500 + 1 AS INTEGER) AS a, CAST(o_orderkey * 3 % 500 + 1 + o_custkey % 6 AS INTEGER) AS e FROM orders),
w AS (SELECT task_id, file, unnest(range(a, e + 1)) AS line FROM t),
x AS (SELECT file, block_id, covered, unnest(range(start_line, end_line + 1)) AS line FROM blocks),"""


def _hit_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") * 3 % 500 + 1).cast("int")
    return t.select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 50).alias("file"), start.alias("start_line"), (start + (F.col("o_custkey") % 6).cast("int")).alias("end_line"))


@query(f"""WITH {_HITS} s AS (SELECT file, line, arg_max(covered, block_id) AS covered FROM x GROUP BY file, line)
SELECT task_id, count_if(coalesce(covered, false)) AS n_hit, count_if(NOT coalesce(covered, false)) AS n_missed, min(coalesce(covered, false)) AS target_hit FROM w LEFT JOIN s USING (file, line) GROUP BY task_id""")
def line_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.line_hits(_hit_tasks(spark, sf_dir), A.order_blocks(spark, sf_dir), ["file"])
    return found.select("task_id", F.size("hit_lines").cast("long").alias("n_hit"), F.size("missed_lines").cast("long").alias("n_missed"), "target_hit")


@query(f"""WITH {_HITS} s AS (SELECT DISTINCT file, line FROM x WHERE NOT covered)
SELECT task_id, count_if(s.line IS NULL) AS n_hit, count_if(s.line IS NOT NULL) AS n_missed, min(s.line IS NULL) AS target_hit FROM w LEFT JOIN s ON w.file = s.file AND w.line = s.line GROUP BY task_id""")
def line_hit_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.line_hits(_hit_tasks(spark, sf_dir), A.order_blocks(spark, sf_dir), ["file"], absent_is_hit=True)
    return found.select("task_id", F.size("hit_lines").cast("long").alias("n_hit"), F.size("missed_lines").cast("long").alias("n_missed"), "target_hit")


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages),
t AS (SELECT page_id AS task_id, p AS own, regexp_extract(p, '([^/]*)$', 1) AS name FROM u),
f AS (SELECT page_id AS pos, regexp_extract(p, '([^/]*/[^/]*)$', 1) AS path, regexp_extract(p, '([^/]*)$', 1) AS base FROM u)
SELECT task_id, arg_min(path, pos) AS path FROM t LEFT JOIN f ON name = base AND (path = own OR ends_with(own, '/' || path) OR ends_with(path, '/' || own)) GROUP BY task_id""")
def suffix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    u = A.table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    files = u.select(F.col("page_id").alias("pos"), F.regexp_extract("p", "([^/]*/[^/]*)$", 1).alias("path"))
    return validation.file_of_task(u.select(F.col("page_id").alias("task_id"), F.col("p").alias("file")), files).select("task_id", "path")


_CASES = """s AS (SELECT p_partkey % 13 AS report, ['go-test','jest','pytest','junit','cargo-test','mocha','vitest','node-test'][p_partkey % 8 + 1] AS framework, p_partkey AS idx,
  ['utils','service','pkg','src/controller','core/time','lib'][p_partkey % 6 + 1] || '/' || split_part(lower(p_type), ' ', 1) || '_' || split_part(lower(p_type), ' ', -1) || ['.go','.ts','.py','.java','.rs','.css'][p_partkey % 6 + 1] AS file,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS fn, CASE WHEN p_partkey % 11 = 0 THEN 'entire file' ELSE (p_partkey % 300 + 1) || '-' || (p_partkey % 300 + 1 + p_size % 4) END AS line_range,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ['branch','error_path','return_path','statement',''][p_partkey % 5 + 1] END AS gap, p_size % 2 = 0 AS inputs, p_partkey % 11 <> 0 AS has_lines,
  CASE WHEN p_partkey % 11 = 0 THEN 0.8 WHEN p_partkey % 8 = 0 THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence FROM part),
e AS (SELECT *, CASE WHEN fn <> '' THEN fn ELSE regexp_extract(file, '([^/]*)$', 1) END AS target, regexp_extract(file, '(\\.[^./]*)$', 1) AS ext, regexp_replace(file, '\\.[^./]*$', '') AS base FROM s
  WHERE framework NOT IN ('jest','mocha','vitest','node-test') OR regexp_extract(file, '(\\.[^./]*)$', 1) IN ('.js','.jsx','.ts','.tsx','.mjs','.cjs')),
tf AS (SELECT *, CASE framework WHEN 'go-test' THEN CASE WHEN ext = '.go' THEN base || '_test.go' ELSE '' END WHEN 'cargo-test' THEN file
  WHEN 'junit' THEN 'src/test/java/' || base || 'Test' || ext WHEN 'pytest' THEN 'tests/' || regexp_replace(regexp_replace(file, '^(src|lib)/', ''), '([^/]*)$', 'test_\\1')
  WHEN 'mocha' THEN base || '.spec' || ext ELSE base || '.test' || ext END AS test_file,
  string_split_regex(lower(regexp_replace(file, '/[^/]*$', '')), '[/\\\\_.-]') AS dirs, string_split_regex(lower(file), '[/\\\\_.-]') AS words FROM e),
c AS (SELECT *, CASE WHEN list_has_any(dirs, ['cache','captcha','cmd','config','controller','controllers','database','db','distlock','docs','email','global','initialize','middleware','migration','migrations','redis','router','routes','server','service','services']) THEN -35
  WHEN list_has_any(words, ['date','format','formatter','helper','helpers','math','parser','strings','time','util','utils','validator']) THEN 18 ELSE 0 END AS cost FROM tf),
p AS (SELECT *, CAST(greatest(0, CASE WHEN fn <> '' THEN 40 WHEN line_range = 'entire file' THEN -20 ELSE 0 END + CASE gap WHEN 'branch' THEN 30 WHEN 'error_path' THEN 28 WHEN 'return_path' THEN 20 WHEN 'statement' THEN 10 ELSE 0 END
  + CASE WHEN inputs THEN 10 ELSE 0 END + CASE WHEN has_lines THEN 8 ELSE 0 END + CASE WHEN test_file <> '' THEN 6 ELSE 0 END + cost + CAST(trunc(confidence * 10) AS INTEGER)) AS INTEGER) AS priority FROM c),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY report ORDER BY priority DESC, confidence DESC, file, line_range, target, idx) AS INTEGER) AS rank FROM p)"""


@query(f"""WITH {_CASES} SELECT report, idx, priority, test_file, target FROM r""")
def task_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.from_suggestions(A.part_suggestions(spark, sf_dir), "report").select("report", "idx", "priority", "test_file", "target")


@query(f"""WITH {_CASES} SELECT report, rank, framework || '-' || rank AS id, file, line_range, target FROM r""")
def task_id_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.from_suggestions(A.part_suggestions(spark, sf_dir), "report").select("report", "rank", "id", "file", "line_range", "target")


@query(f"""WITH {_CASES} SELECT report, rank, idx, priority FROM r WHERE rank <= 20""")
def task_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.from_suggestions(A.part_suggestions(spark, sf_dir), "report").where("rank <= 20").select("report", "rank", "idx", "priority")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages),
w AS (SELECT page_id, CASE WHEN p LIKE '%/%' THEN list_filter(string_split_regex(lower(regexp_replace(p, '/[^/]*$', '')), '[/\\\\_.-]'), lambda x: x <> '') ELSE [] END AS d, list_filter(string_split_regex(lower(p), '[/\\\\_.-]'), lambda x: x <> '') AS s FROM u)
SELECT page_id, CAST(CASE WHEN list_has_any(d, ['cache','captcha','cmd','config','controller','controllers','database','db','distlock','docs','email','global','initialize','middleware','migration','migrations','redis','router','routes','server','service','services']) THEN -35
  WHEN list_has_any(s, ['date','format','formatter','helper','helpers','math','parser','strings','time','util','utils','validator']) THEN 18 ELSE 0 END AS INTEGER) AS cost FROM w""")
def path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", tasks.path_cost(F.regexp_replace("url", "^[a-z]+://", "")).alias("cost"))


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split_regex(p_type, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w FROM part)
SELECT p_partkey, CAST(len(w) AS INTEGER) AS n_words, array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), '') AS pascal, lower(array_to_string(w, '_')) AS snake FROM w""")
def identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.identifier_words("p_type")
    return A.table(spark, sf_dir, "part").select("p_partkey", F.size(w).alias("n_words"), T.pascal_case(w).alias("pascal"), T.snake_case(w).alias("snake"))


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer""")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.concat("c_name", F.lit(" / "), "c_mktsegment")).alias("slug"))


@query("""SELECT o_orderkey, CAST(a AS INTEGER) AS strict_start, CAST(greatest(a, b) AS INTEGER) AS strict_end, CAST(least(a, b) AS INTEGER) AS lenient_start, CAST(greatest(a, b) AS INTEGER) AS lenient_end
FROM (SELECT o_orderkey, o_orderkey % 60 + 1 AS a, o_custkey % 60 + 1 AS b FROM orders)""")
def line_range_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("o_orderkey") % 60 + 1, F.lit("-"), F.col("o_custkey") % 60 + 1)
    s, n = T.strict_range(text), T.lenient_range(text)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", s["start"].alias("strict_start"), s["end"].alias("strict_end"), n["start"].alias("lenient_start"), n["end"].alias("lenient_end"))


@query("""WITH e AS (SELECT user_id % 40 AS run_id, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'output' END AS a FROM events),
c AS (SELECT run_id, count_if(a = 'pass') AS passed, count_if(a = 'fail') AS failed, count_if(a = 'skip') AS skipped FROM e GROUP BY run_id)
SELECT run_id, passed, failed, skipped, passed + failed + skipped AS total, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN failed > 0 THEN 'inspect_failures' WHEN passed = 0 THEN 'manual_review' ELSE 'ready' END AS action FROM c""")
def event_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.event_results(spark, sf_dir)
    c = e.groupBy("run_id").agg(F.count_if(F.col("action") == "pass").alias("passed"), F.count_if(F.col("action") == "fail").alias("failed"), F.count_if(F.col("action") == "skip").alias("skipped"))
    c = c.withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped")).withColumn("status", F.when(F.col("failed") > 0, "fail").otherwise("pass"))
    return c.withColumn("action", validation.result_action(F.col("status"), F.col("passed"), F.col("failed"), F.lit(0)))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started FROM events""")
def carry_forward_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return A.table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(order).alias("started"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE n = 1""")
def dedupe_first_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("f"))
    return first.select("user_id", "event_type", "f.event_id", "f.value")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id""")
def last_summary_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-ZÉÈ][^.]*[.]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT doc_id, CAST(block AS BIGINT) AS block, min(pos) AS first_pos, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, arg_min(line, pos) AS header FROM h WHERE block > 0 GROUP BY doc_id, block""")
def block_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # \z: Java's $ would also match before a final line break such as \r
    b = scans.running(lines, ["doc_id"], sums={"block": F.col("line").rlike(r"^[A-ZÉÈ][^.]*[.]\z").cast("int")}).where("block > 0")
    return b.groupBy("doc_id", "block").agg(F.min("pos").cast("long").alias("first_pos"), F.count("*").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"), F.min_by("line", "pos").alias("header"))


_SAID = ["cannot find module x", "ImportError: y", "build failed", "got 3, want 4", "index out of range [5] with length 3", "integer divide by zero", "invalid memory address", "undefined: foo", "cannot use x as y", "expected 4 to equal 3", "boom"]


@query("""WITH d AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || ['cannot find module x','ImportError: y','build failed','got 3, want 4','index out of range [5] with length 3','integer divide by zero','invalid memory address','undefined: foo','cannot use x as y','expected 4 to equal 3','boom'][doc_id % 11 + 1]) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'cannot find module') OR contains(t, 'module not found') THEN 'module_resolution' WHEN contains(t, 'importerror:') THEN 'python_import_error'
 WHEN contains(t, 'build failed') OR contains(t, 'syntaxerror:') THEN 'compile_error' WHEN contains(t, 'got') AND contains(t, 'want') OR contains(t, 'expected') AND (contains(t, 'received') OR contains(t, ' to be ') OR contains(t, ' to equal ')) THEN 'expectation_mismatch'
 WHEN contains(t, 'index out of range') THEN 'index_out_of_range' WHEN contains(t, 'divide by zero') THEN 'divide_by_zero' WHEN contains(t, 'invalid memory address') THEN 'runtime_panic' WHEN contains(t, 'undefined:') THEN 'undefined_symbol'
 WHEN contains(t, 'cannot use') THEN 'type_mismatch' ELSE 'generic_failure' END AS category FROM d""")
def failure_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return A.table(spark, sf_dir, "documents").select("doc_id", failures.category(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said)).alias("category"))


#: Messages, and what the rules must read from them: category, actual and expected value.
_MESSAGES = [
    "Add(1, 2) = 4, want 3", "got 3, want 4", "AssertionError: expected 4 to be 3 // Object.is equality", "expected [1] to deep equal [2]",
    "expected 4 to equal 3", " Div(1, 0) = +Inf, WANT error ", "x = 1", "integer divide by zero", "expect(received).toBe(expected)",
]


@query("""WITH m AS (SELECT o_orderkey, trim(['Add(1, 2) = 4, want 3','got 3, want 4','AssertionError: expected 4 to be 3 // Object.is equality','expected [1] to deep equal [2]','expected 4 to equal 3',' Div(1, 0) = +Inf, WANT error ','x = 1','integer divide by zero','expect(received).toBe(expected)'][o_orderkey % 9 + 1]) || CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS t FROM orders),
p AS (SELECT *, ['(?i)=\\s*(.+?),\\s*want\\s+(.+)$', '(?i)expected\\s+(.+?)\\s+to\\s+(?:be|equal)\\s+(.+?)(?:\\s*//.*)?$', '(?i)expected\\s+(.+?)\\s+to\\s+(?:deep\\s+)?equal\\s+(.+)$'] AS r FROM m),
f AS (SELECT *, CASE WHEN regexp_matches(t, r[1]) THEN [regexp_extract(t, r[1], 1), regexp_extract(t, r[1], 2)] WHEN regexp_matches(t, r[2]) THEN [regexp_extract(t, r[2], 1), regexp_extract(t, r[2], 2)] WHEN regexp_matches(t, r[3]) THEN [regexp_extract(t, r[3], 1), regexp_extract(t, r[3], 2)] ELSE ['', ''] END AS v FROM p)
SELECT o_orderkey, trim(v[1]) AS got, trim(v[2]) AS want, CASE WHEN (v[1] <> '' AND v[2] <> '') OR contains(lower(t), 'got') AND contains(lower(t), 'want') OR contains(lower(t), 'expect(received)') THEN 'expectation_mismatch' WHEN contains(t, 'divide by zero') THEN 'divide_by_zero' ELSE 'generic_failure' END AS category FROM f""")
def assertion_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in _MESSAGES]), (F.col("o_orderkey") % len(_MESSAGES) + 1).cast("int"))
    error = F.concat(said, F.when(F.col("o_orderkey") % len(_MESSAGES) == 0, F.col("o_custkey").cast("string")).otherwise(""))
    got, want = failures.got_and_want(error)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", got.alias("got"), want.alias("want"), failures.category(error).alias("category"))


@query("""WITH p AS (SELECT p_partkey, ['FooTest.java','x.test.tsx','lib_test.rs','test_a.js','a.spec.ts','b.test.js','calc_test.go','calc.go','Test_B.PY','latest_.go'][p_partkey % 10 + 1] AS n FROM part)
SELECT p_partkey, contains(lower(n), '_test.') OR starts_with(lower(n), 'test_') OR ends_with(lower(n), '.test.js') OR ends_with(lower(n), '.spec.js') OR ends_with(lower(n), '.test.ts') OR ends_with(lower(n), '.spec.ts') AS is_test FROM p""")
def test_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("FooTest.java", "x.test.tsx", "lib_test.rs", "test_a.js", "a.spec.ts", "b.test.js", "calc_test.go", "calc.go", "Test_B.PY", "latest_.go")])
    path = F.concat(F.lit("pkg/"), F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")))
    return A.table(spark, sf_dir, "part").select("p_partkey", failures.is_test_file(path).alias("is_test"))


@query("""SELECT o_orderkey AS run_id, ['go-test','node-test','cargo-test','nyc'][o_orderkey % 4 + 1] AS framework, CAST([1, 2, 2, 0][o_orderkey % 4 + 1] AS BIGINT) AS n_blocks, CASE WHEN o_orderkey % 4 = 3 THEN '不支持的覆盖率框架: nyc' END AS error FROM orders""")
def report_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, " Go-Test ").when(k == 1, "node-test").when(k == 2, "CARGO-test").otherwise("nyc")
    body = F.when(k == 0, F.concat(F.lit("mode: set\np/f"), F.col("o_custkey"), F.lit(".go:1.1,2.2 1 1"))).when(k == 1, "# src/a.js | 50.00 | 1 | 1 | 2,5-7\n# all files | 50.00 | 1 | 1 |").when(k == 2, "SF:x.rs\nDA:1,1\nDA:2,0\nend_of_record").otherwise("?")
    raw = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), name.alias("framework"), body.alias("raw"))
    read = formats.read_all(raw).groupBy("run_id", "framework").agg(F.count("*").alias("n_blocks"), F.lit(None).cast("string").alias("error"))
    return read.unionByName(formats.read_errors(raw).withColumn("n_blocks", F.lit(0).cast("long")))


@query("""WITH d AS (SELECT o_orderkey AS run_id, o_custkey % 3 AS k, o_custkey % 7 AS m, (o_orderkey % 2) AS c FROM orders)
SELECT run_id, CAST(CASE k WHEN 0 THEN 10 + m WHEN 1 THEN 5 + m ELSE 2 END AS BIGINT) AS total, CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 + c END AS BIGINT) AS hit,
CAST(CASE k WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 + c END AS DOUBLE) * 100 / CAST(CASE k WHEN 0 THEN 10 + m WHEN 1 THEN 5 + m ELSE 2 END AS DOUBLE) AS percent FROM d""")
def jacoco_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k, m = A.table(spark, sf_dir, "orders"), F.col("o_custkey") % 3, F.col("o_custkey") % 7
    counter = lambda hit: F.concat(F.lit('<counter type="BRANCH" missed="9" covered="9"/><counter type="LINE" missed="'), m, F.lit(f'" covered="{hit}"/>'))
    source = F.concat(F.lit('<package name="a.b"><sourcefile name="C.java"><line nr="1" mi="0" ci="2"/><line nr="2" mi="1" ci="'), F.col("o_orderkey") % 2, F.lit('"/>'), F.when(k == 1, counter(5)).otherwise(""), F.lit("</sourcefile></package>"))
    raw = F.concat(F.lit('<report name="r">'), source, F.when(k == 0, counter(10)).otherwise(""), F.lit("</report>"))
    return formats.jacoco_totals(t.select(F.col("o_orderkey").alias("run_id"), raw.alias("raw")))


_TODO = "t.Skip(\"TODO: fill in meaningful test inputs and expected values\")"
_PREVIEWS = ["manual_review_unreachable: x", "manual_review_environment: x", _TODO, "manual_review_database: x", "instance.#run manual_review_private: x", "manual_review_internal: x", "manual_review_no_runtime: x", "plain", "t.Skip(\"init functions cannot be called directly; review package initialization manually\")"]
_TARGETS = ["RunClient", "InitDisk", "UserRepo.Save", "Producer.send", "Box.#run", "RemoteIP", "init"]
_HINTS = ["err != nil", "partIndex < 0", "grpc Endpoint"]
_RUNS = ["dial tcp: Connection refused", "TypeError: Private field", "ok"]


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') || {_PREVIEWS!r}[doc_id % 9 + 1] AS p, {_TARGETS!r}[doc_id % 7 + 1] AS g, {_HINTS!r}[doc_id // 7 % 3 + 1] AS h, {_RUNS!r}[doc_id // 5 % 3 + 1] AS r,
  CASE WHEN doc_id % 11 < 7 THEN 'pass' ELSE 'fail' END AS s, doc_id // 3 % 3 AS k FROM documents),
x AS (SELECT *, s = 'pass' AND k > 0 AS skips, contains(p, 't.Skip("TODO: fill in meaningful test inputs and expected values")') AS todo, lower(h || ' ' || g || ' ' || p) AS a FROM t)
SELECT doc_id, CASE WHEN skips AND (contains(p, 'manual_review_unreachable:') OR g = 'init' AND contains(p, 'init functions cannot be called directly; review') OR todo AND g = 'RemoteIP' AND contains(h, 'partIndex < 0')) THEN 'manual_review_unreachable'
 WHEN skips AND (contains(p, 'manual_review_environment:') OR todo AND g = 'InitDisk' AND contains(h, 'err != nil')) THEN 'manual_review_environment'
 WHEN skips AND todo AND g = 'RunClient' AND contains(h, 'err != nil') THEN 'manual_review_protocol'
 WHEN skips AND (contains(p, 'manual_review_database:') OR todo AND contains(h, 'err != nil') AND (contains(g, 'Repo.') OR contains(p, '*Repo'))) THEN 'manual_review_database'
 WHEN s = 'fail' AND contains(lower(r), 'connection refused') AND (contains(lower(g), 'producer.') OR list_bool_or(list_transform(['rpcclient','rpc client','grpc','endpoint','sendmessage','send message','.send(','endtransaction','recoverorphanedtransaction','route data'], lambda w: contains(a, w)))) THEN 'manual_review_external_service'
 WHEN (contains(g, '.#') OR contains(p, 'instance.#')) AND (s = 'pass' AND contains(p, 'manual_review_private:') OR s = 'fail' AND contains(r, 'Private field')) THEN 'manual_review_private'
 WHEN s = 'pass' AND contains(p, 'manual_review_internal:') THEN 'manual_review_internal' WHEN s = 'pass' AND contains(p, 'manual_review_no_runtime:') THEN 'manual_review_no_runtime'
 WHEN s = 'pass' THEN 'ready' ELSE 'repair_generated_test' END AS action FROM x""")
def validation_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    status = F.when(n % 11 < 7, "pass").otherwise("fail")
    flags = validation.review_flags(pick(_TARGETS, n), F.lit("a.go"), pick(_HINTS, F.floor(n / 7)), F.concat(F.coalesce("text", F.lit("")), pick(_PREVIEWS, n)), status, F.floor(n / 3) % 3, pick(_RUNS, F.floor(n / 5)), F.lit(""))
    action = validation.cascade(validation.base_status(status), validation.base_action(status, F.lit(""), F.lit(1), F.lit(0)), flags, F.lit(None).cast("boolean"))[1]
    return A.table(spark, sf_dir, "documents").select("doc_id", action.alias("action"))


_VALID = """v AS (SELECT o_orderkey AS id, o_custkey % 12 AS f, CASE WHEN o_orderstatus = 'F' THEN 'fail' WHEN o_orderstatus = 'O' THEN 'pass' END AS s, o_orderpriority LIKE '1%' AS fixes, o_orderkey % 5 = 0 AS hit_known, o_orderkey % 3 AS skipped FROM orders),
b AS (SELECT *, CASE WHEN s IS NULL THEN 'run_error' WHEN s = 'pass' THEN 'passed' ELSE 'failed' END AS st, CASE WHEN s IS NULL THEN 'inspect_test_runner' WHEN s = 'pass' THEN 'ready' WHEN fixes THEN 'apply_fix_suggestions' ELSE 'repair_generated_test' END AS ac FROM v),
c AS (SELECT *, CASE WHEN f < 8 AND s = 'pass' AND skipped > 0 THEN 'manual_review_' || ['unreachable','environment','protocol','database','external_service','private','internal','no_runtime'][f + 1] ELSE ac END AS a2 FROM b),
d AS (SELECT id, skipped, CASE WHEN a2 = 'ready' AND hit_known THEN 'failed' ELSE st END AS status, CASE WHEN a2 = 'ready' AND hit_known THEN 'needs_better_input' ELSE a2 END AS action FROM c)"""


def _validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "pass")
    skipped = F.col("o_orderkey") % 3
    action = validation.base_action(status, F.lit(""), F.lit(1), F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0))
    flags = {name: F.coalesce((F.col("o_custkey") % 12 == i) & (status == "pass") & (skipped > 0), F.lit(False)) for i, name in enumerate(validation.OVERRIDES)}
    s, a = validation.cascade(validation.base_status(status), action, flags, F.when(F.col("o_orderkey") % 5 == 0, F.lit(False)))
    return t.select(F.col("o_orderkey").alias("id"), skipped.alias("skipped"), s.alias("status"), a.alias("action"))


@query(f"""WITH {_VALID} SELECT id, skipped, status, action FROM d""")
def validation_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validations(spark, sf_dir)


@query(f"""WITH {_VALID} SELECT id, CASE WHEN status = 'passed' AND action = 'ready' THEN 'accept' WHEN action LIKE 'manual\\_review\\_%' ESCAPE '\\' THEN 'manual-review' WHEN action = 'apply_fix_suggestions' THEN 'apply-repair' WHEN action = 'needs_better_input' THEN 'needs-better-input'
WHEN status = 'run_error' THEN 'inspect-runner' WHEN status = 'failed' THEN 'repair-generated-test' ELSE 'inspect' END AS decision FROM d""")
def agent_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validations(spark, sf_dir).select("id", validation.agent_decision(F.col("status"), F.col("action")).alias("decision"))


@query(f"""WITH {_VALID} SELECT status, action, count(*) AS n, CAST(sum(skipped) AS BIGINT) AS skipped_total, count_if(action = 'ready' AND skipped = 0) AS ready_zero_skip FROM d GROUP BY status, action""")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.histogram(_validations(spark, sf_dir), [])


@query(f"""WITH {_VALID} SELECT id % 100 AS report, CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS overall_status, count_if(status = 'failed') AS failed_count FROM d GROUP BY 1""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.overall_status(_validations(spark, sf_dir).withColumn("report", F.col("id") % 100), ["report"])


@query("""SELECT c_custkey, 'repair-generic_failure-' || CASE WHEN c_custkey % 4 = 0 THEN 'file-go' || CASE WHEN c_custkey % 9 > 0 THEN '-' || (c_custkey % 9) ELSE '' END ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') END AS repair_id FROM customer""")
def repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", T.repair_id(F.lit("generic_failure"), name, F.lit("pkg/file.go"), F.col("c_custkey") % 9).alias("repair_id"))


def _event_lines(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    """events as one line of output each; user 40n + r is test n of run r."""
    e = A.event_results(spark, sf_dir)
    return e.select("run_id", "pos", line(e).alias("line"))


_OUTCOMES = """e AS (SELECT user_id % 40 AS run_id, event_id AS pos, user_id AS test, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'output' END AS a FROM events)"""


@query(f"""WITH {_OUTCOMES}, c AS (SELECT run_id, count_if(a = 'pass') AS p, count_if(a = 'fail') AS f, count_if(a = 'skip') AS s FROM e GROUP BY run_id)
SELECT run_id, CAST(p AS INTEGER) AS passed, CAST(f AS INTEGER) AS failed, CAST(s AS INTEGER) AS skipped, CAST(p + f + s AS INTEGER) AS total, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def go_json_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources import results

    line = lambda e: F.to_json(F.struct(e["action"].alias("Action"), F.concat(F.lit("Test"), e["test"]).alias("Test"), F.when(e["action"] == "output", "x_test.go:3: got 1, want 2").alias("Output")))
    return results.go_json(_event_lines(spark, sf_dir, line))[0]


@query(f"""WITH {_OUTCOMES}, f AS (SELECT run_id, test, min(pos) AS first_pos FROM e WHERE a = 'fail' GROUP BY 1, 2), d AS (SELECT run_id, test, count(*) AS n FROM e WHERE a = 'output' GROUP BY 1, 2)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY first_pos, 'Test' || test) AS INTEGER) AS ord, 'Test' || test AS test_name, CASE WHEN n > 0 THEN 'x_test.go' ELSE '' END AS file, CASE WHEN n > 0 THEN 3 ELSE 0 END AS line,
CASE WHEN n > 0 THEN repeat('got 1, want 2' || chr(10), CAST(n - 1 AS INTEGER)) || 'got 1, want 2' ELSE 'test failed' END AS error FROM f LEFT JOIN d USING (run_id, test)""")
def go_json_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources import results

    line = lambda e: F.to_json(F.struct(e["action"].alias("Action"), F.concat(F.lit("Test"), e["test"]).alias("Test"), F.when(e["action"] == "output", "x_test.go:3: got 1, want 2").alias("Output")))
    return results.go_json(_event_lines(spark, sf_dir, line))[1].drop("col", "expected", "received")


@query(f"""WITH {_OUTCOMES}, s AS (SELECT run_id, test, arg_min(a, pos) AS a FROM e WHERE a <> 'output' GROUP BY 1, 2), c AS (SELECT run_id, count_if(a = 'pass') AS p, count_if(a = 'fail') AS f, count_if(a = 'skip') AS s FROM s GROUP BY run_id)
SELECT r.run_id, CAST(coalesce(p, 0) AS INTEGER) AS passed, CAST(coalesce(f, 0) AS INTEGER) AS failed, CAST(coalesce(s, 0) AS INTEGER) AS skipped, CAST(coalesce(p + f + s, 0) AS INTEGER) AS total, CASE WHEN f > 0 THEN 'fail' ELSE 'pass' END AS status
FROM (SELECT DISTINCT run_id FROM e) r LEFT JOIN c ON r.run_id = c.run_id""")
def pytest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources import results

    word = lambda e: F.when(e["action"] == "pass", "PASSED").when(e["action"] == "fail", "FAILED").when(e["action"] == "skip", "SKIPPED").otherwise("ran")
    return results.pytest(_event_lines(spark, sf_dir, lambda e: F.concat(F.lit("tests/test_x.py::test_"), e["test"], F.lit(" "), word(e))))[0]


@query(f"""WITH {_OUTCOMES}, c AS (SELECT run_id, arg_max(pos, pos) FILTER (a = 'pass') AS p, arg_max(pos, pos) FILTER (a = 'fail') AS f, CAST(sum(pos % 10) FILTER (a = 'skip') AS BIGINT) AS s, arg_max(pos % 50, pos) FILTER (a = 'output') AS n FROM e GROUP BY run_id)
SELECT run_id, CAST(coalesce(p % 100, 0) AS INTEGER) AS passed, CAST(coalesce(f % 7, 0) AS INTEGER) AS failed, CAST(coalesce(s, 0) AS INTEGER) AS skipped, CAST(CASE WHEN coalesce(n, 0) = 0 THEN coalesce(p % 100, 0) + coalesce(f % 7, 0) + coalesce(s, 0) ELSE n END AS INTEGER) AS total, CASE WHEN coalesce(f % 7, 0) > 0 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def node_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources import results

    line = lambda e: F.concat(F.lit("# "), F.when(e["action"] == "pass", F.concat(F.lit("pass "), e["pos"] % 100)).when(e["action"] == "fail", F.concat(F.lit("fail "), e["pos"] % 7)).when(e["action"] == "skip", F.concat(F.lit("todo "), e["pos"] % 10)).otherwise(F.concat(F.lit("tests "), e["pos"] % 50)))
    return results.node_tap(_event_lines(spark, sf_dir, line))[0]


@query(f"""WITH {_OUTCOMES}, m AS (SELECT run_id, max(pos) FILTER (a <> 'output') AS pos FROM e GROUP BY run_id)
SELECT run_id, CAST(CASE WHEN pos IS NULL THEN 0 ELSE 50 + pos % 9 END AS INTEGER) AS passed, CAST(CASE WHEN pos IS NULL THEN 0 ELSE pos % 3 END AS INTEGER) AS failed, CAST(CASE WHEN pos IS NULL THEN 0 ELSE 2 END AS INTEGER) AS skipped, CAST(CASE WHEN pos IS NULL THEN 0 ELSE 52 + pos % 9 + pos % 3 END AS INTEGER) AS total, CASE WHEN pos % 3 > 0 THEN 'fail' ELSE 'pass' END AS status FROM m""")
def junit_last_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources import results

    line = lambda e: F.when(e["action"] != "output", F.concat(F.lit("Tests run: "), e["pos"] % 9 + e["pos"] % 3 + 52, F.lit(", Failures: "), e["pos"] % 3, F.lit(", Errors: 0, Skipped: 2"))).otherwise("INFO")
    return results.junit(_event_lines(spark, sf_dir, line))[0]


@query("""WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, CAST(p_size AS INTEGER) AS n FROM part), s AS (SELECT p_partkey, k, n, unnest([0, 1]) AS i FROM p)
SELECT 'pkg/m' || p_partkey || '.py' AS file, i AS span_pos, CASE WHEN i = 0 THEN 'f' || p_partkey ELSE 'C' || k || '.m' END AS name, CASE WHEN i = 0 THEN 'function' ELSE 'method' END AS kind,
CASE WHEN i = 0 THEN 1 ELSE n + 3 END AS start_line, CASE WHEN i = 0 THEN n + 1 ELSE n + 4 END AS end_line, CASE WHEN i = 0 THEN 'a,b' ELSE 'x' END AS params FROM s""")
def py_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.sources.spans import source_spans

    t = A.table(spark, sf_dir, "part")
    body = F.concat(F.lit("def f"), F.col("p_partkey"), F.lit("(a, b=1):\n"), F.repeat(F.lit("    pass\n"), F.col("p_size").cast("int")), F.lit("class C"), F.col("p_partkey") % 4, F.lit(":\n    def m(self, x):\n        return x\n    def __repr__(self):\n        return ''\n"))
    files = t.select(F.concat(F.lit("pkg/m"), F.col("p_partkey"), F.lit(".py")).alias("file"), body.alias("source"))
    return source_spans(files).select("file", "span_pos", "name", "kind", "start_line", "end_line", F.array_join("params", ",").alias("params"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size % 5 AS f FROM part)
SELECT 'r' || f || '/a/b/s' || p_partkey || ['.go','.py','.ts','.txt','.js','.java'][k + 1] AS path, CASE k WHEN 0 THEN 'go-test' WHEN 1 THEN 'pytest' WHEN 5 THEN 'junit' ELSE ['vitest','mocha','node-test','jest','go-test'][f + 1] END AS framework FROM p""")
def framework_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gapfeed.operators.detection import detect_framework

    t = A.table(spark, sf_dir, "part")
    ends = F.array(*[F.lit(x) for x in (".go", ".py", ".ts", ".txt", ".js", ".java")])
    paths = t.select(F.concat(F.lit("r"), F.col("p_size") % 5, F.lit("/a/b/s"), F.col("p_partkey"), F.element_at(ends, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("path"))
    package = F.when(F.col("f") == 0, '{"devDependencies":{"vitest":"1","jest":"2"}}').when(F.col("f") == 1, '{"scripts":{"test":"mocha x"},"dependencies":{"jest":"1"}}').when(F.col("f") == 2, '{"scripts":{"test":"node --test"}}').otherwise("{}")
    folders = t.select((F.col("p_size") % 5).alias("f")).distinct()
    files = folders.where("f < 4").select(F.concat(F.lit("r"), "f").alias("folder"), F.lit("package.json").alias("name"), package.alias("content"))
    more = folders.where("f < 4").select(F.concat(F.lit("r"), "f", F.lit("/a")).alias("folder"), F.lit("go.mod").alias("name"), F.lit("module x").alias("content"))
    return detect_framework(paths, files.unionByName(more))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: coverage blocks, functions and source texts to ranked, numbered test tasks."""
    return QUERIES["coverage_tasks"](spark, sf_dir)


from gapfeed.jobs import document_queries, report_queries, runner_queries  # noqa: E402, F401  register their queries
