"""Report files in byte ranges, and scans over splits."""

import gzip
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.operators import sources, tasks
from gapfeed.operators.scans import running
from gapfeed.sources import coverage_formats as formats
from gapfeed.sources import reports as R


@pytest.mark.parametrize("read_bytes", [1, 2, 7, 1 << 20])
def test_every_range_reads_the_lines_that_begin_in_it(monkeypatch, read_bytes):
    monkeypatch.setattr(R, "READ_BYTES", read_bytes)
    rng = random.Random(read_bytes)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", "\n", "\r\n", "\r", "é", ""]) for _ in range(rng.randint(0, 40))).encode()
        read = lambda at, n: text[at : at + n]
        whole = list(R.lines_in(read, 0, None))
        plain = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        assert [x for _, x in whole] == (plain[:-1] if plain[-1] == b"" else plain)
        for size in (1, 2, 3, 5, 11):
            parts = [x for a in range(0, len(text), size) for x in R.lines_in(read, a, min(len(text), a + size))]
            assert parts == whole


def test_files_folders_and_patterns(spark, tmp_path):
    (tmp_path / "a.out").write_text("mode: set\nx.go:1.1,2.2 1 0\n" * 50)
    (tmp_path / "b.out").write_text("")
    (tmp_path / "_hidden").write_text("no\n")
    (tmp_path / "c.txt.gz").write_bytes(gzip.compress(b"one\ntwo"))
    got = R.report_lines(spark, str(tmp_path), split_bytes=100)
    rows = got.orderBy("path", "pos").collect()
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"a.out", "c.txt.gz"}
    assert [r.line for r in rows if r.path.endswith("gz")] == ["one", "two"]
    a = [r for r in rows if r.path.endswith("a.out")]
    assert [r.line for r in a] == ["mode: set", "x.go:1.1,2.2 1 0"] * 50 and len({r.split for r in a}) > 5
    assert got.rdd.getNumPartitions() > 5
    assert R.report_lines(spark, str(tmp_path / "*.out")).count() == 100
    assert R.report_lines(spark, [str(tmp_path / "a.out"), str(tmp_path / "b.out")]).count() == 100


def test_paths_or_texts(spark, tmp_path):
    path = tmp_path / "r.out"
    path.write_text("from\nfile\n")
    inputs = spark.createDataFrame([("p", str(path)), ("t", "a text\nof two"), ("n", "no/such/file"), ("e", ""), ("z", None)], "run_id string, input string")
    got = sorted(map(tuple, R.lines_of_inputs(inputs).select("run_id", "line").collect()))
    assert got == [("e", ""), ("n", "no/such/file"), ("p", "file"), ("p", "from"), ("t", "a text"), ("t", "of two")]


def test_scan_equals_windows(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([None, 1, 2, -1]), rng.choice([None, None, "a", "b"])) for k in ("x", "y", None) for p in rng.sample(range(-50, 900), 200)]
    t = spark.createDataFrame(rows, "k string, pos long, n int, s string").repartition(5)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = t.select("*", F.sum(F.coalesce("n", F.lit(0))).over(w).alias("a"), F.last("s", ignorenulls=True).over(w).alias("b"), F.max("n").over(w).alias("c"))
    for split in (1, 7, 100, 10_000):
        got = running(t, ["k"], sums={"a": F.col("n")}, lasts={"b": F.col("s")}, most={"c": F.col("n")}, split=split)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_long_run_is_many_tasks(spark):
    t = spark.range(100_000).select(F.lit("r").alias("k"), F.col("id").alias("pos"))
    got = running(t, ["k"], sums={"n": F.lit(1)}, split=5_000)
    most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 60_000 and got.where("n != pos + 1").count() == 0
    assert running(t.limit(0), ["k"], sums={"n": F.lit(1)}).count() == 0


def test_strict_top_tasks(spark):
    rows = [("a", i, "f", "1-1", "t", "go-test", 1, 0.5) for i in range(3)] + [("b", 9, "f", "1-1", "t", "go-test", 1, 0.5)]
    t = spark.createDataFrame(rows, "report string, idx int, file string, line_range string, target string, framework string, priority int, confidence double")
    assert tasks.top_tasks(t, "report", 2).count() == 3
    assert tasks.top_tasks(t, "report", 1, strict=True).count() == 2
    assert [tuple(r) for r in tasks.short_reports(t, "report", 2).collect()] == [("b", 1)]
    with pytest.raises(Exception, match="report b: 1 tasks, want at least 2"):
        tasks.top_tasks(t, "report", 2, strict=True).collect()


def test_paths_and_names(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert value(sources.moved_path(lit("/a/b/c.go"), lit("/a/b"), lit("/n"))) == "/n/c.go" and value(sources.moved_path(lit("/a/bc"), lit("/a/b"), lit("/n"))) == "/a/bc"
    assert value(sources.moved_path(lit(""), lit("/a"), lit("/n"))) == "" and value(sources.moved_path(lit("x/../y"), lit("/a"), lit("/n"))) == "/n/y"
    assert value(sources.command_path(lit("p/q"), lit("."), lit("/w"))) == "p/q" and value(sources.command_path(lit("/w"), lit("/w/"), lit("/"))) == "." and value(sources.command_path(lit("/x/y"), lit("/"), lit("/w"))) == "x/y"
    assert value(T.replace_identifier(lit("a.b + ab - a"), lit("a"), lit("$1\\x"))) == "$1\\x.b + ab - $1\\x" and value(T.replace_identifier(lit("a"), lit(""), lit("z"))) == "a"


def test_node_files_in_order(spark):
    lines = spark.createDataFrame([("r", 1, "# b.js | 50.0 | 1 | 1 | 2"), ("r", 2, "# a.js | 100 | 1 | 1 | "), ("r", 3, "# all files | 75 | 1 | 1 | ")], "run_id string, pos int, line string")
    assert [(r.file, r.percent) for r in formats.node_files(formats.node_table(lines)).collect()] == [("a.js", 100.0), ("b.js", 50.0)]
