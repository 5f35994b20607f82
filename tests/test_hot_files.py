"""One file that holds all rows: same results, many tasks."""

import random

from pyspark.sql import functions as F

from gapfeed.operators import gaps, pairs, sources


def rows_of(plan, name):
    """The most rows that a join of an executed plan made."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return rows_of(plan.executedPlan(), name)
    own = plan.metrics().get("numOutputRows").get().value() if name in plan.nodeName() else 0
    inner = [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([own, *(rows_of(p, name) for p in inner)])


def test_merge_of_one_hot_file(spark):
    rng = random.Random(2)
    rows = [("f", i, s, s + rng.choice([0, 0, 1, 4, -3]), rng.choice([0.5, 0.9]), [s], [f"i{rng.randint(0, 3)}"]) for i, s in enumerate(rng.choices(range(1, 3000), k=700))]
    t = spark.createDataFrame(rows, "file string, idx int, start_line int, end_line int, confidence double, uncovered_lines array<int>, suggested_inputs array<string>").repartition(4)
    want, reach = [], None
    for _, idx, a, b, c, lines, said in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if reach is None or a > reach + 1:
            want.append([a, b, idx, c, 1, set(lines), list(said)])
            reach = max(a, b)
        else:
            w = want[-1]
            w[1], w[3], w[4] = max(w[1], b), max(w[3], c), w[4] + 1
            w[5] |= set(lines)
            w[6] += [x for x in said if x not in w[6]]
            reach = max(reach, a, b)
    for split in (10, 1 << 18):
        got = sorted((r.start_line, r.end_line, r.idx, r.confidence, r.members, set(r.uncovered_lines), r.suggested_inputs) for r in gaps.merge_adjacent(t, ["file"], split=split).collect())
        assert got == [tuple(w) for w in want]


def test_targets_of_one_hot_file(spark):
    rng = random.Random(3)
    functions = [("f", rng.choice(["", "A", "B.C"]), rng.choice(["run", "A", "x_y"])) for _ in range(40)]
    targets = ["", " run ", "A", "A.run", "A_run", "p.A.run", "B.C.x_y", "q.B.C.run", "C.run", "nope", "A.A", ".A.run", "..", "A_A", None]
    tasks = [(i, "f" if i % 7 else "g", t) for i, t in enumerate(targets * 2)]
    f = spark.createDataFrame(functions + [("g", "A", "only")], "file string, owner string, name string")
    t = spark.createDataFrame(tasks, "id int, file string, target string").where("target is not null")
    pairs = t.join(f, "file").withColumn("hit", sources.target_matches(F.col("target"), F.col("owner"), F.col("name")))
    named = pairs.groupBy("id").agg(F.max("hit").alias("any_hit"))
    want = pairs.join(named, "id").where(F.col("hit") | ~F.col("any_hit")).select("id", "file", "owner", "name")
    assert sorted(map(tuple, sources.targets_or_all(t, f).collect())) == sorted(map(tuple, want.collect()))


def test_latest_start_of_one_hot_file(spark):
    rng = random.Random(4)
    functions = [("f", f"n{i}", rng.randint(5, 400)) for i in range(150)]
    tasks = [(i, "f", rng.randint(1, 500)) for i in range(600)] + [(900, "g", 7)]
    f = spark.createDataFrame(functions, "file string, name string, start_line int")
    t = spark.createDataFrame(tasks, "id int, file string, line int")
    want = []
    for i, file, line in tasks:
        near = [s for g, _, s in functions if g == file and s <= line]
        want += [(i, n) for g, n, s in functions if near and g == file and s == max(near)]
    for split in (20, 1 << 18):
        assert sorted(map(tuple, sources.latest_start(t, f, split=split).collect())) == sorted(want)
    plan = sources.latest_start(t, f)._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan.split("Join Inner")[1].split("\n")[0]


def _ranges(rng, n, far):
    """Ranges of one hot file: short, long, reversed, below line 1 and without an end or a start."""
    out = []
    for i in range(n):
        s = rng.randint(-20, far)
        e = rng.choice([s, s + rng.randint(0, 9), s + rng.randint(0, far), s - rng.randint(1, 30), None] if i % 3 == 0 else [s + rng.randint(0, 12)])
        out.append((i, "f" if i % 9 else "g", None if i % 50 == 49 else s, e))
    return out


def test_overlaps_of_one_hot_file(spark):
    rng = random.Random(5)
    b, s = _ranges(rng, 400, 700), _ranges(rng, 300, 700)
    blocks = spark.createDataFrame(b, "block_id int, file string, start_line int, end_line int")
    spans = spark.createDataFrame([(i * 7 % 300, f"n{i}", *r) for i, *r in s], "span_pos int, name string, file string, start_line int, end_line int")
    first, least = {}, {}
    known = lambda *x: None not in x
    for i, f, bs, be in b:
        for j, g, ss, se in s:
            pos = j * 7 % 300
            if f == g and known(bs, ss, se) and (ss <= bs <= se or (known(be) and bs <= se and ss <= be)):
                first[i] = min(first.get(i, (999, "")), (pos, f"n{j}"))
            to, until = (x if y is None or x is None else max(x, y) for x, y in ((ss, se), (bs, be)))
            if f == g and known(bs, ss) and bs <= to and ss <= until:
                least[i] = min(least.get(i, (999, 0)), (to - ss, pos))
    got = gaps.span_of_block(blocks, spans, ["file"]).collect()
    assert {r.block_id: (r.span_pos, r.name) for r in got} == {i: first.get(i, (None, None)) for i, *_ in b} and len(got) == len(b)
    got = gaps.branch_of_block(blocks, spans.withColumnRenamed("span_pos", "branch_pos"), ["file"]).collect()
    assert {r.block_id: r.branch_pos for r in got} == {i: least.get(i, (None, None))[1] for i, *_ in b} and len(got) == len(b)


def test_overlaps_never_become_pairs(spark):
    """2,000 blocks that overlap all of 2,000 distinct spans: rows follow their number, not the pairs."""
    n = 2000
    rows = spark.range(n).select(F.lit("f").alias("file"), F.col("id"), (F.col("id") + 1).cast("int").alias("start_line"), (F.col("id") + n + 1).cast("int").alias("end_line"))
    for found in (gaps.span_of_block(rows.withColumnRenamed("id", "block_id"), rows.selectExpr("file", "id as span_pos", "'x' as name", "start_line", "end_line"), ["file"]), gaps.branch_of_block(rows.withColumnRenamed("id", "block_id"), rows.withColumnRenamed("id", "branch_pos"), ["file"])):
        assert len(found.collect()) == n
        assert rows_of(found._jdf.queryExecution().executedPlan(), "Join") < 60 * n


def test_all_pairs_of_a_hot_key_are_many_tasks(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(i, rng.choice(["hot", "hot", "b", None])) for i in range(300)], "id int, k string")
    right = spark.createDataFrame([(f"n{i % 40}", rng.choice(["hot", "hot", "c", "b", None])) for i in range(200)], "name string, k string")
    want = sorted(map(tuple, left.join(right, "k").select("id", "name", "k").collect()))
    for most in (1, 50, 4000, 1 << 24):
        got = pairs.all_pairs(left, right, ["k"], F.col("id"), most=most)
        assert sorted(map(tuple, got.select("id", "name", "k").collect())) == want
    plan = pairs.all_pairs(left, right, ["k"], F.col("id"), most=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan.split("Join Inner")[1].split("\n")[0]


def test_tasks_that_name_a_function_are_found_without_pairs(spark):
    """A task that names one class of 1,500 functions: the pairs are the result, and are made once."""
    f = spark.range(1500).selectExpr("'f' as file", "'A' as owner", "concat('m', id) as name")
    t = spark.range(40).selectExpr("id", "'f' as file", "'A' as target")
    found = sources.targets_or_all(t, f)
    assert found.count() == 60000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Join LeftSemi" in plan.split("Join LeftAnti")[1]
