"""Coverage gaps: uncovered blocks, the functions they lie in, their kind, and merging neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.functions.text import trim
from gapfeed.operators.scans import SPLIT, running


def uncovered(files: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Uncovered blocks of files below 100 percent, with the file's percent."""
    return blocks.where(~F.col("covered")).join(files.where(F.col("percent") < 100), keys)


def suggestions(files: DataFrame, blocks: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """A row for each uncovered block, and one for each file below 50 percent."""
    per_block = uncovered(files, blocks, keys).select(*keys, F.concat_ws("-", "start_line", "end_line").alias("line_range"), F.col("start_line"), F.lit(V.REASON_BLOCK).alias("reason"), F.lit(0.9).alias("confidence"))
    low = files.where(F.col("percent") < 50).select(*keys, F.lit("entire file").alias("line_range"), F.lit(None).cast("int").alias("start_line"), F.format_string(V.REASON_LOW_FILE, F.col("percent").cast("double")).alias("reason"), F.lit(0.8).alias("confidence"))
    return per_block.unionByName(low)


def _overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{b}.start_line") <= F.col(f"{a}.end_line"))


#: Lines of one bin; ranges meet where they share a bin of their file.
BIN = 64


def _binned(ranges: DataFrame) -> DataFrame:
    """Ranges once for each bin of lines they touch, so that a file with very many of them is many keys."""
    low, high = F.least("start_line", "end_line"), F.greatest("start_line", "end_line")
    return ranges.withColumn("_bin", F.explode(F.sequence(F.floor(low / BIN), F.floor(high / BIN))))


def _forward(ranges: DataFrame) -> DataFrame:
    """Ranges with a reversed end at their start."""
    return ranges.withColumn("end_line", F.greatest("start_line", "end_line"))


def _level(lines: Column) -> Column:
    """The greatest level whose blocks of 2^level lines are no longer than so many lines."""
    return F.char_length(F.bin(lines)) - 1


def _nodes(low: Column, high: Column) -> Column:
    """The fewest whole blocks of 2^level lines that make up the lines from low to high; none if high is less. (level, node) each."""

    def at(k: Column) -> Column:
        first, behind = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k), F.call_function("shiftright", high + 1, k)
        taken = lambda node, odd: F.when((first < behind) & (F.abs(odd % 2) == 1), F.struct(k.alias("level"), node.alias("node")))
        return F.array_compact(F.array(taken(first, first), taken(behind - 1, behind)))

    return F.when(high >= low, F.flatten(F.transform(F.sequence(F.lit(0), _level(high - low + 1)), at)))


def _above(line: Column, top: Column) -> Column:
    """The blocks of 2^level lines that hold a line, of levels up to `top`."""
    return F.transform(F.sequence(F.lit(0), top), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", line, k).alias("node")))


def _least_overlapping(blocks: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _from, _to, least) of the distinct blocks (keys, _from, _to) that any range (keys, _from, _to, least) overlaps.

    A range overlaps a block if it holds the block's first line, or starts behind that line within the block. Ranges are
    entered at the nodes of 2^level lines they consist of and looked for above a first line, or entered above their start and looked
    for at the nodes the block consists of: a node keeps its least range, so rows follow the logarithm of lengths and never pairs.
    """
    wanted = blocks.where("_to >= _from").select(*keys, F.col("_from").cast("long"), F.col("_to").cast("long")).distinct()
    have = ranges.where("_to >= _from").groupBy(*keys, F.col("_from").cast("long").alias("_from"), F.col("_to").cast("long").alias("_to")).agg(F.min("least").alias("least"))
    length = lambda rows, name: rows.agg(F.coalesce(_level(F.max(F.col("_to") - F.col("_from") + 1)), F.lit(0)).alias(name))
    tops = F.broadcast(length(wanted, "_wide").crossJoin(length(have, "_long")))  # one row
    low, high = F.col("_from"), F.col("_to")

    def either(holds: Column, starts: Column) -> Column:
        none = F.array().cast("array<struct<level:int,node:bigint>>")
        said = lambda how, x: F.transform(F.coalesce(x, none), lambda n: F.struct(F.lit(how).alias("how"), n["level"].alias("level"), n["node"].alias("node")))
        return F.explode(F.concat(said("holds", holds), said("starts", starts)))

    asked = wanted.crossJoin(tops).select(*keys, "_from", "_to", either(_above(low, F.col("_long")), _nodes(low + 1, high)).alias("_n")).select(*keys, "_from", "_to", "_n.*")
    held = have.crossJoin(tops).select(*keys, "least", either(_nodes(low, high), _above(low, F.col("_wide"))).alias("_n")).select(*keys, "least", "_n.*")
    held = held.groupBy(*keys, "how", "level", "node").agg(F.min("least").alias("least"))
    # sizes of exploded rows are estimated too low for a broadcast
    return asked.join(held.hint("merge"), [*keys, "how", "level", "node"]).groupBy(*keys, "_from", "_to").agg(F.min("least").alias("least"))


def _lines_of(rows: DataFrame) -> DataFrame:
    """Rows with their lines as _from and _to; a reversed range, or one without an end, is its start."""
    return rows.withColumns({"_from": F.col("start_line").cast("long"), "_to": F.greatest("start_line", "end_line").cast("long")})


def span_of_block(blocks: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with the first span in source order that holds its start or overlaps it (null without one).

    blocks: keys, block_id, start_line, end_line; spans: keys, span_pos, name, start_line, end_line.
    Distinct ranges of blocks get their span, see _least_overlapping; wider rows move once. A reversed span belongs
    to blocks that hold both its lines; those meet on the bin of its end.
    """
    placed = _lines_of(blocks)
    ranges = spans.where("span_pos is not null").select(*keys, F.col("start_line").alias("_from"), F.col("end_line").alias("_to"), F.struct("span_pos", "name").alias("least"))
    first = _least_overlapping(placed, ranges, keys)
    back = ranges.where("_to < _from").groupBy(*keys, "_from", "_to").agg(F.min("least").alias("least")).withColumn("_bin", F.floor(F.col("_to") / BIN)).hint("merge").alias("s")
    wide = placed.where("_to > _from").select(*keys, "_from", "_to").distinct().withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / BIN), F.floor(F.col("_to") / BIN)))).alias("b")
    same = [F.col(f"b.{k}") == F.col(f"s.{k}") for k in [*keys, "_bin"]]
    reversed_ = wide.join(back, [*same, F.col("b._from") <= F.col("s._to"), F.col("s._from") <= F.col("b._to")]).select("b.*", "s.least").drop("_bin")
    least = first.unionByName(reversed_).groupBy(*keys, "_from", "_to").agg(F.min("least").alias("least"))
    return placed.join(least.hint("merge"), [*keys, "_from", "_to"], "left").select("block_id", *[c for c in blocks.columns if c != "block_id"], "least.name", "least.span_pos")


def branch_of_block(blocks: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with the shortest branch that overlaps it, the first of equals (null without one). A reversed range is its start."""
    placed = _lines_of(blocks)
    size = F.col("_to") - F.col("_from")
    ranges = _lines_of(branches).select(*keys, "_from", "_to", F.struct(size.alias("size"), "branch_pos").alias("least"))
    least = _least_overlapping(placed, ranges, keys)
    return placed.join(least.hint("merge"), [*keys, "_from", "_to"], "left").select("block_id", *[c for c in blocks.columns if c != "block_id"], "least.branch_pos")


def blocks_with_return(blocks: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks that any return overlaps. A reversed range is its start."""
    b, s = (_binned(_forward(x)).alias(n) for x, n in ((blocks.select(*keys, "block_id", "start_line", "end_line"), "b"), (returns.select(*keys, "start_line", "end_line"), "s")))
    same = [F.col(f"b.{k}") == F.col(f"s.{k}") for k in [*keys, "_bin"]]
    hit = b.join(s.hint("merge"), [*same, _overlap("b", "s")], "left_semi").select("b.block_id")
    return blocks.join(hit.hint("merge"), "block_id", "left_semi")


#: Texts that mark an error path, or a returned value.
ERROR_MARKS = ("Err(", "None", "return null", "throw ", "Exception", "error", "Error")
RETURN_MARKS = ("return", "Ok(", "Some(")
GO_ERROR_MARKS = ("return nil", "error", "err")


def _any_of(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def has_keyword(text: Column, keyword: str) -> Column:
    """Whether a block starts with a keyword or holds it as a word after a space or line break."""
    return F.startswith(text, F.lit(keyword)) | F.contains(text, F.lit(f"\n{keyword} ")) | F.contains(text, F.lit(f" {keyword} "))


def gap_type(source: Column) -> Column:
    """The kind of a gap by the source text of its lines; the first rule that holds counts."""
    text = trim(source)
    branch = has_keyword(text, "if") | has_keyword(text, "match") | has_keyword(text, "switch")
    return F.when(branch, "branch").when(_any_of(text, ERROR_MARKS), "error_path").when(_any_of(text, RETURN_MARKS), "return_path").otherwise("statement")


def missing_branch(source: Column) -> Column:
    """What a gap leaves uncovered, in words."""
    text = trim(source)
    return (
        F.when(has_keyword(text, "if"), F.concat(F.lit(V.MISSING_IF), condition(text, "if")))
        .when(has_keyword(text, "match"), V.MISSING_MATCH)
        .when(has_keyword(text, "switch"), V.MISSING_SWITCH)
        .when(_any_of(text, ERROR_MARKS), V.MISSING_ERROR)
        .when(_any_of(text, RETURN_MARKS), V.MISSING_RETURN)
        .otherwise(V.MISSING_STATEMENT)
    )


def go_gap_type(branch_kind: Column, has_return: Column, source: Column) -> Column:
    """The kind of a gap where branches and returns are known: a branch, else a return, else the text."""
    text = trim(source)
    error = _any_of(text, GO_ERROR_MARKS)
    return (
        F.when(branch_kind.isNotNull(), "branch")
        .when(has_return, F.when(error, "error_path").otherwise("return_path"))
        .when(error, "error_path")
        .when(F.contains(text, F.lit("return")), "return_path")
        .otherwise("statement")
    )


def condition(text: Column, keyword: str, default: str = V.SOME_CONDITION) -> Column:
    """The text behind the first occurrence of a keyword: what leading parentheses hold, up to an opening brace."""
    after = trim(F.when(F.instr(text, keyword) > 0, F.substring(text, F.instr(text, keyword) + len(keyword), F.lit(1 << 30))).otherwise(text))
    inner = F.when(F.startswith(after, F.lit("(")) & (F.instr(after, ")") > 1), F.substring(after, F.lit(2), F.instr(after, ")") - 2)).otherwise(after)
    bare = F.btrim(F.substring_index(inner, "{", 1), F.lit("() :"))
    return F.when(bare == "", default).otherwise(bare)


def merge_adjacent(rows: DataFrame, keys: list[str], split: int = SPLIT) -> DataFrame:
    """Neighbouring and overlapping line ranges of equal keys as one.

    rows: keys, idx, start_line, end_line, confidence, and optionally the arrays
    uncovered_lines and suggested_inputs. A range joins the ones before it if
    it starts at most one line after their end. The row of the earliest start
    gives idx; lines are united in order, inputs in order of first sight, and
    the highest confidence stays. A reversed range reaches to its start.

    Ranges of one start are folded first; what ranges reach and the islands they form
    are then scanned split by split, so one file with all ranges is many tasks.
    """
    keys_at = [*keys, "start_line"]
    first = F.struct("end_line", "idx")
    aggs = [F.max("end_line").alias("end_line"), F.min(first).alias("_first"), F.max("confidence").alias("confidence"), F.count("*").alias("members")]
    if "uncovered_lines" in rows.columns:
        aggs.append(F.array_distinct(F.flatten(F.collect_list("uncovered_lines"))).alias("uncovered_lines"))
    if "suggested_inputs" in rows.columns:
        ordered = F.array_sort(F.collect_list(F.struct("end_line", "idx", "suggested_inputs")))
        aggs.append(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["suggested_inputs"]))).alias("suggested_inputs"))
    starts = rows.groupBy(*keys_at).agg(*aggs)
    reached = running(starts, keys, "start_line", most={"_reach": F.greatest("start_line", "end_line")}, exclusive=True, split=split)
    opened = F.col("_reach").isNull() | (F.col("start_line") > F.col("_reach") + 1)
    placed = running(reached, keys, "start_line", sums={"_island": opened.cast("int")}, split=split)
    aggs = [F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min_by("_first.idx", "start_line").alias("idx"), F.max("confidence").alias("confidence"), F.sum("members").alias("members")]
    if "uncovered_lines" in rows.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("uncovered_lines")))).alias("uncovered_lines"))
    if "suggested_inputs" in rows.columns:
        ordered = F.array_sort(F.collect_list(F.struct("start_line", "suggested_inputs")))
        aggs.append(F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["suggested_inputs"]))).alias("suggested_inputs"))
    return placed.groupBy(*keys, "_island").agg(*aggs).drop("_island")
