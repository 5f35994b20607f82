"""One job from coverage blocks and sources to merged suggestions and ranked tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators import gaps, tasks
from gapfeed.operators.sources import resolve_paths, texts_of
from gapfeed.shipping import materialize
from gapfeed.sources.go_source import go_structure
from gapfeed.sources.spans import source_spans

#: The place of a whole file's suggestion, after all of its blocks.
_LAST = (1 << 62)


def _branch_inputs(params: Column, condition: Column) -> Column:
    hints = T.input_hints(params)
    return F.when((condition != "") & (condition != V.SOME_CONDITION), F.concat(F.array(F.concat(F.lit(V.HINT_CONDITION), condition, F.lit(V.HINT_INPUT))), hints)).otherwise(hints)


def _go_missing(kind: Column, condition: Column, gap: Column) -> Column:
    return (
        F.when(kind == "if", F.concat(F.lit(V.MISSING_IF), F.when(condition == "", V.SOME_CONDITION).otherwise(condition)))
        .when(kind == "select", V.MISSING_SELECT)
        .when(kind.isNotNull(), V.MISSING_SWITCH)
        .when(gap == "error_path", V.MISSING_ERROR)
        .when(gap == "return_path", V.MISSING_RETURN)
        .otherwise(V.MISSING_STATEMENT)
    )


def _reason() -> Column:
    said = F.when(T.framework_name("framework") == "go-test", V.REASON_IN_GO).otherwise(V.REASON_IN_OTHER)
    return F.when(F.col("function") != "", F.concat("function", said)).otherwise(V.REASON_BLOCK)


def located(blocks: DataFrame, spans: DataFrame, sources: DataFrame, branches: DataFrame, returns: DataFrame) -> DataFrame:
    """Uncovered blocks with function, kind, gap type, missing branches, lines, hints and confidence.

    Branches and returns are those of Go files.

    blocks: framework, file, source_file (where its text is; null if unknown), block_id, start_line, end_line.
    A block outside all functions has none of them.
    """
    placed = blocks.withColumnsRenamed({"file": "_path", "source_file": "file"})
    found = gaps.span_of_block(placed, spans, ["file"]).drop("name")
    span = spans.select("file", "span_pos", F.col("name").alias("function"), "kind", "params", F.col("start_line").alias("_from"), F.col("end_line").alias("_to"))
    # what Spark takes sizes of derived rows for is far too low for a broadcast
    found = found.join(span.hint("merge"), ["file", "span_pos"], "left")
    inside = found.where(F.col("function").isNotNull())
    cut = inside.select(F.col("block_id").alias("key"), "file", F.greatest("start_line", "_from").alias("start_line"), F.least("end_line", "_to").alias("end_line")).where("start_line <= end_line")
    texts = texts_of(cut, sources).select(F.col("key").alias("block_id"), "text")
    of_go = inside.where(T.framework_name("framework") == "go-test")
    near = gaps.branch_of_block(of_go, branches, ["file"]).select("block_id", "file", "branch_pos")
    returning = gaps.blocks_with_return(of_go.select("block_id", "file", "start_line", "end_line"), returns, ["file"]).select("block_id", F.lit(True).alias("_returns"))
    branch = near.join(branches.select("file", "branch_pos", F.col("kind").alias("branch_kind"), "condition").hint("merge"), ["file", "branch_pos"]).select("block_id", "branch_kind", "condition")
    rows = found.join(texts.hint("merge"), "block_id", "left").join(branch.hint("merge"), "block_id", "left").join(returning.hint("merge"), "block_id", "left")
    # each derived text is a column of its own: the rules below name it many times
    rows = rows.withColumn("text", T.trim(F.coalesce("text", F.lit(""))))
    text, known = F.col("text"), F.col("function").isNotNull()
    go = T.framework_name("framework") == "go-test"
    gap = F.when(known, F.when(go, gaps.go_gap_type(F.col("branch_kind"), F.coalesce("_returns", F.lit(False)), text)).otherwise(gaps.gap_type(text)))
    condition = F.when(go, F.when(F.col("branch_kind") == "if", F.col("condition")).otherwise("")).when(gaps.has_keyword(text, "if"), gaps.condition(text, "if")).otherwise("")
    missing = F.when(go, _go_missing(F.col("branch_kind"), F.col("condition"), F.col("_gap"))).otherwise(gaps.missing_branch(text))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_gap": gap, "_condition": condition})
    return rows.select(
        *[c for c in blocks.columns if c not in ("file", "source_file")], F.col("_path").alias("file"),
        F.coalesce("function", F.lit("")).alias("function"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("_gap", F.lit("")).alias("gap_type"),
        F.when(known, F.array(missing)).otherwise(none).alias("missing_branches"),
        F.when(known, T.line_numbers("start_line", "end_line")).otherwise(F.array().cast("array<int>")).alias("uncovered_lines"),
        F.when(known, _branch_inputs(F.col("params"), F.col("_condition"))).otherwise(none).alias("suggested_inputs"),
        F.when(known & go, 0.95).otherwise(0.9).alias("confidence"),
    )


def suggestions(files: DataFrame, found: DataFrame) -> DataFrame:
    """Located blocks merged with their neighbours, and a row for each file below 50 percent.
    files: report, framework, file, percent; found: located() with report and idx."""
    keys = ["report", "framework", "file", "function", "kind", "gap_type", "_missing"]
    merged = gaps.merge_adjacent(found.withColumn("_missing", F.array_join("missing_branches", "\0")), keys)
    # what all members of a merged range share is read from its keys
    missing = F.when(F.col("_missing") == "", F.array().cast("array<string>")).otherwise(F.split("_missing", "\0"))
    blocks = merged.withColumn("missing_branches", missing).withColumn("line_range", F.concat_ws("-", "start_line", "end_line")).withColumn("reason", _reason())
    names = ["report", "framework", "idx", "file", "function", "kind", "line_range", "gap_type", "missing_branches", "uncovered_lines", "suggested_inputs", "reason", "confidence"]
    low = files.where(F.col("percent") < 50).select(
        "report", "framework", F.lit(_LAST).alias("idx"), "file", F.lit("").alias("function"), F.lit("").alias("kind"), F.lit("entire file").alias("line_range"), F.lit("").alias("gap_type"),
        F.array().cast("array<string>").alias("missing_branches"), F.array().cast("array<int>").alias("uncovered_lines"), F.array().cast("array<string>").alias("suggested_inputs"),
        F.format_string(V.REASON_LOW_FILE, F.col("percent").cast("double")).alias("reason"), F.lit(0.8).alias("confidence"),
    )
    return blocks.select(names).unionByName(low.select(names))


def structure_of(sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, branches, returns) of source files (file, source), written once: each is read by several joins."""
    go_spans, branches, returns = go_structure(sources)
    others = source_spans(sources.where(~F.endswith("file", F.lit(".go"))))
    spans = others.unionByName(go_spans.select(others.columns))
    return materialize(spans, "spans"), materialize(branches, "branches"), materialize(returns, "returns")


def coverage_suggestions(files: DataFrame, blocks: DataFrame, sources: DataFrame, structure: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Suggestions of coverage reports.

    files: report, framework, file, percent; blocks: report, file, block_id (unique), start_line, end_line, covered;
    sources: file, source. Spans, branches and returns are read from the sources unless given.
    Reported paths are resolved to sources; what can't be resolved gets plain suggestions. Only
    the files that reports name are read for their structure.
    """
    files = materialize(files, "files")  # read by several joins, where it would be counted anew each time
    where = materialize(resolve_paths(files.select(F.col("file").alias("path")), sources).withColumnsRenamed({"file": "source_file", "path": "file"}), "resolved")
    needed = materialize(sources.join(where.where("source_file is not null").select(F.col("source_file").alias("file")).distinct(), "file", "left_semi"), "sources")
    spans, branches, returns = structure_of(needed) if structure is None else structure
    # what is said of a block follows from its file and lines, and of equal ones the first counts: so they are one from here on
    same = blocks.where(~F.col("covered")).groupBy("report", "file", "start_line", "end_line").agg(F.min("block_id").alias("block_id")).withColumn("covered", F.lit(False))
    open_ = gaps.uncovered(files, same, ["report", "file"]).join(where, "file", "left")
    open_ = materialize(open_.select("report", "framework", "file", "source_file", "block_id", F.col("block_id").alias("idx"), "start_line", "end_line"), "open")
    return suggestions(files, located(open_, spans, needed, branches, returns))


def coverage_tasks(files: DataFrame, blocks: DataFrame, sources: DataFrame, structure: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ranked, numbered test tasks of coverage reports; see coverage_suggestions."""
    return tasks.from_suggestions(coverage_suggestions(files, blocks, sources, structure), "report")
