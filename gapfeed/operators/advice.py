"""What to do about a failure, in words, with the lines around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators.failures import fix_suggestions, got_and_want, is_test_file, lookup, same_path
from gapfeed.operators.sources import line_text


def after_token(text: Column, token: str, end: str = "") -> Column:
    """What follows a word (in any case) in a text, up to an end mark if there is one; empty without the word."""
    at = F.instr(F.lower(text), token)
    rest = F.substring(text, at + len(token), F.length(text))
    if end:
        rest = F.when(F.instr(rest, end) > 1, F.substring_index(rest, end, 1)).otherwise(rest)
    return F.when(at > 0, F.rtrim(T.trim(rest), F.lit(".!;"))).otherwise("")


def _shown(value: Column) -> Column:
    return F.when(T.trim(value) == "", V.ADVICE_UNKNOWN).otherwise(value)


def advice(category: Column, error: Column, expected: Column, received: Column, source_line: Column, test_line: Column) -> Column:
    """The advice for a failure, its lines each ended by a line break."""
    none = F.lit("")
    expected, received, source_line, test_line = (F.coalesce(x, none) for x in (expected, received, source_line, test_line))
    got, want = got_and_want(error)
    bare = (received == "") & (expected == "")
    got, want = F.when(bare, got).otherwise(received), F.when(bare, want).otherwise(expected)
    got = F.when(got == "", after_token(error, "got", ",")).otherwise(got)
    want = F.when(want == "", after_token(error, "want")).otherwise(want)
    at = T.index_and_length(error)
    symbol = T.trim(F.when(F.instr(F.lower(error), "undefined:") > 0, F.substring(error, F.instr(F.lower(error), "undefined:") + 10, F.length(error))).otherwise(""))
    index = (at["index"] != "") | (at["length"] != "")
    heads, steps = ({c: f(a) for c, a in V.ADVICE.items()} for f in (lambda a: a[0], lambda a: "\n".join(a[1])))
    detail = (
        F.when(category == "expectation_mismatch", F.concat(F.lit("\n" + V.ADVICE_GOT), _shown(got), F.lit("\n" + V.ADVICE_WANT), _shown(want), F.lit("\n")))
        .when((category == "index_out_of_range") & index, F.concat(F.lit("\n" + V.ADVICE_INDEX), _shown(at["index"]), F.lit("\n" + V.ADVICE_LENGTH), _shown(at["length"])))
        .when((category == "undefined_symbol") & (symbol != ""), F.concat(F.lit("\n" + V.ADVICE_SYMBOL), symbol))
        .when(category == "generic_failure", error)
        .when(category.isin(*V.ADVICE_WITH_ERROR), F.concat(F.lit("\n" + V.ADVICE_ERROR), error))
        .otherwise("")
    )
    before = F.when(category == "expectation_mismatch", "\n" + V.ADVICE_CAUSES + "\n").otherwise("\n" + V.ADVICE_STEPS + "\n")
    near = lambda shown, head, line: F.when(category.isin(*shown) & (T.trim(line) != ""), F.concat(F.lit("\n" + head + "\n"), T.trim(line), F.lit("\n"))).otherwise("")
    return F.concat(lookup(category, heads), detail, before, lookup(category, steps), F.lit("\n"), near(V.ADVICE_WITH_SOURCE, V.ADVICE_SOURCE, source_line), near(V.ADVICE_WITH_TEST, V.ADVICE_TEST, test_line))


def advised(failures: DataFrame, files: DataFrame) -> DataFrame:
    """Failures (test_name, file, line, error, expected, received, source_file, test_file) with category, advice
    and the line that explains them. files: (file, source) of sources and tests.

    The line comes from the source file if the failure names it or no file, else from the test
    file if the failure names that or a path that looks like a test's; else there is none.
    """
    rows = fix_suggestions(failures.withColumn("_said", F.coalesce("file", F.lit(""))))
    said, source, test = F.col("_said"), F.coalesce(F.col("source_file"), F.lit("")), F.coalesce(F.col("test_file"), F.lit(""))
    in_source = same_path(said, source)
    in_test = ~in_source & (((test != "") & same_path(said, test)) | (said != "") & is_test_file(said))
    where = F.when(F.col("line") <= 0, "").when(in_source | (said == ""), source).when(in_test, test).otherwise("")
    rows = line_text(rows.withColumn("_where", where).withColumn("_line", F.col("line")), files, "_where", "_line")
    line = F.coalesce(F.col("context_line"), F.lit(""))
    text = advice(F.col("category"), F.col("error"), F.col("expected"), F.col("received"), F.when(in_test, "").otherwise(line), F.when(in_test, line).otherwise(""))
    return rows.withColumn("suggested_fix", text).drop("_said", "_where", "_line")
