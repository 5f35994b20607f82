"""Failures: category, confidence, extracted values, repair tasks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V


def holds_any(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(m)) for m in markers))


def got_and_want(error: Column) -> tuple[Column, Column]:
    """Actual and expected value of an assertion message by the first pattern that fits; empty without one."""
    text = T.trim(error)
    values = [F.lit(""), F.lit("")]
    for pattern in reversed(V.ASSERTION_PATTERNS):
        fits = text.rlike(pattern)
        values = [F.when(fits, T.trim(F.regexp_extract(text, pattern, i))).otherwise(value) for i, value in enumerate(values, 1)]
    return values[0], values[1]


def is_mismatch(error: Column, expected: Column, received: Column) -> Column:
    low = F.lower(error)
    has = lambda w: F.contains(low, F.lit(w))
    got, want = got_and_want(error)
    both = (T.trim(F.coalesce(expected, F.lit(""))) != "") & (T.trim(F.coalesce(received, F.lit(""))) != "")
    words = (has("got") & has("want")) | (has("expected") & (has("received") | has(" to be ") | has(" to equal "))) | has("expect(received)")
    return both | words | ((has("want") | has("expected")) & (got != "") & (want != ""))


def category(error: Column, expected: Column | None = None, received: Column | None = None) -> Column:
    """The category of a failure: the first rule that holds."""
    low = F.lower(error)
    has = lambda *ws: holds_any(low, ws)
    none = F.lit("")
    return (
        F.when(holds_any(low, V.MODULE_MARKERS), "module_resolution")
        .when(holds_any(low, V.PYTHON_IMPORT_MARKERS), "python_import_error")
        .when(holds_any(low, V.COMPILE_MARKERS), "compile_error")
        .when(is_mismatch(error, none if expected is None else expected, none if received is None else received), "expectation_mismatch")
        .when(has("index out of range"), "index_out_of_range")
        .when(has("division by zero", "divide by zero"), "divide_by_zero")
        .when(has("nil pointer", "invalid memory address", "panic: runtime error"), "runtime_panic")
        .when(has("undefined:"), "undefined_symbol")
        .when(has("type mismatch", "cannot use"), "type_mismatch")
        .otherwise("generic_failure")
    )


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def repair_commands(source_file: Column, test_file: Column) -> Column:
    """The command that runs a test again, by the file's extension."""
    target = T.first_non_empty(test_file, source_file)
    ext, tested = F.lower(T.extension(target)), T.trim(test_file) != ""
    return (
        F.when(ext == ".go", "go test ./...")
        .when(ext == ".py", F.when(tested, F.concat(F.lit("pytest "), test_file)).otherwise("pytest"))
        .when(ext.isin(".js", ".jsx", ".ts", ".tsx"), F.when(tested, F.concat(F.lit("npm test -- "), test_file)).otherwise("npm test"))
        .when(ext == ".rs", "cargo test")
        .when(ext == ".java", "mvn test")
    )


def is_test_file(path: Column) -> Column:
    """Whether a path looks like a test's."""
    name = F.lower(T.base_name(path))
    return F.contains(name, F.lit(V.TEST_FILE_PART)) | F.startswith(name, F.lit(V.TEST_FILE_START)) | reduce(or_, (F.endswith(name, F.lit(e)) for e in V.TEST_FILE_ENDS))


def same_path(a: Column, b: Column) -> Column:
    """Equal after "./" and double slashes go, or one a whole-segment suffix of the other."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(T.trim(x), r"(^|/)\./", "$1"), "/+", "/")
    x, y = clean(a), clean(b)
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("/"), y)) | F.endswith(y, F.concat(F.lit("/"), x)))


def context_file(file: Column, source_file: Column, test_file: Column) -> Column:
    """The file whose line explains a failure: source, test, or by the look of its path."""
    return (
        F.when((F.coalesce(source_file, F.lit("")) != "") & same_path(file, source_file), source_file)
        .when((F.coalesce(test_file, F.lit("")) != "") & same_path(file, test_file), test_file)
        .when(T.trim(file) == "", source_file)
        .when(is_test_file(file), test_file)
    )


def fix_suggestions(failures: DataFrame) -> DataFrame:
    """Failures (test_name, file, line, error, expected, received, source_file, test_file) with category,
    confidence and the fields of their repair task."""
    file = F.when(F.coalesce(F.col("file"), F.lit("")) == "", F.col("source_file")).otherwise(F.col("file"))
    rows = failures.withColumn("file", file).withColumn("category", category(F.col("error"), F.col("expected"), F.col("received")))
    rows = rows.withColumn("confidence", lookup(F.col("category"), V.CATEGORY_CONFIDENCE)).withColumn("assertion_focus", lookup(F.col("category"), V.CATEGORY_FOCUS))
    rows = rows.withColumn("context_file", F.coalesce(context_file(F.col("file"), F.col("source_file"), F.col("test_file")), F.lit("")))
    rows = rows.withColumn("target_file", T.first_non_empty("context_file", "file", "source_file"))
    rows = rows.withColumn("repair_id", T.repair_id("category", "test_name", "target_file", "line"))
    return rows.withColumn("suggested_command", repair_commands(F.col("source_file"), F.coalesce(F.col("test_file"), F.lit(""))))
