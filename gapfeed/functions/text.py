"""Scalar functions over names, ids, line ranges and messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V

#: Unicode white space at either end (SQL trim takes spaces only).
_ENDS = r"(?U)^\s+|\s+$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), _ENDS, "")


def non_empty(x: Column | str) -> Column:
    """Null where a string is null or white space."""
    c = _c(x)
    return F.when(trim(c) != "", c)


def first_non_empty(*xs: Column | str) -> Column:
    """The first string that isn't blank; the empty string if all are."""
    return F.coalesce(*[non_empty(x) for x in xs], F.lit(""))


def framework_name(x: Column | str) -> Column:
    return F.lower(trim(x))


def identifier_words(x: Column | str) -> Column:
    """Runs of ASCII letters and digits; camel case stays together."""
    return F.filter(F.split(_c(x), "[^A-Za-z0-9]+"), lambda w: w != "")


def pascal_case(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def snake_case(words: Column) -> Column:
    return F.lower(F.array_join(words, "_"))


def slug(x: Column | str) -> Column:
    """Lower case, everything but a-z and 0-9 as single dashes, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def base_name(path: Column | str) -> Column:
    """The last element of a slash path; "." for the empty path, "/" for one of slashes only."""
    p = _c(path)
    bare = F.regexp_replace(p, "/+$", "")
    return F.when(p == "", ".").when(bare == "", "/").otherwise(F.substring_index(bare, "/", -1))


def extension(path: Column | str) -> Column:
    """From the last dot of the last element; empty without one."""
    return F.regexp_extract(_c(path), r"(\.[^./]*)$", 1)


def directory(path: Column | str) -> Column:
    """A path up to its last slash; "." without one."""
    p = _c(path)
    return F.when(F.instr(p, "/") == 0, ".").otherwise(F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def without_extension(path: Column | str) -> Column:
    p = _c(path)
    return F.left(p, F.char_length(p) - F.char_length(extension(p)))


def repair_id(category: Column | str, test_name: Column | str, file: Column | str, line: Column | str) -> Column:
    """repair-<category>-<slug of the test's name, or of the file and line>."""
    name = trim(test_name)
    seed = F.when(name != "", name).otherwise(F.concat(base_name(file), F.when(_c(line) > 0, F.concat(F.lit("-"), _c(line).cast("string"))).otherwise("")))
    part = slug(seed)
    return F.concat(F.lit("repair-"), F.when(_c(category) == "", "generic_failure").otherwise(_c(category)), F.lit("-"), F.when(part == "", "failure").otherwise(part))


def line_numbers(start: Column | str, end: Column | str) -> Column:
    """All lines of a range; a reversed one is its start."""
    return F.sequence(_c(start), F.greatest(_c(start), _c(end)))


def strict_range(x: Column | str) -> Column:
    """struct(start, end) of "a-b" with positive numbers, a reversed end clamped to the start; null otherwise."""
    parts = F.split(_c(x), "-")
    a, b = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    ok = (F.size(parts) == 2) & F.get(parts, 0).rlike(r"^[0-9+]+$") & F.get(parts, 1).rlike(r"^[0-9+]+$") & (a > 0) & (b > 0)
    return F.when(ok, F.struct(a.alias("start"), F.greatest(a, b).alias("end")))


def lenient_range(x: Column | str) -> Column:
    """struct(start, end) of "a" or "a-b", a reversed one swapped; null otherwise."""
    t = trim(x)
    parts = F.split(t, "-", 2)
    a, b = trim(F.get(parts, 0)).try_cast("int"), trim(F.get(parts, 1)).try_cast("int")
    b = F.when(F.size(parts) == 2, b).otherwise(a)
    ok = (t != "") & (F.lower(t) != "entire file") & (a > 0) & (b > 0)
    return F.when(ok, F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end")))


def ints_csv(xs: Column | str) -> Column:
    return F.array_join(F.transform(_c(xs), lambda x: x.cast("string")), ",")


def parameter_names(x: Column | str) -> Column:
    """Names of a parameter list: self forms dropped, "name: T" gives the name, "T name" the last word."""
    parts = F.transform(F.split(_c(x), ","), trim)
    parts = F.filter(parts, lambda p: ~p.isin("", "self", "&self", "&mut self", "mut self"))
    return F.transform(parts, lambda p: F.when(F.instr(p, ":") > 0, trim(F.substring_index(p, ":", 1))).otherwise(F.element_at(F.split(p, r"\s+"), -1)))


def input_hints(params: Column | str) -> Column:
    """A suggestion for each parameter."""
    return F.transform(_c(params), lambda p: F.when(p.isin("", "arg"), V.HINT_ARGUMENT).otherwise(F.concat(F.lit(V.HINT_SET), p, F.lit(V.HINT_TO_COVER))))


def index_and_length(x: Column | str) -> Column:
    """struct(index, length) of an "index out of range [i] with length n" message."""
    pattern = r"index out of range \[?(-?\d+)\]?.*length (\d+)"
    return F.struct(F.regexp_extract(_c(x), pattern, 1).alias("index"), F.regexp_extract(_c(x), pattern, 2).alias("length"))


def failure_location(x: Column | str) -> Column:
    """struct(file, line, message) of "file:line: message"; null otherwise."""
    pattern = r"^\s*([^:\s][^:]*):([+-]?[0-9]+):\s*(.*)$"
    c = _c(x)
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("file"), F.regexp_extract(c, pattern, 2).try_cast("int").alias("line"), trim(F.regexp_extract(c, pattern, 3)).alias("message")))


def coverage_percent(x: Column | str) -> Column:
    """The number after "coverage:" in a line, null without one."""
    return F.regexp_extract(_c(x), r"coverage:\s*([0-9.]+)%", 1).try_cast("double")


def replace_identifier(expression: Column | str, name: Column | str, value: Column | str) -> Column:
    """An expression with a whole name replaced by a value, which is taken as it is; an empty name replaces nothing."""
    e, n, v = _c(expression), _c(name), _c(value)
    literal = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.when(n == "", e).otherwise(F.regexp_replace(e, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b")), literal))


def path_below(path: Column, folder: Column) -> Column:
    """A cleaned path relative to a cleaned folder, "." for the folder itself; null if it lies elsewhere."""
    inside = F.when(folder == "/", F.startswith(path, F.lit("/"))).otherwise(F.startswith(path, F.concat(folder, F.lit("/"))))
    skip = F.when(folder == "/", 1).otherwise(F.char_length(folder) + 1)
    return F.when(path == folder, ".").when(inside, F.substring(path, skip + 1, F.lit(1 << 30)))
