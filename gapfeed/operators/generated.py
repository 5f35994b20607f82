"""Generated test code and its metadata: counts, review marks, names, missing imports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapfeed.functions import text as T
from gapfeed.functions import vocabulary as V
from gapfeed.operators.failures import holds_any, lookup, same_path


def _kind(path: Column) -> Column:
    """The lower-case extension of a file name, or a bare extension; script kinds are ".js"."""
    ext = F.lower(F.when(F.startswith(path, F.lit(".")), path).otherwise(T.extension(path)))
    return F.when(ext.isin(*V.SCRIPT_EXTENSIONS), ".js").otherwise(ext)


def review_action(code: Column, path: Column) -> Column:
    """manual_review where generated tests hold a mark of their language, else ready."""
    kind = _kind(path)
    marked = reduce(or_, ((kind == k) & holds_any(code, marks) for k, marks in V.REVIEW_MARKS.items()))
    return F.when(marked, "manual_review").otherwise("ready")


def language(path: Column) -> Column:
    return lookup(_kind(path), {".go": "go", ".js": "javascript", ".py": "python", ".rs": "rust", ".java": "java"})


def looks_like_tests(code: Column, path: Column) -> Column:
    """Whether code looks like tests of the language of its path; true for other languages."""
    name = language(path)
    rules = reduce(lambda done, kv: done.when(name == kv[0], code.rlike(kv[1])), V.TEST_CODE.items(), F.when(name.isNull(), True))
    return rules.otherwise(True)


def _occurrences(code: Column, mark: str) -> Column:
    return (F.length(code) - F.length(F.replace(code, F.lit(mark), F.lit("")))) / len(mark)


def case_count(code: Column, path: Column) -> Column:
    """How many tests generated code holds."""
    kind, lines = _kind(path), F.split(code, "\n")
    starting = lambda *ps: F.size(F.filter(lines, lambda x: reduce(or_, (F.startswith(x, F.lit(p)) for p in ps))))
    n = (
        F.when(kind == ".go", starting("func Test"))
        .when(kind == ".js", _occurrences(code, "it('") + _occurrences(code, 'it("'))
        .when(kind == ".py", starting("def test_", "    def test_"))
        .when(kind == ".rs", _occurrences(code, "#[test]"))
        .when(kind == ".java", _occurrences(code, "@Test"))
        .otherwise(0)
    )
    return n.cast("int")


def missing_imports(existing: Column, generated: Column) -> Column:
    """The generated imports that aren't there yet, each once, in order."""
    return F.array_except(generated, existing)


def provider_action(kind: Column) -> Column:
    return F.coalesce(lookup(kind, V.PROVIDER_ACTIONS), F.lit(V.PROVIDER_OTHER))


def database_dependent(text: Column, gap_type: Column) -> Column:
    """Whether a task needs a database to fail: a hint at one and a hint at an error."""
    low = F.lower(text)
    return holds_any(low, V.DATABASE_WORDS) & ((T.trim(gap_type) == "error_path") | holds_any(low, V.ERROR_WORDS))


def distinct_paths(paths: Column) -> Column:
    """Paths without blanks and without those equivalent to one before."""
    kept = F.filter(F.transform(paths, T.trim), lambda p: p.isNotNull() & (p != ""))
    none = F.array().cast("array<string>")
    return F.aggregate(kept, none, lambda done, p: F.when(F.exists(done, lambda d: same_path(d, p)), done).otherwise(F.concat(done, F.array(p))))


def comment(text: Column) -> Column:
    """A comment on one line, cut to 400 bytes; a character that the cut splits is replaced."""
    line = T.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    head = T.trim(F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, V.COMMENT_BYTES).cast("string")))
    return F.when(F.octet_length(line) <= V.COMMENT_BYTES, line).otherwise(F.concat(head, F.lit("...")))


def python_test_name(name: Column, fallback: Column) -> Column:
    """A Python test's name: letters, digits and single underscores, beginning with test_."""
    said = T.trim(name)
    said = F.when(said == "", fallback).otherwise(said)
    said = F.regexp_replace(F.regexp_replace(said, "^def ", ""), r"\(\)$", "")
    # other characters become one underscore, except where one is there already
    bare = F.regexp_replace(F.regexp_replace(said, r"^[^\p{L}_]+", ""), r"(?<=_)[^\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+", "\u0001")
    bare = F.replace(F.replace(bare, F.lit("_\u0001"), F.lit("_")), F.lit("\u0001"), F.lit("_"))
    bare = F.btrim(bare, F.lit("_"))
    got = F.when(bare == "", fallback).otherwise(bare)
    return F.when(F.startswith(got, F.lit("test_")), got).otherwise(F.concat(F.lit("test_"), got))
