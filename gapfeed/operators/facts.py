"""What source files import and declare: one scan of all files, and the files that declare what others import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.functions.text import trim
from gapfeed.operators.imports import module_files, named_imports, only_imports_and_exports

#: Go's import declarations, and the text before the first other declaration.
_GO_IMPORTS = "(?ms)^import\\s*(?:\\([^)]*\\)|(?:[\\w.]+\\s+)?(?:\"[^\"\\n]*\"|`[^`]*`))"
_GO_HEAD = r"(?ms)\A(.*?)(?:^(?:func|type|var|const)\b|\z)"
_PYTHON_FROM = r"^from\s+(\S+)\s+import\s+(.+)$"


def language(path: Column) -> Column:
    """The language of a path by its end; "" for others."""
    end = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    return F.coalesce(*[F.when(end == e, name) for e, name in V.LANGUAGES.items()], F.lit(""))


def _lines(source: Column, *patterns: tuple[str, int]) -> Column:
    """What patterns find, one after the other: trimmed, without a last semicolon, each text once where it is first."""
    found = F.concat(*[F.regexp_extract_all(source, F.lit(p), F.lit(g)) for p, g in patterns])
    bare = F.transform(found, lambda x: F.regexp_replace(trim(x), ";$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x != ""))


def _go_paths(source: Column) -> Column:
    """Import paths of a Go file as they are quoted, in order."""
    head = F.regexp_replace(F.regexp_extract(source, _GO_HEAD, 1), r"(?s)//[^\n]*|/\*.*?\*/", "")
    return F.flatten(F.transform(F.regexp_extract_all(head, F.lit(_GO_IMPORTS), F.lit(0)), lambda d: F.regexp_extract_all(d, F.lit("\"[^\"\\n]*\"|`[^`]*`"), F.lit(0))))


def source_facts(files: DataFrame) -> DataFrame:
    """(file, language, imports, types) of files (file, source), lists in order of first sight.

    Scripts: import lines, then require lines; Python: import lines; Go: quoted import paths. Types are those of scripts
    and the classes of Python. Other files, and null sources, have none.
    """
    s, kind = F.coalesce("source", F.lit("")), language(F.col("file"))
    none = F.array().cast("array<string>")
    script, python = kind.isin("typescript", "javascript"), kind == "python"
    imports = F.when(script, _lines(s, (V.SCRIPT_IMPORT_LINE, 0), (V.SCRIPT_REQUIRE_LINE, 0))).when(python, _lines(s, (V.PYTHON_IMPORT_LINE, 0))).when(kind == "go", _go_paths(s)).otherwise(none)
    types = F.when(script, _lines(s, (V.SCRIPT_TYPE_LINE, 1))).when(python, _lines(s, (V.PYTHON_TYPE_LINE, 1))).otherwise(none)
    return files.select("file", kind.alias("language"), imports.alias("imports"), types.alias("types"))


def declared_types(facts: DataFrame) -> DataFrame:
    """(symbol, file): an index of the types that files declare."""
    return facts.select(F.explode("types").alias("symbol"), "file")


def imported_types(files: DataFrame) -> DataFrame:
    """(file, symbol, declared_in): types that a file imports by name from files that declare them themselves.

    Scripts: relative modules, the first candidate that declares the symbol. Python: `from a.b import C`, declared in a/b.py,
    a/b/__init__.py or one of them below src/. Imports and declarations meet on (file, symbol).
    """
    facts = source_facts(files)
    index = declared_types(facts).withColumnRenamed("file", "declared_in")
    scripts = named_imports(files.where(language(F.col("file")).isin("typescript", "javascript"))).select("file", F.col("name").alias("symbol"), F.posexplode(module_files(F.col("file"), F.col("module"))).alias("rank", "declared_in"))
    lines = facts.where("language = 'python'").select("file", F.explode("imports").alias("line")).where(F.col("line").rlike(_PYTHON_FROM))
    base = F.replace(F.regexp_extract("line", _PYTHON_FROM, 1), F.lit("."), F.lit("/"))
    names = F.transform(F.split(F.regexp_replace(F.regexp_extract("line", _PYTHON_FROM, 2), r"[()]|#.*$", ""), ","), lambda x: trim(F.regexp_replace(trim(x), r"\s+as\s+.*$", "")))
    places = F.array(*[F.concat(F.lit(root), base, F.lit(end)) for root in ("", "src/") for end in (".py", "/__init__.py")])
    python = lines.select("file", F.explode(names).alias("symbol"), places.alias("_p")).select("file", "symbol", F.posexplode("_p").alias("rank", "declared_in"))
    met = scripts.unionByName(python).join(index, ["symbol", "declared_in"])
    return met.groupBy("file", "symbol").agg(F.min_by("declared_in", "rank").alias("declared_in"))


def without_runtime(files: DataFrame, spans: DataFrame) -> DataFrame:
    """(file) of the TypeScript files without functions and classes that declare types, or hold imports and exports only.
    files: file, source; spans: file of every function that was found."""
    code = F.coalesce("source", F.lit(""))
    classes = code.rlike(r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\b")
    typed = F.size(_lines(code, (V.SCRIPT_TYPE_LINE, 1))) > 0
    plain = files.where((language(F.col("file")) == "typescript") & F.col("source").isNotNull() & ~classes & (typed | only_imports_and_exports(F.col("source"))))
    return plain.select("file").join(spans.select("file").distinct(), "file", "left_anti")
