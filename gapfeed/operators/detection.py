"""Which test framework a path belongs to, from the project files above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T

PACKAGE = "scripts map<string,string>, devDependencies map<string,string>, dependencies map<string,string>"
#: Folders above a path that are searched, itself included.
DEPTH = 6
#: Project files in the order in which they decide.
ORDER = ("package.json", "go.mod", "Cargo.toml", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts")


def node_test_script(script: Column) -> Column:
    s = F.lower(T.trim(script))
    return (s == "node --test") | F.startswith(s, F.lit("node --test ")) | F.contains(s, F.lit(" node --test ")) | F.startswith(s, F.lit("node --test="))


def script_framework(package: Column) -> Column:
    """The framework of a package.json: its test script, then development, then other dependencies, else jest."""
    p = F.from_json(package, PACKAGE)
    script = F.lower(F.coalesce(F.try_element_at(p["scripts"], F.lit("test")), F.lit("")))
    has = lambda part, name: F.coalesce(F.map_contains_key(p[part], F.lit(name)), F.lit(False))
    out = F.when(node_test_script(script), "node-test")
    for name in ("vitest", "mocha", "jest"):
        out = out.when(F.contains(script, F.lit(name)), name)
    for part in ("devDependencies", "dependencies"):
        for name in ("vitest", "mocha", "jest"):
            out = out.when(has(part, name), name)
    return out.otherwise("jest")


def uses_pytest(toml: Column) -> Column:
    """Whether a pyproject.toml names pytest outside comments."""
    return F.exists(F.split(toml, "\n"), lambda x: F.contains(F.lower(x), F.lit("pytest")) & ~F.startswith(T.trim(x), F.lit("#")))


def _decision(name: Column, content: Column) -> Column:
    return (
        F.when(name == "package.json", script_framework(content))
        .when(name == "go.mod", "go-test")
        .when(name == "Cargo.toml", "cargo-test")
        .when(name == "pyproject.toml", F.when(uses_pytest(content), "pytest"))
        .when(name == "setup.py", "pytest")
        .when(name.isin("pom.xml", "build.gradle", "build.gradle.kts"), "junit")
    )


def _rank(name: Column) -> Column:
    out = F.lit(len(ORDER))
    for i, n in reversed(list(enumerate(ORDER))):
        out = F.when(name == n, i).otherwise(out)
    return out


def detect_framework(paths: DataFrame, project_files: DataFrame) -> DataFrame:
    """(path, framework) for source paths (path) and project files (folder, name, content).

    An extension decides for Go, Python, Rust and Java; else the first project
    file in ORDER found in the path's folder or above (each kind from its nearest
    folder), else go-test. Paths meet project files on the folder, so each path
    costs at most DEPTH keys.
    """
    ext = T.extension("path")
    known = F.when(ext == ".go", "go-test").when(ext == ".py", "pytest").when(ext == ".rs", "cargo-test").when(ext == ".java", "junit")
    told = paths.withColumn("known", known)
    segments = F.filter(F.split(T.directory("path"), "/"), lambda s: (s != "") & (s != "."))
    script = ext.isin(".js", ".ts", ".jsx", ".tsx")
    depths = F.sequence(F.lit(0), F.least(F.size(segments), F.lit(DEPTH - 1)))
    open_ = told.where("known is null").withColumn("segments", segments).withColumn("script", script)
    above = open_.select("path", "script", F.explode(depths).alias("up"), "segments").select("path", "script", "up", F.array_join(F.slice("segments", F.lit(1), F.size("segments") - F.col("up")), "/").alias("folder"))
    found = above.join(project_files.select("folder", "name", "content"), "folder").withColumn("framework", _decision(F.col("name"), F.col("content"))).where("framework is not null")
    best = found.groupBy("path").agg(F.min_by("framework", F.struct(_rank(F.col("name")).alias("r"), F.col("up"))).alias("found"))
    return told.join(best, "path", "left").select("path", F.coalesce("known", "found", F.lit("go-test")).alias("framework"))


def go_module(content: Column) -> Column:
    """The module path of a go.mod: what its first module line names; "" without one."""
    lines = F.filter(F.transform(F.split(content, "\n"), T.trim), lambda x: F.startswith(x, F.lit("module ")))
    return F.coalesce(T.trim(F.substring(F.get(lines, 0), 8, 1 << 30)), F.lit(""))
