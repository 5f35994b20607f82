"""Imports and types of source files."""

from pyspark.sql import functions as F

from gapfeed.operators import detection, facts, sources

FILES = {
    "a/use.ts": "import { A, type B as C } from './lib';\nconst x = require('y') ;\nimport D from 'd'\nimport { A } from './lib'\n  export interface I {}\nclass K<T> {}\nexport abstract class No {}\n",
    "a/lib/index.ts": "export class A {}\nexport type B = 1",
    "p/m.py": "import os\nimport os\nfrom q.n import C, D as E  # note\n\nclass M(C):\n    import json\n    class Inner: pass\n",
    "src/q/n.py": "class C: pass\n class D:\n",
    "g.go": 'package g\n\n// import "no"\nimport (\n\t"fmt" // "x"\n\tm `a/b`\n\t_ "c"\n)\nimport . "os"\n\nfunc f() { s := `\nimport "never"\n` }\n',
    "J.java": "import java.util.List;\nclass J {}",
    "n.py": None,
    "none": "import x",
}


def test_facts_and_declaring_files(spark):
    files = spark.createDataFrame(list(FILES.items()), "file string, source string")
    got = {r.file: (r.language, r.imports, r.types) for r in facts.source_facts(files).collect()}
    assert got == {
        "a/use.ts": ("typescript", ["import { A, type B as C } from './lib'", "import D from 'd'", "import { A } from './lib'", "const x = require('y') "], ["I", "K"]),
        "a/lib/index.ts": ("typescript", [], ["A", "B"]),
        "p/m.py": ("python", ["import os", "from q.n import C, D as E  # note", "import json"], ["M", "Inner"]),
        "src/q/n.py": ("python", [], ["C", "D"]),
        "g.go": ("go", ['"fmt"', "`a/b`", '"c"', '"os"'], []),
        "J.java": ("java", [], []),
        "n.py": ("python", [], []),
        "none": ("", [], []),
    }
    found = sorted(map(tuple, facts.imported_types(files).collect()))
    assert found == [("a/use.ts", "A", "a/lib/index.ts"), ("a/use.ts", "B", "a/lib/index.ts"), ("p/m.py", "C", "src/q/n.py"), ("p/m.py", "D", "src/q/n.py")]
    assert facts.imported_types(files.limit(0)).count() == 0


def test_modules_and_go_paths(spark):
    mods = spark.createDataFrame([("r", "// module no\n\n module example.com/m // x\nmodule later"), ("s", "go 1.22"), ("t", "")], "report string, content string")
    modules = mods.select("report", detection.go_module(F.col("content")).alias("module"))
    assert {r.report: r.module for r in modules.collect()} == {"r": "example.com/m // x", "s": "", "t": ""}
    modules = spark.createDataFrame([("r", "example.com/m"), ("s", "")], "report string, module string")
    files = spark.createDataFrame([("pkg/a.go",), ("b.go",), ("x/pkg/a.go",)], "file string")
    paths = [("r", "example.com/m/pkg/a.go"), ("r", "./x//pkg/a.go"), ("r", "example.com/other/b.go"), ("s", "example.com/m/pkg/a.go"), ("u", "gone/../c.go"), ("r", "b.go"), ("r", "b.go")]
    got = {(r.report, r.path): r.file for r in sources.go_report_paths(spark.createDataFrame(paths, "report string, path string"), files, modules).collect()}
    assert got == {("r", "example.com/m/pkg/a.go"): "pkg/a.go", ("r", "./x//pkg/a.go"): "x/pkg/a.go", ("r", "example.com/other/b.go"): "b.go", ("s", "example.com/m/pkg/a.go"): "pkg/a.go", ("u", "gone/../c.go"): "c.go", ("r", "b.go"): "b.go"}


def test_modules_without_runtime(spark):
    files = {"t.ts": "export type A = 1\n", "e.ts": "export * from './a';\n", "c.ts": "export abstract class A {}", "f.ts": "type A = 1\nfunction g() {}", "j.js": "type A = 1", "x.tsx": "", "r.ts": "run()", "n.ts": None}
    spans = spark.createDataFrame([("f.ts",)], "file string")
    got = facts.without_runtime(spark.createDataFrame(list(files.items()), "file string, source string"), spans)
    assert sorted(r.file for r in got.collect()) == ["e.ts", "t.ts", "x.tsx"]
