"""Functions of Python and JavaScript files by indentation, for files that no parser takes.

A class owns a line if it is the last class before it that is still open. A stack
would say so line by line; here each indentation that classes of a file have is a
level. At a level only its classes and the lines that close them count, so a class is
open at a line if it is the last of them: one carried value for each level, found by
scans over splits (`operators.scans`), and of the open classes the last one owns.
The end of a Python function is the nearest later line that is no deeper, by the same scan from the other side.
Rows of lines are many more than the files they come from, whose size is what Spark knows: so none is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions.text import trim
from gapfeed.operators.scans import running
from gapfeed.sources.spans import HELPERS
from gapfeed.sources.structure import by_level, following, masked, tokens

_DEF = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*:"
_NAME = r"([A-Za-z_$][\w$]*)"
_FUNCTION = rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{_NAME}\s*\(([^)]*)\)"
_VARIABLE = rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:function\s*)?(?:\(([^)]*)\)|{_NAME})\s*(?:=>|\{{)"


def parameter_list(raw: Column) -> Column:
    """Names of a parameter list: self forms dropped, "name: T" gives the name, others their last word without dots."""
    parts = F.filter(F.transform(F.split(raw, ","), trim), lambda p: ~p.isin("", "self", "&self", "&mut self"))
    return F.transform(parts, lambda p: F.when(F.instr(p, ":") > 1, trim(F.substring_index(p, ":", 1))).otherwise(F.btrim(F.element_at(F.split(p, r"\s+"), -1), F.lit("."))))


def indented_lines(files: DataFrame) -> DataFrame:
    """(file, pos, line, t, indent) of files (file, source): pos from 1, t trimmed; a tab indents by four."""
    lines = files.where("source is not null").select("file", F.posexplode(F.split("source", "\n")).alias("pos", "line"))
    lead = F.regexp_extract("line", r"^[ \t]*", 0)
    return lines.select("file", (F.col("pos") + 1).alias("pos"), "line", trim("line").alias("t"), (F.char_length(lead) + 3 * F.char_length(F.regexp_replace(lead, " ", ""))).alias("indent"))


def _levels(rows: DataFrame, of: Column) -> DataFrame:
    """(file, levels): the indentations of the rows for which `of` holds; few in any file."""
    return rows.where(of).groupBy("file").agg(F.sort_array(F.collect_set("indent")).alias("levels"))


def owners(rows: DataFrame, class_name: Column, closes: Column, asks: Column, **how) -> DataFrame:
    """(file, pos, owner, owner_indent) of the asking rows that a class owns.

    class_name: a class line's name, null for others; closes: whether a line closes the classes it is no deeper than.
    """
    rows = rows.withColumns({"_class": class_name, "_closes": closes, "_asks": asks})
    at = rows.where(F.col("_class").isNotNull() | F.col("_closes") | F.col("_asks")).join(_levels(rows, F.col("_class").isNotNull()).hint("merge"), "file")
    each = at.withColumn("level", F.explode("levels")).drop("levels")
    opens = F.col("_class").isNotNull() & (F.col("indent") == F.col("level"))
    shuts = F.col("_closes") & (F.col("indent") <= F.col("level"))
    each = each.where(opens | shuts | F.col("_asks"))
    state = F.when(opens, F.struct(F.col("pos").alias("at"), F.col("_class").alias("name"))).when(shuts, F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("name")))
    known = running(each, ["file", "level"], lasts={"_open": state}, **how).where(F.col("_asks") & F.col("_open.at").isNotNull())
    last = known.groupBy("file", "pos").agg(F.max(F.struct("_open.at", "level", "_open.name")).alias("o"))
    return last.select("file", "pos", F.col("o.name").alias("owner"), F.col("o.level").alias("owner_indent"))


def _python_ends(rows: DataFrame, **how) -> DataFrame:
    """(file, pos, end_line) of def lines: the last line of code before the next one that is no deeper."""
    code = rows.where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    code = running(code, ["file"], lasts={"before": F.col("pos")}, exclusive=True, **how)
    last = code.groupBy("file").agg(F.max("pos").alias("last"))
    is_def = F.col("line").rlike(_DEF)
    each = code.join(_levels(code, is_def).hint("merge"), "file").withColumn("level", F.explode("levels")).where(F.col("indent") <= F.col("level"))
    back = running(each.withColumn("back", -F.col("pos")), ["file", "level"], "back", lasts={"end": F.col("before")}, exclusive=True, **how)
    return back.where(is_def & (F.col("indent") == F.col("level"))).join(last.hint("merge"), "file").select("file", "pos", F.coalesce("end", "last").alias("end_line"))


def _spans(named: DataFrame) -> DataFrame:
    """Rows (file, pos, name, kind, end_line, params) as spans numbered by line."""
    order = F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "end_line", "params")))
    each = named.groupBy("file").agg(order.alias("_all")).select("file", F.posexplode("_all").alias("span_pos", "s"))
    return each.select("file", "span_pos", "s.name", "s.kind", F.col("s.pos").cast("int").alias("start_line"), F.col("s.end_line").cast("int").alias("end_line"), "s.params", F.lit(True).alias("approx"))


def python_scopes(files: DataFrame, **how) -> DataFrame:
    """Spans of Python files (file, source); any line of text that is no deeper than a class closes it."""
    rows = indented_lines(files)
    name = F.regexp_extract(F.regexp_replace("t", r"^class\s*", ""), r"^[^(: \t]*", 0)
    class_name = F.when(F.startswith("t", F.lit("class ")) & (name != ""), name)
    defined = F.regexp_extract("line", _DEF, 1)
    asks = F.col("line").rlike(_DEF) & ~defined.rlike("^__.*__$") & ~F.startswith("t", F.lit("class "))
    found = rows.where(asks).select("file", "pos", defined.alias("bare"), parameter_list(F.regexp_extract("line", _DEF, 2)).alias("all"))
    found = found.join(owners(rows, class_name, F.col("t") != "", asks, **how).hint("merge"), ["file", "pos"], "left").join(_python_ends(rows, **how).hint("merge"), ["file", "pos"])
    owned = F.col("owner").isNotNull()
    params = F.when(owned & F.coalesce(F.get("all", F.lit(0)).isin("self", "cls"), F.lit(False)), F.slice("all", 2, 1 << 20)).otherwise(F.col("all"))
    return _spans(found.select("file", "pos", F.when(owned, F.concat("owner", F.lit("."), "bare")).otherwise(F.col("bare")).alias("name"), F.when(owned, "method").otherwise("function").alias("kind"), "end_line", params.alias("params")))


def _brace_ends(files: DataFrame, **how) -> DataFrame:
    """(file, pos, end_line): for each line, where the first brace that opens in it or later closes; braces of strings
    and comments don't count."""
    all_ = tokens(files.select("file", masked(F.col("source"), raw_escapes=True).alias("masked")), r"[{}()\[\]\n]", **how)
    pairs = by_level(all_).where("token in ('{', '}') and not stop")
    closed = pairs.withColumn("end", following(F.when(F.col("token") == "}", F.col("line")))).where("token = '{'").select("file", "ord", "line", "end")
    first = closed.groupBy("file", F.col("line").alias("pos")).agg(F.min_by("end", "ord").alias("end"), F.min("ord").alias("ord"))
    lines = files.select("file", F.explode(F.sequence(F.lit(1), F.size(F.split("source", "\n")))).alias("pos"), F.size(F.split("source", "\n")).alias("last"))
    both = lines.join(first.hint("merge"), ["file", "pos"], "left").withColumn("back", -F.col("pos"))
    none = F.when(F.col("ord").isNotNull(), F.coalesce("end", "last"))
    return running(both, ["file"], "back", lasts={"end_line": none}, **how).select("file", "pos", F.coalesce("end_line", "last").alias("end_line"))


def script_scopes(files: DataFrame, **how) -> DataFrame:
    """Spans of JavaScript and TypeScript files (file, source); a line that begins with a closing brace closes the classes it is no deeper than."""
    rows = indented_lines(files)
    name = F.regexp_extract(F.regexp_replace("t", r"^class\s*", ""), r"^[^{ \t]*", 0)
    class_name = F.when(F.startswith("t", F.lit("class ")) & (name != ""), name)
    by_function = F.col("line").rlike(_FUNCTION)
    bare = F.when(by_function, F.regexp_extract("line", _FUNCTION, 1)).otherwise(F.regexp_extract("line", _VARIABLE, 1))
    listed = F.when(by_function, F.regexp_extract("line", _FUNCTION, 2)).otherwise(F.coalesce(F.when(F.regexp_extract("line", _VARIABLE, 2) != "", F.regexp_extract("line", _VARIABLE, 2)), F.regexp_extract("line", _VARIABLE, 3)))
    asks = (bare != "") & ~bare.isin(*HELPERS) & ~F.startswith(bare, F.lit("test")) & ~F.startswith(bare, F.lit("mock")) & ~F.startswith("t", F.lit("class "))
    found = rows.where(asks).select("file", "pos", "indent", bare.alias("bare"), parameter_list(listed).alias("params"))
    found = found.join(owners(rows, class_name, F.startswith("t", F.lit("}")), asks, **how).hint("merge"), ["file", "pos"], "left").join(_brace_ends(files.where("source is not null"), **how).hint("merge"), ["file", "pos"])
    owned = F.col("owner").isNotNull() & (F.col("indent") > F.col("owner_indent"))
    return _spans(found.select("file", "pos", F.when(owned, F.concat("owner", F.lit("."), "bare")).otherwise(F.col("bare")).alias("name"), F.when(owned, "method").otherwise("function").alias("kind"), "end_line", "params"))
