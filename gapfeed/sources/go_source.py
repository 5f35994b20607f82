"""Functions, branches and returns of Go files, from their block structure.

Approximations of a parse: a file whose brackets don't match has what its brackets say,
and conditions are the source's own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions.text import trim
from gapfeed.operators.scans import running
from gapfeed.shipping import materialize
from gapfeed.sources.structure import by_level, following, masked, preceding, tokens

#: A declaration stands at the start of a line; braces of types and of an else are told from others.
_TOKENS = r"\nfunc\b|\}[ \t]*else\b|\b(?:struct|interface)[ \t]*\{|\b(?:func|if|switch|select|return)\b|[{}()\[\]\n]"
_DECLARED = r"^func\s*(?:\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*)?([\p{L}_][\p{L}\p{N}_]*)\s*(?:\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\])?\s*\("
_RECEIVER = r"^\s*(?:[\p{L}_][\p{L}\p{N}_]*\s+)?[*\s(]*([\p{L}_][\p{L}\p{N}_]*)"
#: Words that begin a type, so that a parameter of two words has no name.
_TYPE_WORDS = ("chan", "func", "map", "struct", "interface")
#: A line that ends so goes on.
_GOES_ON = r"(?:[,*/%&|^<>=!.:(\[{~-]|(?<!\+)\+|&\^)\s*$"


def levels(files: DataFrame) -> DataFrame:
    """Tokens of Go files (file, source) by level, each with what comes behind it there: its block's open and end."""
    rows = by_level(tokens(files.select("file", masked(F.concat(F.lit("\n"), "source")).alias("masked")), _TOKENS))
    token = F.col("token")
    # the masked text has one line end more, at its start
    rows = rows.withColumns({"line": F.col("line") - 1, "at": F.col("at") - 1})
    kind = (
        F.when(F.col("stop"), "stop")
        .when(token == "\nfunc", "decl")
        .when(F.startswith(token, F.lit("}")) & (token != "}"), "else")
        .when(F.endswith(token, F.lit("{")) & (token != "{"), "type")
        .when(token == "\n", F.when(F.col("before").rlike(_GOES_ON), "goes_on").otherwise("newline"))
        .otherwise(token)
    )
    rows = rows.select("file", "level", "ord", "at", "line", "depth", kind.alias("kind"))
    k = F.col("kind")
    opener = preceding(F.when(k.isin("decl", "func", "if", "switch", "select", "{", "newline", "goes_on"), k))
    closed = following(F.when(k == "}", F.col("line")))
    rows = rows.withColumns({"opener": opener, "closed": closed})
    body = F.when(k == "{", F.struct("ord", "at", "line", "closed", F.col("opener").isin("decl", "func").alias("literal")))
    line_end = F.when(k.isin("newline", "goes_on", "decl"), F.col("ord"))
    statement = F.when(k == "newline", F.col("line") - 1).when(k.isin("stop", "decl"), F.col("line"))
    return rows.withColumns({"own_body": following(body), "plain_body": following(F.when(~F.col("opener").isin("decl", "func") | F.col("opener").isNull(), body)), "line_end": following(line_end), "statement_end": following(statement)})


def _headers(rows: DataFrame, files: DataFrame, skip: int) -> DataFrame:
    """Rows (file, at, line, body_at, body_line, more) with `h`, the source from `skip` behind at to body_at.

    It is cut from the lines it stands on; the whole source with each row would be copied and counted through for every one.
    """
    lines = files.select("file", F.posexplode(F.split("source", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    lines = running(lines, ["file"], "line", sums={"_behind": F.char_length("text") + 1}).select("file", "line", "text", (F.col("_behind") - F.char_length("text") - 1).alias("_start"))
    each = rows.select("file", "at", F.explode(F.sequence("line", "body_line")).alias("line")).join(lines.hint("merge"), ["file", "line"])
    near = each.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_near"), F.min("_start").alias("_start"))
    near = near.select("file", "at", F.array_join(F.transform("_near", lambda x: x["text"]), "\n").alias("_text"), "_start")
    cut = F.substring("_text", (F.col("at") - F.col("_start") + 1 + skip).cast("int"), (F.col("body_at") - F.col("at") - skip).cast("int"))
    return rows.join(near.hint("merge"), ["file", "at"]).withColumn("h", cut).drop("_text", "_start")


def parameter_names(raw: Column) -> Column:
    """Names of a parameter list, where a type may follow several names; "arg" for each without a name."""
    bare = raw
    for _ in range(3):  # what brackets within it hold
        bare = F.regexp_replace(bare, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", " ")
    words = F.transform(F.filter(F.split(bare, ","), lambda p: trim(p) != ""), lambda p: F.split(trim(p), r"\s+"))
    named = F.exists(words, lambda w: (F.size(w) > 1) & F.get(w, F.lit(0)).rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & ~F.get(w, F.lit(0)).isin(*_TYPE_WORDS))
    return F.transform(words, lambda w: F.when(named, F.get(w, F.lit(0))).otherwise("arg"))


def _numbered(rows: DataFrame, pos: str) -> DataFrame:
    """Rows (file, at, more) with their number in the file from 0, by offset."""
    order = F.array_sort(F.collect_list(F.struct("at", *[c for c in rows.columns if c not in ("file", "at")])))
    return rows.groupBy("file").agg(order.alias("_all")).select("file", F.posexplode("_all").alias(pos, "_one")).select("file", pos, "_one.*").drop("at")


def go_structure(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, branches, returns) of Go files (file, source); other files are passed over.

    spans: file, span_pos, name, kind, start_line, end_line, params, approx; branches: file, branch_pos, kind,
    condition, start_line, end_line (an if reaches to the end of its last else); returns: file, start_line, end_line.
    """
    go = files.where(F.endswith("file", F.lit(".go")) & F.col("source").isNotNull()).select("file", "source")
    rows = levels(go)
    used = ((F.col("kind") == "decl") & (F.col("depth") == 0)) | F.col("kind").isin("if", "switch", "select", "return")
    # written once: all three results are read from it
    rows = materialize(rows.where(used).select("file", "ord", "at", "line", "kind", "own_body", "plain_body", "line_end", "statement_end"), "tokens")
    lengths = go.select("file", F.size(F.split("source", "\n")).alias("last")).hint("merge")
    decl = rows.where((F.col("kind") == "decl") & (F.col("own_body.ord") < F.coalesce("line_end", F.col("own_body.ord") + 1)))
    decl = decl.select("file", (F.col("at") + 1).alias("at"), "line", "own_body.closed", F.col("own_body.at").alias("body_at"), F.col("own_body.line").alias("body_line"))
    decl = _headers(decl, go, 4).join(lengths, "file").select("file", "at", "line", F.coalesce("closed", "last").cast("int").alias("end_line"), F.concat(F.lit("func"), "h").alias("h")).where(F.col("h").rlike(_DECLARED))
    receiver, name = F.regexp_extract("h", _DECLARED, 1), F.regexp_extract("h", _DECLARED, 2)
    owner = F.regexp_extract(receiver, _RECEIVER, 1)
    listed = F.regexp_extract("h", _DECLARED + r"((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*)\)", 3)
    spans = decl.select(
        "file", "at", F.when(owner == "", name).otherwise(F.concat(owner, F.lit("."), name)).alias("name"), F.when(receiver == "", "function").otherwise("method").alias("kind"),
        F.col("line").alias("start_line"), "end_line", parameter_names(listed).alias("params"), F.lit(True).alias("approx"),
    )
    branch = rows.where(F.col("kind").isin("if", "switch", "select") & F.col("plain_body").isNotNull()).select("file", "at", "kind", "line", "plain_body.closed", F.col("plain_body.at").alias("body_at"), F.col("plain_body.line").alias("body_line"))
    branch = _headers(branch, go, 2).join(lengths, "file").select("file", "at", "kind", "line", F.coalesce("closed", "last").cast("int").alias("end_line"), F.when(F.col("kind") == "if", F.col("h")).otherwise("").alias("h"))
    bare = masked(F.col("h"))
    condition = trim(F.expr("substring(h, char_length(h) - char_length(_rest) + 1)"))
    branch = branch.withColumn("_rest", F.substring_index(bare, ";", -1)).select("file", "at", "kind", condition.alias("condition"), F.col("line").alias("start_line"), "end_line")
    returns = rows.where("kind = 'return'").select("file", F.col("line").alias("start_line"), F.coalesce("statement_end", "line").cast("int").alias("end_line"))
    return _numbered(spans, "span_pos"), _numbered(branch, "branch_pos").withColumn("branch_pos", F.col("branch_pos").cast("long")), returns
