"""The block structure of source files as rows, with native columns only.

A file's text is masked (strings and comments become blanks of the same length),
then cut into tokens that matter: brackets, line ends and keywords. Running sums
give each token its line, its offset and the depth of brackets. Tokens are then
dealt by file and level, a level being a depth of brackets: at one
level an opening bracket and the one that closes it follow each other, so the end
of a block is the first later closing row of its level, found by a window over
that level's rows instead of a scan that keeps a stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.operators.scans import running

#: A string, a character, a raw string, a comment, or what is none of them; no two overlap and together they are the text.
_PARTS = "\"[^\"\\n]*+\"?|'[^'\\n]*+'?|`[^`]*+`?|//[^\\n]*+|(?s:/\\*.*?(?:\\*/|\\z))|[^\"'`/]++|/"


def masked(source: Column, raw_escapes: bool = False) -> Column:
    """A text of the same length and lines without what strings and comments hold; quotes stay. Escaped characters go
    first, so that no quote of a string is one (`raw_escapes`: within back quotes too)."""
    plain = F.regexp_replace(source, r"\\[^\n]" if raw_escapes else r"\\[^\n`]", "__")
    parts = F.regexp_extract_all(plain, F.lit(_PARTS), F.lit(0))
    comment = lambda p: F.startswith(p, F.lit("//")) | F.startswith(p, F.lit("/*"))
    return F.array_join(F.transform(parts, lambda p: F.when(comment(p), F.regexp_replace(p, r"[^\n]", " ")).when(F.substring(p, 1, 1).isin('"', "'", "`"), F.regexp_replace(p, "[^\n\"'`]", " ")).otherwise(p)), "")


def tokens(files: DataFrame, pattern: str, **how) -> DataFrame:
    """(file, ord, before, token, at, line, depth) of the tokens of files (file, masked).

    `pattern` finds tokens, the brackets ()[]{} and line ends among them; before: the text since the token before it;
    at: its offset; line: its line (of a line end, the line after); depth: open brackets behind it.
    """
    chunks = files.select("file", F.posexplode(F.regexp_extract_all("masked", F.lit(f"(?s).*?(?:{pattern})"), F.lit(0))).alias("ord", "chunk"))
    token = F.regexp_extract("chunk", f"(?s)^.*?({pattern})$", 1)
    rows = chunks.withColumn("token", token).select("file", "ord", F.expr("left(chunk, char_length(chunk) - char_length(token))").alias("before"), "token", F.char_length("chunk").alias("_n"))
    first, last = F.substring("token", 1, 1), F.substring("token", -1, 1)
    delta = F.when(last.isin("{", "(", "["), 1).when(first.isin("}", ")", "]"), -1).otherwise(0)
    out = running(rows, ["file"], "ord", sums={"depth": delta, "line": (first == "\n").cast("int"), "_to": F.col("_n")}, **how)
    return out.select("file", "ord", "before", "token", (F.col("_to") - F.char_length("token")).alias("at"), (F.col("line") + 1).cast("int").alias("line"), F.col("depth").cast("int").alias("depth"))


def by_level(rows: DataFrame) -> DataFrame:
    """Rows with their level: that of the bracket for brackets, of brackets that may follow for others. A closing bracket
    comes twice, the second time as the end (`stop`) of what it closes."""
    first, last = F.substring("token", 1, 1), F.substring("token", -1, 1)
    closes, opens = first.isin("}", ")", "]"), last.isin("{", "(", "[")
    here = F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1)
    levels = F.when(closes, F.array(F.struct(here.alias("level"), F.lit(False).alias("stop")), F.struct((here + 1).alias("level"), F.lit(True).alias("stop")))).otherwise(F.array(F.struct(here.alias("level"), F.lit(False).alias("stop"))))
    return rows.withColumn("_l", F.explode(levels)).withColumns({"level": F.col("_l.level"), "stop": F.col("_l.stop")}).drop("_l")


def following(value: Column) -> Column:
    """The first value that isn't null of the rows behind one, on its level: carried along from the other end, as a frame
    that reaches to the last row is read anew for each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file", "level").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1))


def preceding(value: Column) -> Column:
    """The last value that isn't null of the rows before one, on its level."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("file", "level").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
