"""Input values out of the hints of a task: conditions such as `x == 3`, `!ok` or `not done`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.functions import text as T

_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"
_CONDITION = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(===|!==|==|!=|>=|<=|>|<|=|is\s+not|is)\s*(.+?)\s*$"
_AND = r"\s*(?:&&|\band\b)\s*"
_CALL = r"([A-Za-z_][A-Za-z0-9_.]*)\.equals\(\s*([A-Za-z_][A-Za-z0-9_]*)"
#: What stands for a text other than a given one.
OTHER = "__other__"


def hint_conditions(hint: Column) -> Column:
    """The single conditions of a hint: what stands between backticks, or all of it, cut at `&&` and `and`."""
    quoted = F.transform(F.regexp_extract_all(hint, F.lit("`([^`]+)`"), F.lit(1)), T.trim)
    whole = F.when(F.size(quoted) > 0, quoted).otherwise(F.array(T.trim(hint)))

    def parts(one: Column) -> Column:
        cut = F.filter(F.transform(F.split(one, _AND), T.trim), lambda x: x != "")
        return F.when(F.size(cut) > 0, cut).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>"))

    return F.when(hint.isNull(), F.array().cast("array<string>")).otherwise(F.flatten(F.transform(whole, parts)))


def literal(value: Column, language: Column) -> Column:
    """A value as the language writes it; closing commas, semicolons and colons go."""
    v = F.regexp_replace(T.trim(value), r"(?U)[\s,;:]+$", "")
    low, python = F.lower(v), language == "python"
    none = F.when(python | (language == "rust"), "None").otherwise("null")
    return (
        F.when(low == "undefined", F.when(language == "javascript", "undefined").otherwise(none))
        .when(low.isin("null", "none"), none)
        .when(low == "true", F.when(python, "True").otherwise("true"))
        .when(low == "false", F.when(python, "False").otherwise("false"))
        .otherwise(v)
    )


def _number(value: Column) -> Column:
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("long"))


def different(value: Column, language: Column, other: str = OTHER) -> Column:
    """A value unlike the given one, of its kind; what has no known kind stays."""
    python, more = language == "python", F.try_add(_number(value), F.lit(1)).cast("string")
    something = F.when(python, "object()").when(language == "javascript", "{}").when(language == "java", f'"{other}"').when(language == "rust", "Some(0)").otherwise("1")
    quote = F.substring(value, 1, 1)
    return (
        F.when(value.isin("true", "True"), F.when(python, "False").otherwise("false"))
        .when(value.isin("false", "False"), F.when(python, "True").otherwise("true"))
        .when(value.isin("null", "None", "undefined"), something)
        .when(more.isNotNull(), more)
        .when(value.rlike("(?s)^(\".*\"|'.*')$"), F.concat(quote, F.lit(other), quote))
        .otherwise(value)
    )


def condition_value(condition: Column, language: Column, other: str = OTHER) -> Column:
    """struct(param, value) that makes a condition true; null if it has no form that is known."""
    c = T.trim(condition)
    negated = T.trim(F.regexp_extract(c, r"(?s)^(?:!|not )(.*)$", 1))
    op, raw = F.regexp_extract(c, _CONDITION, 2), literal(F.regexp_extract(c, _CONDITION, 3), language)
    step = F.when(op == ">", 1).when(op == "<", -1)
    moved = F.coalesce(F.try_add(_number(raw), step).cast("string"), raw)
    value = F.when(op.isin("!=", "!==", "is not"), different(raw, language, other)).otherwise(moved)
    made = lambda name, v: F.struct(name.alias("param"), v.alias("value"))
    return (
        F.when(negated.rlike(_NAME), made(negated, literal(F.lit("false"), language)))
        .when(c.rlike(_NAME), made(c, literal(F.lit("true"), language)))
        .when((op != "") & (value != ""), made(F.regexp_extract(c, _CONDITION, 1), value))
    )


def task_inputs(tasks: DataFrame, keys: list[str], other: str = OTHER) -> DataFrame:
    """(keys, param, value) of the tasks' suggested_inputs and then missing_branches; of conditions on one
    parameter the last wins. tasks: keys, language, suggested_inputs, missing_branches. Null hints have none."""
    none = F.array().cast("array<string>")
    hints = F.concat(*[F.coalesce(c, none) for c in ("suggested_inputs", "missing_branches")])
    found = tasks.select(*keys, "language", F.posexplode(F.flatten(F.transform(hints, hint_conditions))).alias("_pos", "_condition"))
    called = F.when(F.col("_condition").rlike(_CALL) & (F.col("language") == "java"), F.struct(F.regexp_extract("_condition", _CALL, 2).alias("param"), F.regexp_extract("_condition", _CALL, 1).alias("value")))
    read = found.withColumn("_v", F.coalesce(called, condition_value(F.col("_condition"), F.col("language"), other))).where("_v IS NOT NULL")
    return read.groupBy(*keys, F.col("_v.param").alias("param")).agg(F.max_by("_v.value", "_pos").alias("value"))


def without_quoted(code: Column) -> Column:
    """Code with quoted literals (of any of three quotes) as spaces of the same length; an open one reaches the end."""
    literals = r"(?s)'(?:\\.|[^'\\])*(?:'|\\?$)|\"(?:\\.|[^\"\\])*(?:\"|\\?$)|`(?:\\.|[^`\\])*(?:`|\\?$)"
    between, quoted = F.split(code, literals), F.regexp_extract_all(code, F.lit(literals), F.lit(0))
    blanked = F.zip_with(between, quoted, lambda a, q: F.concat(a, F.repeat(F.lit(" "), F.coalesce(F.char_length(q), F.lit(0)))))
    return F.array_join(blanked, "")


def has_unknown_names(code: Column, allowed: Column) -> Column:
    """Whether an expression holds a name that isn't in the allowed list."""
    names = F.regexp_extract_all(code, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))
    return F.size(F.array_except(names, allowed)) > 0

