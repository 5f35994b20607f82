"""Documents against the rules of their kind: rules are rows, documents are maps of variants, violations are rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed.functions import vocabulary as V
from gapfeed.operators.imports import clean_path

RULES = "kind string, parent string, field string, check string, value string"


def rules(spark: SparkSession, documents: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(kind, parent, field, check, value): every field must be there, and pass each of its checks."""
    rows = []
    for kind, fields in (V.DOCUMENTS if documents is None else documents).items():
        for path, checks in fields.items():
            parent, _, field = path.rpartition(".")
            rows.append((kind, parent, field, "there", None))
            text, _, rest = checks.partition(" ")
            for check in [text, rest] if text == "text" and rest else [checks]:
                if check in ("text", "none"):
                    rows.append((kind, parent, field, check, None))
                elif check == "decisions":
                    rows.append((kind, parent, field, "equals", json.dumps(V.DECISIONS, separators=(",", ":"))))
                elif check.startswith(("in:", "below:")):
                    rows.append((kind, parent, field, *check.split(":", 1)))
                elif check != "any":
                    rows.append((kind, parent, field, "equals", check))
    return spark.createDataFrame(rows, RULES)


def _members(text: Column) -> Column:
    """An object's members; an empty map for what is no object."""
    return F.coalesce(F.from_json(F.when(F.coalesce(F.schema_of_variant(F.try_parse_json(text)), F.lit("")).rlike("^OBJECT"), text), "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _text(value: Column) -> Column:
    """A member's text; null if it is no text."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def violations(documents: DataFrame, of_rules: DataFrame) -> DataFrame:
    """(doc_id, message) of documents (doc_id, kind, doc) that break rules of their kind.

    Each document meets its kind's rules (a small fixed table, broadcast); no document meets another. A document that is no
    JSON object breaks one rule only. Members that no rule names are unexpected.
    """
    whole = F.schema_of_variant(F.try_parse_json("doc")).rlike("^OBJECT")
    read = documents.select("doc_id", "kind", F.coalesce(whole, F.lit(False)).alias("_whole"), _members(F.col("doc")).alias("_top"))
    bad = read.where("not _whole").select("doc_id", F.lit("expected a JSON object").alias("message"))
    nested = _members(F.to_json(F.try_element_at("_top", F.lit("evidence"))))
    read = read.where("_whole").withColumn("_nested", nested)
    small = F.broadcast(of_rules)
    met = read.join(small, "kind").withColumn("_map", F.when(F.col("parent") == "", F.col("_top")).otherwise(F.col("_nested")))
    met = met.withColumn("_v", F.try_element_at("_map", F.col("field"))).withColumn("_at", F.when(F.col("parent") == "", F.col("field")).otherwise(F.concat("parent", F.lit("."), "field")))
    said, own, want = F.to_json("_v"), _text(F.col("_v")), F.col("value")
    number = F.schema_of_variant("_v").isin("BIGINT", "DOUBLE") | F.startswith(F.schema_of_variant("_v"), F.lit("DECIMAL"))
    equal = F.coalesce((said == want) | (number & (F.try_variant_get("_v", "$", "double") == want.try_cast("double"))), F.lit(False))
    base = F.substring_index(want, "/", 1)
    below = clean_path(F.concat(F.coalesce(_text(F.try_element_at("_top", base)), F.lit("")), F.lit("/"), F.expr("substring(value, char_length(substring_index(value, '/', 1)) + 2)")))
    below = F.when(F.coalesce(_text(F.try_element_at("_top", base)), F.lit("")) == "", F.regexp_replace(below, "^/", "")).otherwise(below)
    plain = F.when(F.startswith(want, F.lit("[")), F.array_join(F.from_json(want, "array<string>"), ",")).otherwise(F.btrim(want, F.lit('"')))
    prefix = F.when(F.col("parent") == "", "").otherwise(F.concat("parent", F.lit(" ")))
    message = (
        F.when((F.col("check") == "there") & ~F.map_contains_key("_map", F.col("field")), F.concat(prefix, F.lit("missing required field "), "field"))
        .when((F.col("check") == "text") & (F.coalesce(own, F.lit("")) == ""), F.concat("_at", F.lit(": expected non-empty string")))
        .when((F.col("check") == "none") & (F.coalesce(said, F.lit("")) != "[]"), F.concat("_at", F.lit(" must be an empty array")))
        .when((F.col("check") == "equals") & ~equal, F.concat("_at", F.lit(" must be "), plain))
        .when((F.col("check") == "in") & ~F.coalesce(F.contains(own, want), F.lit(False)), F.concat("_at", F.lit(" must point to "), F.substring_index(want, "/", -1)))
        .when((F.col("check") == "below") & (clean_path(F.coalesce(own, F.lit(""))) != below), F.concat("_at", F.lit(" must be "), below))
    )
    broken = met.select("doc_id", message.alias("message")).where("message is not null")
    known = of_rules.groupBy("kind").agg(F.collect_set(F.when(F.col("parent") == "", F.col("field"))).alias("_known"), F.collect_set(F.when(F.col("parent") == "evidence", F.col("field"))).alias("_inner"))
    with_known = read.join(F.broadcast(known), "kind")  # a row for each kind
    more = F.concat(
        F.transform(F.array_except(F.map_keys("_top"), "_known"), lambda k: F.concat(F.lit("unexpected field "), k)),
        F.when(F.size("_inner") > 0, F.transform(F.array_except(F.map_keys("_nested"), "_inner"), lambda k: F.concat(F.lit("evidence unexpected field "), k))).otherwise(F.array().cast("array<string>")),
    )
    return broken.unionByName(with_known.select("doc_id", F.explode(more).alias("message"))).unionByName(bad)
