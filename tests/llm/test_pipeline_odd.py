"""The pipeline on odd, repeated, clashing and empty rows."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from gapfeed.llm._common import materialize

SF = "/root/testdata/sf0.001"


def through(spark, docs):
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"t-{name}")
    return docs


def test_odd_rows(spark, odd):
    clashing = odd.withColumns({"score": F.lit("own"), "cls": F.lit(1), "component": F.lit("c"), "bucket": F.lit(2)})
    docs = clashing
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"t-{name}")
        assert docs.columns == clashing.columns
    kept = docs.collect()
    assert kept and all(r.text and r.text.strip() for r in kept)
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() > 0


def test_empty_table(spark, empty):
    assert through(spark, empty).count() == 0
