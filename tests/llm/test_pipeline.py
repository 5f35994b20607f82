"""The pipeline's stages, each against its own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from gapfeed.llm import pii  # noqa: E402
from gapfeed.llm._common import materialize  # noqa: E402
from gapfeed.llm.queries import tokenizer_path  # noqa: E402

from .test_jaccard import brute  # noqa: E402
from .test_mixing import size, water_fill  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, documents):
    docs = documents.unionByName(spark.createDataFrame([(9001, None, "en", "src0", None), (9002, "12 34 !!", "en", None, 8)], documents.schema))
    seen = [docs]
    for name, stage in pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF), f"t-{name}"))
    return seen


def test_names():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_duplicates", "pii", "mix", "packing"]


def test_columns_stay_but_for_the_last(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_language_stage_keeps_clean_documents(stages):
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    assert before - after == {9001, 9002}


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    keep = {int(i) for i, _, c in brute(rows, 5, 4, 5) if i == c}
    assert {r.doc_id for r in stages[2].collect()} == keep and len(keep) < len(rows)


def test_personal_data_is_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = stages[3].collect()
    assert {r.doc_id for r in after} == set(before)
    assert not any(pii.candidates(r.text)[0] for r in after) and all(r.n_chars == len(r.text) for r in after)
    changed = [r for r in after if r.text != before[r.doc_id]]
    assert changed and all("[" in r.text for r in changed)


def test_mix_takes_whole_copies(stages):
    rows = stages[3].collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    rate = {s: t / sizes[s] if sizes[s] else 0 for s, t in water_fill(sizes, [5, 2, 1], 1.5, 2.0).items()}
    copies = Counter(r.doc_id for r in stages[4].collect())
    for r in rows:
        assert copies[r.doc_id] - int(rate[r.source] + 1e-9) in (0, 1)


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(tokenizer_path())
    want = sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert stages[5].agg(F.sum("length")).first()[0] == want


def test_run(spark, stages):
    got = pipeline.run(spark, SF)
    assert got.columns == stages[-1].columns and got.count() > 100
