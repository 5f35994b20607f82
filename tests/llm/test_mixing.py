"""Mixing against plain Python."""

import hashlib
import re

from gapfeed.llm import mixing


def water_fill(sizes, weights, share, most):
    """Targets by dealing out again and again what limits cut off."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    rows = docs.collect()
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = water_fill(sizes, [5, 2, 1], 1.5, 2.0)
    for r in got:
        assert r._size == size(r.text) and r._source_size == sizes[r.source]
        assert abs(r._target - want[r.source]) < 1e-6 * max(1, want[r.source])
        rate = r._target / r._source_size if r._source_size else 0
        key = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{key}:17".encode()).hexdigest()[:13], 16) / 2**52
        assert r._copies == int(rate) + (u < rate - int(rate)) <= 2
    return got


def test_documents(documents):
    got = check(documents)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r._size * r._copies
    assert abs(sum(taken.values()) / (1.5 * sum(r._size for r in got)) - 1) < 0.2


def test_odd_documents(odd):
    check(odd)


def test_many_sources_reach_their_limit(spark):
    rows = [(i, "w " * (1 + (i * 7) % 50), f"s{i % 9}") for i in range(300)]
    rows += [(1000 + i, "w " * 500, "big") for i in range(20)] + [(2000, None, None), (2001, "", "zero")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_repeats_rows_and_reruns_agree(documents):
    a, b = (sorted(r.doc_id for r in mixing.mix(documents).collect()) for _ in range(2))
    assert a == b
    copies = {r.doc_id: r._copies for r in mixing.with_copies(documents).collect()}
    assert a == sorted(i for i, n in copies.items() for _ in range(n))
    assert mixing.mix(documents).columns == documents.columns


def test_shuffled_join_where_sources_are_many(documents, monkeypatch):
    want = sorted((r.doc_id, r._copies) for r in mixing.with_copies(documents).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted((r.doc_id, r._copies) for r in mixing.with_copies(documents).collect()) == want


def test_empty(empty):
    assert mixing.with_copies(empty).count() == 0 and mixing.mix(empty).count() == 0
