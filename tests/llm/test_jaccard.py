"""The Jaccard join against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gapfeed.llm import _hashing
from gapfeed.llm import jaccard_join as J
from gapfeed.llm.components import components


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) * den >= len(x | y) * num:
                parent[root(a)] = root(b)
    groups = {}
    for a, (i, s) in enumerate(sets):
        groups.setdefault(root(a), []).append(i)
    named = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted(((str(i), len(s), str(named[root(a)] if len(groups[root(a)]) > 1 else i)) for a, (i, s) in enumerate(sets)))


def corpus(seed, n):
    """Families of near copies at all distances around the threshold, shared passages, short texts, copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 200]))]
        if rng.random() < 0.3:
            base += passage
        out.append(base)
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            copy = list(rng.choice(out[-3:]))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(vocabulary)
                else:
                    copy.insert(at, rng.choice(vocabulary))
            out.append(copy)
    return [(i, " ".join(w if rng.random() < 0.9 else w.upper() for w in t)) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("seed, k, num, den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 7, 10)])
def test_equals_all_pairs(spark, seed, k, num, den):
    rows = corpus(seed, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = J.near_components(docs, k=k, similarity=J.Similarity(num, den)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, num, den)


def test_odd_documents(odd):
    got = J.near_components(odd, k=3, similarity=J.Similarity(9, 10)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 9, 10)


def test_keep_one(odd, spark):
    kept = J.keep_one(odd, k=3, similarity=J.Similarity(9, 10))
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert kept.columns == odd.columns
    assert ids == sorted(["0", "1", "2", "None", "4", "5", "7", "8", "9", "10", "11"])


def linked(a, b, s):
    return len(a & b) * s.den >= len(a | b) * s.num


def test_linked_sets_share_a_key():
    """Of random pairs around the threshold each linked one has a common key in the band of its larger set, with and without neighbourhoods."""
    rng = random.Random(3)
    seen = 0
    for s in (J.Similarity(9, 10), J.Similarity(4, 5), J.Similarity(1, 2)):
        ranges = J.bands(s, 600)
        for _ in range(400):
            n = rng.choice([1, 2, 3, 5, 9, 20, 50, 120, 400])
            a = {rng.getrandbits(64) for _ in range(n)}
            change = rng.randint(0, s.differ(2 * n) + 1)
            gone = set(rng.sample(sorted(a), min(len(a), rng.randint(0, change))))
            b = (a - gone) | {rng.getrandbits(64) for _ in range(change - len(gone))}
            if not b or not linked(a, b, s):
                continue
            seen += 1
            i = next(i for i, (low, high) in enumerate(ranges) if low <= max(len(a), len(b)) <= high)
            for sets in (1, 10**6, 10**10):
                band = J.allocate(i, *ranges[i], s, sets)
                cuts = J.segment_cuts(band)
                keys = [set(J.segment_keys(np.array(sorted(x), dtype=np.uint64), band, cuts, s).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
    assert seen > 400


def test_allocation_follows_costs():
    # neighbourhoods pay where sets are many
    assert J.allocate(0, 400, 490, J.Similarity(9, 10), 10**12).deletions > 0
    assert J.allocate(0, 400, 490, J.Similarity(9, 10), 100).deletions == 0


def test_neighbourhoods_find_pairs(spark, monkeypatch):
    """The same results where all bands use one-deletion neighbourhoods."""

    def only_deletions(number, low, high, similarity, sets):
        d = (similarity.differ(2 * high) + 2) // 2
        return J.Band(number, low, high, d + 1, d)

    monkeypatch.setattr(J, "allocate", only_deletions)
    rows = corpus(7, 250)
    got = J.near_components(spark.createDataFrame(rows, "doc_id long, text string"), k=2, similarity=J.Similarity(4, 5)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2, 4, 5)


def test_salted_keys_find_pairs(spark, monkeypatch):
    """Many documents around one shared passage, some of them near copies; keys are split as if they were huge."""
    monkeypatch.setattr(J, "SALT_ROWS", 3)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(150):
        own = [f"q{rng.randrange(60)}" for _ in range(rng.randint(1, 6))]
        rows.append((i, " ".join(passage + own)))
    got = J.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=2, similarity=J.Similarity(9, 10)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2, 9, 10)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 99), (7, 7), (200, 100), (5, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[200] == got[100] == 99 and 7 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(empty):
    assert J.near_components(empty).count() == 0 and J.keep_one(empty).count() == 0


@pytest.mark.parametrize("few", [1, 4])
def test_crowded_keys_find_pairs(spark, monkeypatch, few):
    """The same results where keys of few members already count as crowded, with repeated ids and salted keys."""
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(J, "SALT_ROWS", 3)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    rows = corpus(4, 150) + [(None if i % 17 == 3 else 1000 + i, " ".join(passage + [f"q{rng.randrange(60)}" for _ in range(rng.randint(1, 9))])) for i in range(120)]
    rows += [(1000, "one id and another text " * 3), (1004, rows[154][1].upper())]
    got = J.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), k=2, similarity=J.Similarity(4, 5)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, 2, 4, 5)


def test_crowded_keys_make_few_pairs(spark, monkeypatch):
    """Long texts that share most of a page and aren't linked: beyond leaders, hardly any pairs are left to verify."""
    monkeypatch.setattr(J, "FEW", 8, raising=False)
    rng = random.Random(13)
    page = [f"p{i}" for i in range(500)]
    rows = [(i, " ".join(page + [f"q{rng.randrange(10**6)}" for _ in range(300)])) for i in range(80)]
    rows.append((80, rows[7][1] + " end"))
    counts = []

    class Counted(J.Scratch):
        def table(self, df, tag, by=None):
            out = super().table(df, tag, by)
            counts.extend([out.count()] * (tag == "near-pairs"))
            return out

    with Counted(spark) as scratch:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        links, _ = J.class_links(docs, scratch.table(J.set_sizes(docs, 5, "doc_id", "text"), "sizes"), J.Similarity(4, 5), 5, scratch)
        assert links.count() == 1
    assert sum(counts[1:]) < 100


def test_linked_sets_share_a_key_with_common_shingles():
    """As above, where any part of the shingles, none or all of them, has segments of its own; also of sets that index empty segments."""
    rng = random.Random(5)
    seen = 0
    for s in (J.Similarity(9, 10), J.Similarity(4, 5), J.Similarity(1, 2)):
        ranges = J.bands(s, 600)
        for _ in range(300):
            n = rng.choice([1, 2, 3, 5, 9, 20, 50, 120, 400])
            a = {rng.getrandbits(64) for _ in range(n)}
            change = rng.randint(0, s.differ(2 * n) + 1)
            gone = set(rng.sample(sorted(a), min(len(a), rng.randint(0, change))))
            b = (a - gone) | {rng.getrandbits(64) for _ in range(change - len(gone))}
            if not b or not linked(a, b, s):
                continue
            seen += 1
            share = rng.choice([0, 0.2, 0.5, 0.9, 1])
            common = np.array(sorted(x for x in a | b if rng.random() < share), dtype=np.uint64)
            i = next(i for i, (low, high) in enumerate(ranges) if low <= max(len(a), len(b)) <= high)
            most = s.differ(2 * ranges[i][1]) + 1
            for band in (J.allocate(i, *ranges[i], s, 1), J.allocate(i, *ranges[i], s, 10**10), J.Band(i, *ranges[i], most, 0)):
                cuts = J.segment_cuts(band)
                keys = [set(J.segment_keys(np.array(sorted(x), dtype=np.uint64), band, cuts, s, common).tolist()) for x in (a, b)]
                assert keys[0] & keys[1]
    assert seen > 300


def test_shared_passages_crowd_no_keys(spark, monkeypatch):
    """Texts with one passage in common and no links: its shingles make hardly any crowded keys, whose members' shingles would be counted."""
    monkeypatch.setattr(J, "FEW", 4)
    rng = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"q{rng.randrange(10**6)}" for _ in range(100)] + passage + [f"q{rng.randrange(10**6)}" for _ in range(100)])) for i in range(200)]
    rows.append((200, rows[7][1] + " end"))
    counts = {"shingles": 0}

    class Counted(J.Scratch):
        def table(self, df, tag, by=None):
            out = super().table(df, tag, by)
            counts[tag] = counts.get(tag, 0) + out.count()
            return out

    with Counted(spark) as scratch:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        links, _ = J.class_links(docs, scratch.table(J.set_sizes(docs, 5, "doc_id", "text"), "sizes"), J.Similarity(4, 5), 5, scratch)
        assert links.count() == 1
    assert counts["shingles"] < 5000


def test_hashing_takes_little_memory(documents, monkeypatch):
    """Hashing takes many times the text at once; two workers share an executor with its JVM."""
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, run, schema: run)
    monkeypatch.setattr(_hashing, "_powers", [])
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "bbb", "c", "dddd"]) + str(rng.randint(0, 999)) for _ in range(500)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(texts)], names=["doc_id", "text"])
    run = J.set_sizes(documents, 5, "doc_id", "text")
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(iter([batch]))) == 600
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_repeated_shingles_are_counted(documents, monkeypatch):
    """Counts don't depend on how often those of earlier texts were added to."""
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, run, schema: run)
    texts = [" ".join(f"{i if j % 7 else 'all'}w{j}" for j in range(3000)) for i in range(300)] + ["same words in two texts"] * 2 + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["cls", "text"])
    found = {}
    for b in J._repeated(documents.selectExpr("doc_id as cls", "text"), 1)(iter([batch])):
        assert not found.keys() & set(b.column(0).to_pylist())
        found |= dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert sorted(found.values()) == [2] * 5 + [300] * len(range(0, 3000, 7))
