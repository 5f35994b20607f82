"""Token alignment against the definition: every pair of tokens, every shared end."""

import hashlib
import random
from collections import Counter

import pytest

from gapfeed.llm import token_alignment as T
from gapfeed.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ranges(ids, names):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(names[i])))
        at = out[-1][1]
    return out


def want(rows):
    """Digests of (id, text) rows by comparing all ranges."""
    pair = T.Pair(A, B)
    kept, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pair.b.encode(text or "")
        if not text or b"".join(pair.a_bytes[x] for x in a) != raw or b"".join(pair.b_bytes[x] for x in b) != raw:
            kept.append((i, [], [], [], []))
            continue
        ra, rb = ranges(a, pair.a_bytes), ranges(b, pair.b_bytes)
        links = [(x, y) for x, (p, q) in zip(a, ra) for y, (r, s) in zip(b, rb) if p < s and r < q]
        ends = sorted({q for _, q in ra} & {q for _, q in rb})
        groups = [([x for x, (_, q) in zip(a, ra) if lo < q <= hi], [y for y, (_, q) in zip(b, rb) if lo < q <= hi]) for lo, hi in zip([0, *ends], ends)]
        counts.update(links)
        kept.append((i, a, b, links, groups))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, a, b, links, groups in kept:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def run(docs, **how):
    return order(tuple(r) for r in T.align_tokens(docs, A, B, **how).select(COLUMNS).collect())


def test_align_equals_shared_ends():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 120)
        a = sorted(rng.sample(range(1, n + 1), rng.randint(0, n - 1))) if n > 1 else []
        b = sorted(x for x in range(1, n + 1) if (x in a) != (rng.random() < 0.1))
        a, b = sorted({*a, n}), sorted({*b, n})
        flat, x, y, last_x, last_y = T.align(a, b)
        stretches = list(zip(flat[::3], flat[1::3], flat[2::3]))
        assert all(a[i : i + k] == b[j : j + k] and k for i, j, k in stretches)
        straight = [(i + d, j + d) for i, j, k in stretches for d in range(k)]
        assert [a[i] for i in last_x] == [b[j] for j in last_y]
        assert sorted([a[i] for i, _ in straight] + [a[i] for i in last_x]) == sorted(set(a) & set(b))
        ra, rb = list(zip([0, *a], a)), list(zip([0, *b], b))
        assert sorted([*straight, *zip(x, y)]) == [(i, j) for i, (p, q) in enumerate(ra) for j, (r, s) in enumerate(rb) if p < s and r < q]


def test_units_equal_whole_texts(documents):
    units = T.Units(T.Pair(A, B))
    assert units.cut
    units.MOST = 500
    texts = [r.text for r in documents.select("text").collect() if r.text] + TEXTS + ["a b  c\u3000d e\x1ff g \n h", "x" * 5000 + " y", "tab\t b", " lead", "trail ", "nb\xa0 sp\xa0 x"]
    for at in range(0, len(texts), 9):
        some = texts[at : at + 9]
        a, a_from, b, b_from = units.encode(some)
        whole_a, whole_b, same = units.pair.encode(some)
        for k, ok in enumerate(same):
            assert a[a_from[k] : a_from[k + 1]].tolist() == (whole_a[k] if ok else [])
            assert b[b_from[k] : b_from[k + 1]].tolist() == (whole_b[k] if ok else [])


def test_long_stretch_takes_few_comparisons():
    class Counted(list):
        asked = 0

        def __getitem__(self, k):
            Counted.asked += 1
            return list.__getitem__(self, k)

    a = Counted(range(1, 100_001))
    assert T.stretch(a, list(range(1, 100_001)), 0, 0) == 100_000
    assert Counted.asked < 40


TEXTS = ["The quick brown fox, jumping over 12345 dogs.", " two  spaces and\ttabs\n\n", "naïve café – “quotes” … €5", "日本語のテキスト", "▁literal", "<|endoftext|> <s> </s> <unk> <0x41>", "don't can't o'clock", "a", "\x00null", "ﬁ ligature", "tokenization antidisestablishmentarianism", "é combining", "🙂🙂 emoji"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = "the of and alignment tokeniser über queue Xylophone 2024 supercalifragilistic — » ß".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return [*enumerate(TEXTS), *enumerate(made, 100), (None, "The quick brown fox"), (7, "a"), (200, None), (201, "")]


def test_equals_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, pair string").repartition(3)
    expected = order(want(rows))
    assert run(docs) == expected
    assert run(docs, hot_pairs=5) == expected  # nearly all pairs go by the join
    assert run(docs, hot_pairs=0) == expected


def test_given_documents(spark, documents):
    some = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.text is None or len(r.text) < 1500]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert run(docs) == order(want(some))


def test_groups_and_counts(spark):
    docs = spark.createDataFrame([(1, "hello strange tokenizations"), (2, "hello hello")], "doc_id long, text string")
    aligned = T.alignments(docs, A, B, with_groups=True)
    pair = T.Pair.of(A, B).pair
    for r in aligned.collect():
        assert len(r.a_ends) == len(r.b_ends) == r.n_groups
        for x, y in zip(r.a_ends, r.b_ends):
            assert b"".join(pair.a_bytes[i] for i in r.a_ids[:x]) == b"".join(pair.b_bytes[i] for i in r.b_ids[:y])
    counts = {(r.a, r.b): (r.n, r.best) for r in T.pair_counts(aligned).collect()}
    hello = pair.a.encode(" hello").ids[0], pair.b.encode("hello")[0]
    assert counts[hello] == (3, True)


def test_odd_rows(odd, empty):
    got = run(odd)
    assert len(got) == odd.count()
    assert [r for r in got if r[1] == 0 and r[-1] != ""] == []
    assert run(empty) == []
