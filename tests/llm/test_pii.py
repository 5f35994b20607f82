"""Personal data: base patterns against plain regular expressions, the models on planted spans."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from gapfeed.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, p in PLAIN.items():
        for m in p.finditer(text):
            digits = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.BASE.index(s[0])))


TRICKY = [
    "a@b.c@d.e f@@g.h x@y -@-.- %+@q.r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "4111 1111-1111 1111 and 4111111111111112", "+1 (988) 555-2485 +12 +1234567890123456 ++49 30 123456789",
    "é日x@y.zz 1.1.1.1é", "a" * 3000 + "@", "@" * 500, "1" * 3000, "1 " * 2000, "+1" * 500, "a.b+c%d_e-f@x-y.co.uk,", "4242-4242-4242-4242.1.2.3", "",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.candidates(text)[0] == plain(text)


def test_documents(documents, odd):
    for docs in (documents, odd):
        texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        got = sorted(pii.detect(docs).collect(), key=lambda r: str(r.doc_id))
        assert len(got) == len(texts)
        want = sorted((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t)).encode()).hexdigest()) for i, t in texts)
        assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
        for r in got:
            kinds = [s.split(":")[0] for s in r.spans.split(",") if s]
            assert [kinds.count(k) >= n for k, n in zip(pii.BASE, (r.n_email, r.n_ip, r.n_card, r.n_phone))] == [True] * 4


def test_model_adds_what_labelers_agree_on(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        token = "".join(rng.choice(list("abcdef")) + rng.choice(list("0123456789")) for _ in range(20))
        rows.append((i, [f'the token = "{token}" end', f"mail me at user{i} at host dot com now", "version 4.0 and 1.2.3.999 or 12345", f"call tel (030) {rng.integers(100, 999)}-{rng.integers(1000, 9999)} soon", "password = aaaaaaaa", f"a{i}@b.org"][i % 6]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert sum("secret" in got[i] for i in range(0, 300, 6)) == 50
    assert sum("email" in got[i] for i in range(5, 300, 6)) == 50
    assert not any(got[i] for i in range(2, 300, 6))


@pytest.mark.parametrize("n", [200, 201, 600, 100_000])
def test_secret_reaches_its_end(n):
    assert ("secret", 7, 7 + n, None) in pii.candidates("token: " + "aB3_" * (n // 4) + "x" * (n % 4) + " end")[1]


def test_long_secrets_leave_nothing_in_the_text(spark):
    rng = np.random.default_rng(4)
    made = lambda n: "".join(rng.choice(list("ABCdefGHIjkl012345-_."), n))
    secrets = [made(int(n)) for n in [40] * 80 + [300, 600, 900, 2000, 5000] * 4]
    secrets[90] = secrets[90][:250] + "/bob@host.example/" + secrets[90][:250]
    rows = [(i, f"the token: {s} end") for i, s in enumerate(secrets)] + [(200 + i, ["version 4.0 and 1.2.3.999 or 12345", "password = aaaaaaaa"][i % 2]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert [masked[i] for i in range(100) if i != 90] == ["the token: [SECRET] end"] * 99
    assert masked[90] == "the token: [SECRET][EMAIL][SECRET] end"
    spans = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    assert all(spans[i] == f"secret:11:{11 + len(s)}" for i, s in enumerate(secrets) if i != 90)


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(1)
    n = 20_000
    truth = rng.random(n) < 0.3
    votes = np.stack([np.where(rng.random(n) < 0.2, 0, np.where(truth ^ (rng.random(n) > p), 1, 2)) for p in (0.95, 0.9, 0.8, 0.85)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rates, q = pii.expectation_maximisation(np.zeros(len(patterns), dtype=int), patterns, counts.astype(float))
    assert abs(prior[0] - 0.3) < 0.05
    assert all(abs(rates[1, j, 1] / (rates[1, j, 1] + rates[1, j, 2]) - p) < 0.05 for j, p in enumerate((0.95, 0.9, 0.8, 0.85)))


def test_mask_keeps_columns_and_clean_texts(odd, documents):
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert sorted(str(r.text) for r in masked.collect()) == sorted(str(r.text) for r in odd.collect())
    before = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.mask(documents).collect():
        assert not plain(r.text)
        if not plain(before[r.doc_id]) and "token" not in before[r.doc_id] and "password" not in before[r.doc_id] and "AKIA" not in before[r.doc_id]:
            assert r.text == before[r.doc_id]


def test_masked_overlaps():
    assert pii.masked("ab 12 cd", [("ip", 3, 5), ("card", 3, 4)]) == "ab [IP] cd" and pii.masked("x", []) == "x"


def test_empty(empty):
    assert pii.detect(empty).count() == 0 and pii.mask(empty).count() == 0


def test_added_parts_equal_a_scan_of_all_spans():
    rng = random.Random(12)
    for _ in range(500):
        spans = [("email", a, a + rng.randint(1, 6)) for a in rng.choices(range(60), k=rng.randint(0, 8))]
        a = rng.randrange(60)
        b = a + rng.randint(1, 25)
        free = [i for i in range(a, b) if not any(x <= i < y for _, x, y in spans)]
        parts = [(i, next(j for j in range(i + 1, b + 1) if j not in free)) for i in free if i - 1 not in free]
        covered = pii._union(spans)
        assert pii._added("secret", a, b, covered) == parts
        assert pii._added("phone", a, b, covered) == ([(a, b)] if len(free) == b - a else [])


def test_many_spans_take_linear_time():
    def seconds(n):
        text = " ".join(f"mail{i}@example.com call 0{i % 900 + 100} 555 01{i % 90 + 10}" for i in range(n))
        began = time.process_time()
        pii.candidates(text)
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 8 * max(seconds(2000), 0.02)
