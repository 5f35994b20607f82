"""Language identification: a dictionary Kneser-Ney, held-out accuracy, scripts, odd texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from gapfeed.llm import language_id as L

SYLLABLES = {"xx": ["ka", "to", "mi", "re", "su"], "yy": ["ble", "strong", "wick", "ham", "ford"], "zz": ["ção", "lhe", "nha", "dor", "ves"]}
#: Languages that share a script, or a block of 128 code points.
SCRIPTS = {"hi": "कखगघचछजझ", "mr": "टठडढणतथद", "zh": "的一是不了在人有", "ja": "のはをがにでとも", "ko": "가나다라마바사아", "th": "กขคงจฉชซ", "ru": "оеаинтсрв", "uk": "іїєґщюяйь"}


def texts_of(parts, rng, spaces=" "):
    return spaces.join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80)))


def corpus(spark, languages=SYLLABLES, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        g = rng.choice(sorted(languages))
        rows.append((i, texts_of(languages[g], rng), g))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), {i: g for i, _, g in rows}


def test_held_out_accuracy(spark):
    docs, truth = corpus(spark)
    got = L.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and not r.rejected for r in held)


def test_scripts_are_told_apart(spark):
    docs, truth = corpus(spark, SCRIPTS, 400)
    held = [r for r in L.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99 and not any(r.rejected for r in held)


def test_labels_of_held_out_documents_are_not_used(spark):
    docs, truth = corpus(spark)
    wrong = docs.withColumn("lang", F.when(L.held_out("doc_id"), "qq").otherwise(F.col("lang")))
    got = {r.doc_id: r.lang_pred for r in L.identify(wrong).collect()}
    assert set(got.values()) == set(SYLLABLES) and sum(got[i] == g for i, g in truth.items()) > 0.97 * len(truth)


class Dictionary:
    """Interpolated Kneser-Ney over tuples of classes, by the textbook's recursion."""

    def __init__(self, texts, symbols, order=L.ORDER, d=0.75):
        self.order, self.d, self.symbols = order, d, symbols
        grams = Counter(g for t in texts for g in t)
        self.counts = {order: grams}
        for n in range(order - 1, 0, -1):
            longer = {g[-(n + 1) :] for g in grams}
            self.counts[n] = Counter(g[1:] for g in longer)
        self.after = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.after[n][g[:-1]].append(k)

    def p(self, g):
        if not g:
            return 1 / self.symbols
        n, below = len(g), self.p(g[1:])
        follow = self.after[n].get(g[:-1])
        if not follow:
            return below
        return max(self.counts[n][g] - self.d, 0) / sum(follow) + self.d * len(follow) / sum(follow) * below


def tuples(text, alphabet):
    """The n-grams of a text as tuples: 0 for what is no letter (runs as one), letters by place, others one more."""
    c = [0]
    for ch in text:
        x = alphabet.index(ch.lower()) + 1 if ch.lower() in alphabet else len(alphabet) + 1 if ch.isalpha() else 0
        if x or c[-1]:
            c.append(x)
    if c[-1]:
        c.append(0)
    c = [0] * (L.ORDER - 1) + c
    return [tuple(c[i - L.ORDER + 1 : i + 1]) for i in range(L.ORDER, len(c))]


def test_equals_dictionary_kneser_ney():
    rng = random.Random(9)
    alphabet = sorted(set("".join("".join(s) for s in SYLLABLES.values())))
    table = L.alphabet_table(alphabet, L.letters_table())
    train = {g: [texts_of(s, rng) for _ in range(12)] for g, s in SYLLABLES.items()}
    counts = {g: np.unique(np.concatenate([c for t in some for c in L.grams(t, table)]), return_counts=True) for g, some in train.items()}
    model = L.train(counts, alphabet)
    books = {g: Dictionary([tuples(t, alphabet) for t in some], len(alphabet) + 2) for g, some in train.items()}
    unseen = ["kato  Strong,wick 12 ção ζ x", "q", "", "!!", *(texts_of(sum(SYLLABLES.values(), []), rng) for _ in range(10))]
    h, n = L.Scorer(model, table).entropies(unseen)
    for t, row, size in zip(unseen, h, n):
        grams = tuples(t, alphabet)
        assert size == len(grams)
        for i, g in enumerate(model.languages):
            want = -sum(np.log(books[g].p(x)) for x in grams) / max(1, len(grams))
            assert abs(row[i] - want) < 1e-4, (t, g)


def test_slices_and_batches_do_not_matter(monkeypatch):
    table = L.alphabet_table(list("abcde"), L.letters_table())
    text = "abc  de, ab" * 7 + " " * 9 + "cde"
    whole = np.concatenate(list(L.grams(text, table)))
    for size in (1, 2, 3, 10, 1000):
        assert np.array_equal(np.concatenate(list(L.grams(text, table, size))), whole)
    model = L.train({"g": np.unique(whole, return_counts=True)}, list("abcde"))
    h, _ = L.Scorer(model, table).entropies([text, "abde", text])
    monkeypatch.setattr(L, "SLICE", 16)
    monkeypatch.setattr(L, "CACHE_BYTES", 1)
    again, _ = L.Scorer(model, table).entropies(["abde", text])
    assert h[0] == h[2] and np.allclose(again[1], h[0]) and np.allclose(again[0], h[1])


def test_probabilities_sum_to_one():
    alphabet = list("abcde")
    table = L.alphabet_table(alphabet, L.letters_table())
    codes, n = np.unique(np.concatenate(list(L.grams("abc abd cab dead bed", table))), return_counts=True)
    model = L.train({"g": (codes, n)}, alphabet)
    b = L.BITS
    for context in (0, int(codes[3]) >> b, (5 << 2 * b) | (1 << b) | 2, (6 << 2 * b) | (6 << b) | 6):
        every = (context << b) | np.arange(model.symbols)
        assert abs(np.exp(model.log_probabilities(every)[:, 0].astype(float)).sum() - 1) < 1e-5


def test_rejection_keeps_mixed_texts_and_drops_noise(spark):
    docs, _ = corpus(spark)
    model = L.fit(docs)
    rng = random.Random(1)
    noise = "".join(rng.choice("qjxzvwkhgfpQJXZVWK") for _ in range(400))
    some = spark.createDataFrame([(1, "kato misure " * 20 + "blestrong wickford " * 20), (2, noise), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(some, model, keep=["doc_id"]).collect()}
    assert not got[1].rejected and got[2].rejected
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (3, 4, 5))


def test_odd_and_empty(odd, empty):
    got = L.identify(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got} <= {"en", "und"}
    clashing = odd.withColumns({"score": F.lit("own"), "rejected": F.lit(5), "lang_pred": F.lit("mine"), "said": F.lit(1), "row": F.lit(2)})
    kept = L.keep_identified(clashing)
    assert kept.columns == clashing.columns and all(r.text and r.text.strip() and r.score == "own" and r.lang_pred == "mine" for r in kept.collect())
    assert L.identify(empty).count() == 0 and L.keep_identified(empty).count() == 0


def test_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in L.identify(docs).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
