"""Token counts and packing against the tokenizer library."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gapfeed.llm import packing, token_counts
from gapfeed.llm._bpe import PieceEncoder, prefix_counts
from gapfeed.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, documents, odd, library):
    for docs in (documents, odd):
        texts = docs.select("doc_id", "text").collect()
        got = token_counts.count_tokens(docs, tokenizer_path(), limit=50).collect()
        assert len(got) == len(texts)
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(ids(library, r.text))) for r in texts)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 50) for r in got)


def test_fitting_prefix_is_the_longest(documents, library):
    docs = documents.where("doc_id < 25")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs, tokenizer_path(), limit=40).collect():
        t, k = texts[r.doc_id], r.fit_chars
        assert len(ids(library, t[:k])) <= 40
        assert all(len(ids(library, t[:j])) > 40 for j in range(k + 1, min(len(t), k + 25) + 1))
    cut = token_counts.truncate(docs, tokenizer_path(), 40).collect()
    assert all(len(ids(library, r.text)) <= 40 for r in cut) and len(cut) == docs.count()


def test_every_prefix(library):
    encoder = PieceEncoder.of(tokenizer_path())
    text = "Thinly edward's heed-ing, 12 é übergroße don't!! ok"
    (counts,) = encoder.counts([text])
    table = token_counts.PrefixTable(text, encoder, counts)
    assert [table.at(k) for k in range(len(text) + 1)] == [len(ids(library, text[:k])) for k in range(len(text) + 1)]


OTHER = ["日本語のテキスト、 mixed “quotes” — и текст €5", "a<|endoftext|>b !!<|endoftext|> <|endof c", "Cafe\u0301 naïve İstanbul ß ﬁ 각 한글 ก็ e\u0301", "x<|startoftext|><|endoftext|>'re", "мир-труд 12３ ½ 👍🏽👍"]


@pytest.mark.parametrize("text", OTHER)
def test_every_prefix_of_other_scripts(library, text):
    encoder = PieceEncoder.of(tokenizer_path())
    assert encoder.counts([text]) == [None]
    table = token_counts.PrefixTable(text, encoder, None)
    want = [len(ids(library, text[:k])) for k in range(len(text) + 1)]
    assert [table.at(k) for k in range(len(text) + 1)] == want
    for budget in range(max(want) + 1):
        assert table.fits(budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_long_text_without_spaces(library):
    text = "".join(chr(0x3042 + i * 7 % 80) for i in range(100_000))
    began = time.process_time()
    table = token_counts.PrefixTable(text, PieceEncoder.of(tokenizer_path()), None)
    k = table.fits(2048)
    assert time.process_time() - began < 10
    assert table.running[-1] == len(ids(library, text)) and len(ids(library, text[:k])) <= 2048 < len(ids(library, text[: k + 1]))


def test_dynamic_programme_equals_encoding(library):
    encoder = PieceEncoder.of(tokenizer_path())
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "ing", "q", "ea", "lich", "x", "tion"]) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    for w in words:
        assert prefix_counts(w, encoder.merges) == [len(ids(library, w[:k])) for k in range(1, len(w) + 1)]


def test_long_random_word(library):
    rng = random.Random(8)
    encoder = PieceEncoder.of(tokenizer_path())
    for letters, script in (("abcdefghijklmnopqrstuvwxyz", True), ("абвгдежзиклмнопрстуфхцчшэюя", False)):
        text = "see " + "".join(rng.choice(letters) for _ in range(100_000)) + " end"
        (counts,) = encoder.counts([text])
        assert (counts is not None) == script
        began = time.process_time()
        table = token_counts.PrefixTable(text, encoder, counts)
        k = table.fits(2048)
        assert time.process_time() - began < 4
        assert len(ids(library, text[:k])) <= 2048 < min(len(ids(library, text[:j])) for j in range(k + 1, k + 40))
        assert table.at(5_000) == len(ids(library, text[:5_000]))


def test_words_of_few_letters(library):
    """Repeated letters merge in many overlapping ways."""
    encoder = PieceEncoder.of(tokenizer_path())
    rng = random.Random(6)
    for _ in range(60):
        w = "".join(rng.choice("aeinst" if rng.random() < 0.5 else "xyhaz") for _ in range(rng.randint(1, 40))) + rng.choice("mh") * rng.randint(0, 9)
        assert prefix_counts(w, encoder.merges) == [len(ids(library, w[:k])) for k in range(1, len(w) + 1)]


def test_table_of_pieces_may_be_emptied(library, documents):
    texts = [r.text for r in documents.limit(60).collect()]
    small = PieceEncoder(tokenizer_path(), most_pieces=50)
    for t in texts:
        assert small.ids([t])[0].tolist() == ids(library, t)


def mixed_words(seed, n):
    rng = random.Random(seed)
    letters = ["th", "er", "ing", "q", "ea", "lich", "x", "tion", "é", "ß", "z", "ȷ"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(n)]
    return [w * 4 if i % 50 == 7 else w + "!?" * (i % 9 == 0) for i, w in enumerate(words)]


def test_pieces_of_all_lengths_merge_in_the_same_rounds(monkeypatch):
    """Pairs are looked up once a round for all new pieces, not once for each of their lengths."""
    encoder = PieceEncoder(tokenizer_path())
    words = [w for w in mixed_words(3, 2_000) if len(w) <= 24]
    calls, find = [], type(encoder.merges).find
    monkeypatch.setattr(type(encoder.merges), "find", lambda self, a, b: calls.append(len(a)) or find(self, a, b))
    encoder.ids([" ".join(words)])
    assert len({len(w) for w in words}) > 15 and 0 < len(calls) <= 2 * 24


@pytest.mark.parametrize("at_once", [1, 7, 3_000])
def test_mixed_pieces_equal_the_library(library, at_once):
    """Short and long pieces, new and known, in any order and number."""
    words = mixed_words(4, 3_000)
    encoder = PieceEncoder(tokenizer_path(), most_pieces=1_500)
    texts = [" ".join(words[a : a + at_once]) for a in range(0, len(words), at_once)]
    assert any(len(w) > 48 for w in words)
    assert [x.tolist() for t in texts for x in encoder.ids([t, "", t])] == [x for t in texts for x in (ids(library, t), [], ids(library, t))]


def test_stopped_merging_leaves_no_wrong_rows(library, monkeypatch):
    encoder = PieceEncoder(tokenizer_path())
    encoder.ids(["some words first"])
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(type(encoder.merges), "run", lambda self, pieces: (_ for _ in ()).throw(KeyboardInterrupt))
        encoder.ids(["words that stay behind"])
    assert encoder.ids(["others that stay first"])[0].tolist() == ids(library, "others that stay first")


def test_encoder_is_small():
    """Workers keep it, beside a JVM that takes most of an executor's memory."""
    tracemalloc.start()
    try:
        encoder = PieceEncoder(tokenizer_path())
        encoder.ids([" ".join(f"word{i}" for i in range(50_000))])
        encoder.forget()
        assert tracemalloc.get_traced_memory()[0] < 16 << 20
    finally:
        tracemalloc.stop()
    assert "tokenizer" not in vars(encoder)  # Latin texts don't need the library's


def test_packing_task_leaves_no_pieces(documents, monkeypatch):
    monkeypatch.setattr(type(documents), "mapInArrow", lambda self, run, schema: run)
    run = packing.pieces(documents, tokenizer_path())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], names=["doc_id", "text"])
    assert sum(len(b) for b in run(iter([batch]))) == 3
    assert not PieceEncoder.of(tokenizer_path()).index


def test_prefix_tables(documents, library):
    docs = documents.where("doc_id < 5")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.prefix_tables(docs, tokenizer_path()).collect():
        for e, c in list(zip(r.ends, r.counts))[::40]:
            assert len(ids(library, texts[r.doc_id][:e])) == c


def test_packing_round_trip(spark, documents, odd, library):
    for docs in (documents, odd):
        texts = docs.select("doc_id", "text").collect()
        got = packing.pack(docs, tokenizer_path(), longest=256, with_ids=True).collect()
        assert len({r.sequence_id for r in got}) == len(got)
        by = {}
        for r in got:
            assert r.length & (r.length - 1) == 0 and r.length <= 256 and r.offset == 0 and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
            by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        want = {}
        for t in texts:
            x = ids(library, t.text) + [2]
            want.setdefault((t.doc_id, len(x)), []).append(x)
        assert {k: sum(map(len, v)) for k, v in want.items()} == {k: sum(r.length for r in v) for k, v in by.items()}
        for key, rows in by.items():
            if len(want[key]) == 1:
                rows.sort(key=lambda r: r.start)
                assert sum((r.ids for r in rows), []) == want[key][0]
                assert [r.start for r in rows] == np.cumsum([0, *[r.length for r in rows]])[:-1].tolist()


def test_lengths():
    assert packing.lengths_of(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.lengths_of(0, 8) == []


def test_empty(empty):
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
