"""Cross-tokenizer alignment by diagonal run skipping.

A text is encoded by a byte-level tokenizer (A, over space+text) and a piece
tokenizer (B, which adds the space itself), each unit between spaces once for as long as it is remembered. Both are
lists of ascending byte ends. At a shift of indexes the two lists are compared in stretches that double
for as long as they are equal (then halve to find the first difference), so a
stretch of one-to-one tokens is a few comparisons. At a difference the two lists
are walked, the one that ends earlier first, until they end at one byte again:
an irregular group, after which the shift is updated and stretches go on.

Links are the pairs of tokens that share bytes. Within a group the walk meets
each of them once; a group of n and m tokens has n + m - 1.

How often ids are linked in the corpus comes from one aggregation over each
document's distinct pairs. The pairs linked most often (at most `hot_pairs`, whose
number is counted) are broadcast to the documents' pairs; the rest, none of which
is hot, meet them by an ordinary join. Ids, counts and links never come to the driver.

Texts that are null, empty, or that one of the tokenizers changes (normalised
characters, an unknown piece, a literal U+2581) have no tokens: zeros and ''.
Long texts are taken whole. Repeated rows count each on their own, whatever
their ids (null too). An empty table yields no rows. Only the id and the
text are read of the input's columns.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import ship, text_chunks
from gapfeed.shipping import Scratch, materialize

#: Bytes of text encoded at once (a longer text is its own chunk).
CHUNK = 1 << 19
#: Rows of (long, long, boolean) that are broadcast: about 48 MB in an executor.
HOT_PAIRS = 1_000_000
BORDER, WIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")
#: Length of the first comparison of a stretch.
PROBE = 4

_loaded: dict[tuple[str, str], "Units"] = {}


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: visible Latin-1 ones as themselves, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in seen}
    return table | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(seen))}


class Pair:
    """The two tokenizers, and the bytes of every token of theirs."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(size))))]
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        #: An id within its group, the last one of A's, the last one of B's.
        self.said, self.said_last_a, self.said_last_b = (np.array([f"{i}{c}" for i in ids], dtype=object) for c in ",|;")
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))

    @staticmethod
    def of(byte_level: str, pieces: str) -> Units:
        """One for each worker process."""
        key = (byte_level, pieces)
        if key not in _loaded:
            _loaded[key] = Units(Pair(byte_level, pieces))
        return _loaded[key]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of " " + text by A, of text by B, and whether the bytes of both are those of " " + text."""
        spaced = [" " + t for t in texts]
        a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        same = [b"".join([self.a_bytes[i] for i in x]) == t.encode() == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(spaced, a, b)]
        return a, b, same

    def encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """A's and B's ids of units without white space at their ends, and how many each unit has of either, from
        one encoding of all with spaces between them; None where the bytes of any differ."""
        text = " ".join(units)
        raw = (" " + text).encode()
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        out = []
        for ids, names, sizes in ((self.a.encode(" " + text, add_special_tokens=False).ids, self.a_bytes, self.a_sizes), (self.b.encode(text), self.b_bytes, self.b_sizes)):
            if b"".join(map(names.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, dtype=np.int64)
            to = np.cumsum(sizes[ids])
            last = np.searchsorted(to, ends)
            if not np.array_equal(to[last], ends):
                return None
            out += [ids, np.diff(np.concatenate([[0], last + 1]))]
        return tuple(out)


class Units:
    """Encodings of the units of texts, kept for as long as they are few enough.

    A unit begins at a space between two characters that are no white space. A's pieces begin there, and as no piece of
    B holds a space behind another character, neither does B merge over it: so the ids of a text are those of its
    units. (A pair of tokenizers for which that doesn't hold has whole texts as units.)
    """

    #: Units and ids that are remembered, and units that are encoded together.
    MOST, LONGEST, TOGETHER = 200_000, 4_000_000, 256

    def __init__(self, pair: Pair):
        self.pair = pair
        spaces_lead = all(re.fullmatch("▁*[^▁]*", p) for p in pair.b.id_to_piece(list(range(pair.b.get_piece_size()))))
        shape = json.loads(pair.a.to_str())
        plain = shape["normalizer"] is None and shape["pre_tokenizer"] and shape["pre_tokenizer"]["type"] == "ByteLevel" and shape["pre_tokenizer"]["use_regex"]
        self.cut = spaces_lead and plain and pair.b.encode("a  b\tc", out_type=str)[:3] == ["▁a", "▁", "▁b"]
        self.empty()

    def empty(self) -> None:
        self.index: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.a, self.b = _Flat(), _Flat()

    def units(self, text: str) -> list[str]:
        if not self.cut:
            return [text]
        # no two white space characters side by side, none at an end: every space is a border
        simple = not WIDE.search(text) and not text[0].isspace() and not text[-1].isspace()
        return text.split(" ") if simple else BORDER.split(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's and B's ids of all texts end to end, and where each text's begin (one more than texts);
        none for texts that are empty or whose bytes differ."""
        split = [self.units(t) if t else [] for t in texts]
        flat = [u for s in split for u in s]
        if self.a.size + self.b.size > self.LONGEST or len(self.index) > self.MOST:
            self.empty()
        counted = Counter(flat)
        missing = [u for u, n in counted.items() if n > 1 and u not in self.index]
        self._learn(missing)  # what is met once here is forgotten with this call
        marks = len(self.same), self.a.mark(), self.b.mark()
        once = [u for u, n in counted.items() if n == 1 and u not in self.index]
        self._learn(once)
        rows = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        of = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        bad = np.bincount(of[~self.same[rows]], minlength=len(texts)) > 0
        keep = ~bad[of]
        rows, of = rows[keep], of[keep]
        out = []
        for side in (self.a, self.b):
            ids, sizes = side.take(rows)
            out += [ids, np.concatenate([[0], np.cumsum(np.bincount(of, weights=sizes, minlength=len(texts)))]).astype(np.int64)]
        for u in once:
            del self.index[u]
        self.same = self.same[: marks[0]]
        self.a.back(marks[1])
        self.b.back(marks[2])
        return tuple(out)

    def _learn(self, units: list[str]) -> None:
        """Append the encodings of units, in a new order."""
        plain = [u for u in units if self.cut and not u[0].isspace() and not u[-1].isspace()]
        odd = [u for u in units if not (self.cut and not u[0].isspace() and not u[-1].isspace())]
        order, same = [], []
        for at in range(0, len(plain), self.TOGETHER):
            some = plain[at : at + self.TOGETHER]
            got = self.pair.encode_joined(some)
            if got is None:
                odd += some
                continue
            self.a.add(got[0], got[1])
            self.b.add(got[2], got[3])
            order += some
            same += [True] * len(some)
        if odd:
            a, b, ok = self.pair.encode(odd)
            for side, lists in ((self.a, a), (self.b, b)):
                side.add(np.array(list(itertools.chain.from_iterable(lists)), dtype=np.int64), np.array([len(x) for x in lists], dtype=np.int64))
            order += odd
            same += ok
        self.index.update(zip(order, range(len(self.index), len(self.index) + len(order))))
        self.a.settle()
        self.b.settle()
        self.same = np.concatenate([self.same, np.array(same, bool)])


class _Flat:
    """Lists of ids end to end."""

    def __init__(self):
        self.ids, self.start, self.length, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, length: np.ndarray) -> None:
        self.new.append((ids, length))

    def settle(self) -> None:
        if self.new:
            length = np.concatenate([n for _, n in self.new])
            self.start = np.concatenate([self.start, self.size + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.ids = np.concatenate([self.ids, *(i for i, _ in self.new)])
            self.size, self.new = len(self.ids), []

    def mark(self) -> tuple[int, int]:
        return len(self.length), self.size

    def back(self, mark: tuple[int, int]) -> None:
        """Forget what was added after a mark."""
        lists, self.size = mark
        self.start, self.length, self.ids = self.start[:lists], self.length[:lists], self.ids[: self.size]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[rows]
        return self.ids[spread(self.start[rows], length)], length


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for `length` numbers, one row after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def stretch(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from a[i] and b[j] on are equal in pairs: the compared length doubles as long as all are, then
    halves down to a few, which are compared one by one."""
    at, k = i, PROBE
    shift = j - i
    while True:
        x = a[at : at + k]
        if x != b[at + shift : at + shift + k]:
            break
        at += len(x)
        if len(x) < k:
            return at - i
        k *= 2
    while k > PROBE:
        k //= 2
        x = a[at : at + k]
        if x == b[at + shift : at + shift + k]:
            at += len(x)
    while a[at] == b[at + shift]:
        at += 1
    return at - i


def align(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """The alignment of two ascending lists of ends with one last end.

    Stretches i, j, n, i, j, n, ... of n one-to-one groups from a[i] and b[j] on; of the irregular groups the links, as indexes of a
    and of b, and the last index of each group in a and in b.
    """
    stretches, x, y, last_x, last_y = [], [], [], [], []
    link_x, link_y = x.append, y.append
    i = j = 0
    n_a = len(a)
    while i < n_a:
        end_a, end_b = a[i], b[j]
        if end_a == end_b:
            n = stretch(a, b, i, j)
            stretches += (i, j, n)
            i += n
            j += n
            continue
        link_x(i)
        link_y(j)
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = a[i]
            else:
                j += 1
                end_b = b[j]
            link_x(i)
            link_y(j)
        last_x.append(i)
        last_y.append(j)
        i += 1
        j += 1
    return stretches, x, y, last_x, last_y


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _aligned(texts: list[str], units: Units, with_groups: bool) -> list[pa.Array]:
    """The columns of `alignments` from n_a on, from one alignment of all texts laid end to end."""
    pair = units.pair
    a_ids, a_from, b_ids, b_from = units.encode(texts)
    stretches, x, y, last_x, last_y = align(np.cumsum(pair.a_sizes[a_ids]).tolist(), np.cumsum(pair.b_sizes[b_ids]).tolist())
    i, j, n = np.array(stretches, dtype=np.int64).reshape(-1, 3).T
    straight_a, straight_b = spread(i, n), spread(j, n)
    last_a, last_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    last_a[straight_a] = last_b[straight_b] = True
    last_a[last_x] = last_b[last_y] = True
    a_ends, b_ends = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1

    # links: each document's pairs of ids, and how many links hold each
    at = np.concatenate([straight_a, np.array(x, dtype=np.int64)])
    code = a_ids[at] << 32 | b_ids[np.concatenate([straight_b, np.array(y, dtype=np.int64)])]
    doc = np.searchsorted(a_from, at, side="right") - 1
    n_links = np.bincount(doc, minlength=len(texts))
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(code)]]))
    pairs_from = np.searchsorted(doc[new], np.arange(len(texts) + 1))

    # groups: A's ids, a bar and B's ids, in order
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    said = np.empty(len(a_ids) + len(b_ids), dtype=object)
    said[np.arange(len(a_ids)) + np.concatenate([[0], b_ends])[group_a]] = np.where(last_a, pair.said_last_a[a_ids], pair.said[a_ids])
    said[np.arange(len(b_ids)) + a_ends[group_b]] = np.where(last_b, pair.said_last_b[b_ids], pair.said[b_ids])
    said = said.tolist()
    both = a_from + b_from
    digests = [hashlib.sha256("".join(said[p:q])[:-1].encode()).hexdigest() if q > p else "" for p, q in zip(both[:-1].tolist(), both[1:].tolist())]
    groups_from = np.concatenate([[0], np.cumsum(last_a)])[a_from]
    out = [pa.array(np.diff(a_from)), pa.array(np.diff(b_from)), pa.array(np.diff(groups_from)), pa.array(n_links), pa.array(digests, pa.string()), _lists(pairs_from, code[new]), _lists(pairs_from, times)]
    if with_groups:
        first_a, first_b = (np.repeat(f[:-1], np.diff(groups_from)) for f in (a_from, b_from))
        out += [_lists(a_from, a_ids), _lists(b_from, b_ids), _lists(groups_from, a_ends - first_a), _lists(groups_from, b_ends - first_b)]
    return out


def alignments(docs: DataFrame, byte_level: str, pieces: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, a_ids, b_ids, a_ends, b_ends]) of every document.

    `pairs` are its distinct linked ids, A's in the upper 32 bits, and `times` how many links hold each. `a_ends` and
    `b_ends` say how many of A's and B's tokens the first 1, 2, ... groups take. `row` is a key of its own.
    """
    ship(docs.sparkSession)
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["a_ids", "b_ids", "a_ends", "b_ends"] * with_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Pair.of(byte_level, pieces)
        gc.disable()  # numbers in lists make no cycles, and there are millions
        for batch in batches:
            for x, y in text_chunks(batch.column(2), CHUNK):
                some = batch.slice(x, y - x)
                columns = _aligned(some.column(2).fill_null("").to_pylist(), units, with_groups)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], names=["row", "id", *names])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"row long, id {docs.schema[id_col].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return keyed.mapInArrow(run, schema + ", a_ids array<long>, b_ids array<long>, a_ends array<long>, b_ends array<long>" * with_groups)


def _each_pair(aligned: DataFrame) -> DataFrame:
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, n, best) of all linked ids: n links hold them; best says whether no other id of A has more with that b."""
    counts = _each_pair(aligned).groupBy("pair").agg(F.sum("times").alias("n"))
    ids = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")
    # one row for each id of B that occurs
    return ids.join(ids.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _hot_from(counts: DataFrame, hot_pairs: int) -> tuple[int, bool]:
    """The least n (a power of two) such that at most `hot_pairs` pairs have it, and whether others are left."""
    by_size = {r.size: r.pairs for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect()}  # 63 rows at most
    taken, least = 0, 63
    for size in range(62, -1, -1):
        taken += by_size.get(size, 0)
        if taken > hot_pairs:
            break
        least = size
    return 1 << least, any(size < least for size in by_size)


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, hot_pairs: int = HOT_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    with Scratch(docs.sparkSession) as scratch:
        aligned = scratch.table(alignments(docs, byte_level, pieces, id_col=id_col, text_col=text_col), "aligned")
        counts = scratch.table(pair_counts(aligned).select("pair", "n", "best"), "counts")
        least, rest = _hot_from(counts, hot_pairs)
        each = _each_pair(aligned)
        hot = F.broadcast(counts.where(F.col("n") >= least))  # at most hot_pairs rows, as just counted
        sums = (F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
        # a document's pairs are in one task, so only a row of each leaves it
        found = each.join(hot, "pair").groupBy("row").agg(*sums)
        if rest:
            others = each.join(hot, "pair", "left_anti").join(counts.where(F.col("n") < least).hint("merge"), "pair").groupBy("row").agg(*sums)
            found = found.unionByName(others).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
        digests = aligned.drop("pairs", "times").join(found, "row", "left")
        return materialize(
            digests.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"),
            "token-alignment",
        )
