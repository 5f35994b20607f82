"""Piece-wise encoding with a public BPE file that ends its pieces with an end-of-word suffix.

A text's ids are the ids of its pre-tokenizer pieces, joined. Texts of Latin
characters are split and merged here, all new pieces of a batch at once; any
other text, and any that holds the opening of a special token's string, goes
to the library whole.
"""

from __future__ import annotations

import itertools
import json
import re
from functools import cached_property

import numpy as np
from tokenizers import Tokenizer

_encoders: dict[tuple[str, int], "PieceEncoder"] = {}
#: Texts whose lower case, composition and character classes need no table: Latin up to U+024F, no control characters but white space.
_LATIN = re.compile("[\t-\r\x20-\x7e\xa0-\u012f\u0131-\u024f]*")
#: The file's own split pattern within those characters, after lower-casing.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u024f]+")
#: Characters of the longest piece that is merged here.
LONGEST = 48
_NONE = np.iinfo(np.int32).max


def _read(path: str) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """A file's vocabulary, end-of-word suffix and merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], model["end_of_word_suffix"], [tuple(p.split(" ") if isinstance(p, str) else p) for p in model["merges"]]


def _letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}


class Rules:
    """How each token of a file is made, and whether tokens side by side stay apart."""

    def __init__(self, path: str):
        vocab, suffix, merges = _read(path)
        byte = {c: b for b, c in _letters().items()}
        #: How each merged token is made: its two parts and the merge's rank.
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], rank))
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
        self.inner_tokens: dict[bytes, int] = {}
        self.final_tokens: dict[bytes, int] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        for token, i in vocab.items():
            bare = token.removesuffix(suffix)
            if all(c in byte for c in bare) and (len(bare) == 1 or self._alone(i)):
                (self.final_tokens if bare != token else self.inner_tokens)[bytes(byte[c] for c in bare)] = i
        self.longest_token = max(map(len, [*self.inner_tokens, *self.final_tokens]))

    def _alone(self, token: int) -> bool:
        """Whether a token's own bytes are merged to it: its parts are, and nothing merges over their border before they do."""
        if token not in self.parts:
            return False
        a, b, rank = self.parts[token]
        return self._border(a, b, rank) and all(x not in self.parts or self._alone(x) for x in (a, b))

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay two."""
        key = (a, b)
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) > 1_000_000:
                self._apart.clear()
            found = self._apart[key] = self._border(a, b, _NONE)
        return found

    def _border(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank below `before` joins a's end with b's start. The merges that made a
        and b are undone from the last one on; a pair over the border merges first if its rank is
        less than the last one's, or as small where that one is to the right of the border."""
        while True:
            if self.ranks.get((a, b), _NONE) < before:
                return False
            made_a, made_b = self.parts.get(a), self.parts.get(b)
            rank_a, rank_b = made_a[2] if made_a else -1, made_b[2] if made_b else -1
            if max(rank_a, rank_b) < 0:
                return True
            if rank_a > rank_b:
                a, before = made_a[1], rank_a
            else:
                b, before = made_b[0], rank_b + 1


class Merges:
    """The merge rules of a BPE file with an end-of-word suffix, applied to many pieces at once. Only arrays of their
    size are kept; `rules`, which no merging needs, are read when first asked for."""

    def __init__(self, path: str):
        self.path = path
        vocab, suffix, merges = _read(path)
        self.size = max(vocab.values()) + 1
        letter = _letters()
        self.inner = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letter[b] + suffix] for b in range(256)], dtype=np.int64)
        self.letters = {c: b for b, c in letter.items()}
        #: What the merge of each rank makes.
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.bits = max(8, (4 * len(merges)).bit_length())
        slots = 1 << self.bits
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.rank = np.full(slots, _NONE, dtype=np.int32)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[at] not in (-1, key):
                at = (at + 1) & (slots - 1)
            if self.keys[at] == -1:
                self.keys[at], self.rank[at] = key, rank

    @cached_property
    def rules(self) -> Rules:
        return Rules(self.path)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest where none merges."""
        key = left * self.size + right
        at = self._slot(key)
        there, rank = self.keys[at], self.rank[at]  # an empty slot has the largest rank
        todo = np.flatnonzero((there != key) & (there != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there, rank[todo] = self.keys[at[todo]], self.rank[at[todo]]
            todo = todo[(there != key[todo]) & (there != -1)]
        return rank

    def run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces without line ends, end to end, and how many each has."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        step = 200_000 // LONGEST
        for a in range(0, len(pieces), step):
            raw = np.frombuffer("\n".join([*pieces[a : a + step], ""]).encode(), dtype=np.uint8)
            ends = np.flatnonzero(raw == 10)
            ids, left = self._together(raw[raw != 10], np.diff(ends, prepend=-1) - 1)
            flat.append(ids)
            lengths.append(left)
        return np.concatenate(flat), np.concatenate(lengths)

    def _together(self, raw: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces end to end, and the bytes of each. In each round the pair of lowest rank, leftmost first, merges in
        every piece that has one, whatever its length; the others are left out from then on."""
        out, alive = self.inner[raw], np.ones(len(raw), dtype=bool)
        last = np.cumsum(count) - 1
        out[last] = self.final[raw[last]]
        # Of the tokens in work: where each lies in `out`, its id, and the rank of it and the next one of its piece.
        at, ids = np.arange(len(raw)), out.copy()
        rank = np.full(len(raw), _NONE, dtype=np.int64)
        rank[:-1] = self.find(ids[:-1], ids[1:])
        rank[last] = _NONE
        while len(count):
            start = np.cumsum(count) - count
            low = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            some = low < _NONE << 32
            here = low[some] & 0xFFFFFFFF
            made = self.made[low[some] >> 32]
            out[at[here]] = ids[here] = made
            alive[at[here + 1]] = False
            keep = np.repeat(some, count)
            keep[here + 1] = False
            inside = here - start[some]
            count = count[some] - 1
            at, ids, rank = at[keep], ids[keep], rank[keep]
            here = np.cumsum(count) - count + inside
            rank[here] = _NONE
            near = np.concatenate([here[inside > 0] - 1, here[inside < count - 1]])
            rank[near] = self.find(ids[near], ids[near + 1])
        return out[alive].astype(np.uint32), np.add.reduceat(alive, last - np.diff(last, prepend=-1) + 1, dtype=np.int64)


class _Rows(dict):
    """A piece's row; a new piece gets the next one."""

    def __missing__(self, piece: str) -> int:
        row = self[piece] = len(self)
        return row


class PieceEncoder:
    """Ids of whole texts. `most_pieces` bounds the table of pieces that a worker keeps: it is
    emptied when full, and results don't depend on it."""

    def __init__(self, path: str, most_pieces: int = 400_000):
        self.path = path
        self.merges = Merges(path)
        self.letters = self.merges.letters
        with open(path, encoding="utf-8") as f:
            self.openings = sorted({t["content"][:2] for t in json.load(f)["added_tokens"]})
        self.most_pieces = most_pieces
        self.forget()

    def forget(self) -> None:
        """Empty the table of pieces, which is most of what an encoder holds: workers outlive their tasks, and other stages need the room."""
        self.index = _Rows()
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    @classmethod
    def of(cls, path: str, most_pieces: int = 400_000) -> "PieceEncoder":
        """One encoder for each worker process."""
        key = (path, most_pieces)
        if key not in _encoders:
            _encoders[key] = cls(path, most_pieces)
        return _encoders[key]

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, read with the first text that needs it."""
        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[bytes]:
        """The pieces of any text without special tokens' strings, by the file's own normaliser and pre-tokenizer; nothing is encoded."""
        of = self.letters
        return [bytes(of[c] for c in p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokenizer's pieces of a text; None: only the library knows."""
        if any(o in text for o in self.openings) or not _LATIN.fullmatch(text):
            return None
        return PIECE.findall(text.lower())

    def rows(self, pieces: list[str]) -> np.ndarray:
        """Each piece's row in `start` and `length`."""
        if len(self.index) != len(self.start):  # stopped before its last pieces were merged
            self.forget()
        base = len(self.index)
        rows = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        if base and len(self.index) > max(base, self.most_pieces):
            self.forget()
            return self.rows(pieces)
        if len(self.index) > base:
            new = list(itertools.islice(reversed(self.index), len(self.index) - base))[::-1]
            long = np.array([len(p) > LONGEST for p in new])
            ids, lengths = self.merges.run([p for p in new if len(p) <= LONGEST])
            if long.any():  # merging here takes time by the square of a piece's length
                got = [np.array(self.whole(p), dtype=np.uint32) for p in new if len(p) > LONGEST]
                ids, lengths = np.concatenate([ids, *got]), np.concatenate([lengths, [len(g) for g in got]])
            start, length = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
            order = np.argsort(long, kind="stable")
            start[order], length[order] = len(self.flat) + np.cumsum(lengths) - lengths, lengths
            self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, ids])
        return rows

    def counts(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the number of tokens of each of its pieces; None: not encoded by pieces."""
        split = [self.pieces(t) for t in texts]
        pieces = list(itertools.chain.from_iterable(p for p in split if p))
        rows = self.rows(pieces)
        lengths = self.length[rows]
        out, at = [], 0
        for p in split:
            if p is None:
                out.append(None)
            else:
                out.append(lengths[at : at + len(p)])
                at += len(p)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.pieces(t) for t in texts]
        pieces = list(itertools.chain.from_iterable(p for p in split if p))
        if pieces:
            rows = self.rows(pieces)
            lengths = self.length[rows]
            ends = np.cumsum(lengths)
            ids = self.flat[np.repeat(self.start[rows] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
            ends = np.concatenate([[0], ends])
        out, at = [], 0
        for t, p in zip(texts, split):
            if p is None:
                out.append(np.array(self.whole(t), dtype=np.uint32))
            elif p:
                out.append(ids[ends[at] : ends[at + len(p)]])
                at += len(p)
            else:
                out.append(np.zeros(0, np.uint32))
        return out


class PrefixCounts:
    """Token counts of the prefixes of one piece, by dynamic programming.

    The last token of a prefix's encoding is the only token ending there that
    stays apart from the last token of the prefix before it, so each prefix
    needs one look at the tokens that end in it and no encoding. Entry i of
    `ended` is the count of the first i + 1 bytes as a piece of their own.
    """

    def __init__(self, merges: Merges):
        self.rules = merges.rules
        self.raw = b""
        self.count, self.last, self.ended = [0], [-1], []

    def extend(self, raw: bytes) -> PrefixCounts:
        m = self.rules
        self.raw += raw
        for i in range(len(self.ended) + 1, len(self.raw) + 1):
            low = max(0, i - m.longest_token)
            a, _ = self._token(low, i, m.final_tokens)
            self.ended.append(self.count[a] + 1)
            a, token = self._token(low, i, m.inner_tokens)
            self.count.append(self.count[a] + 1)
            self.last.append(token)
        return self

    def _token(self, low: int, i: int, tokens: dict[bytes, int]) -> tuple[int, int]:
        """Where the last token of the first i bytes starts, and its id."""
        raw, last, apart = self.raw, self.last, self.rules.apart
        for a in range(low, i):
            token = tokens.get(raw[a:i], -1)
            if token >= 0 and (not a or apart(last[a], token)):
                return a, token
        raise AssertionError("a byte is a token of its own")


def prefix_counts(piece: str, merges: Merges) -> list[int]:
    """Token counts of the prefixes of one piece (entry i: its first i + 1 bytes)."""
    return PrefixCounts(merges).extend(piece.encode()).ended
