"""Token counts of every prefix of a text.

Encoding is additive over a text's pre-tokenizer pieces, so one pass stores the
running count at each piece's end; within a piece a dynamic programme over the
tokens that end at each byte gives the count of each of its prefixes. Together
they answer "how many tokens has text[:k]" and "how much of the text fits in b
tokens" for every k and b without encoding the text again.

Texts that only the library can normalise and split (other scripts, strings of
special tokens) are encoded by it once, with offsets: these give the same
running counts at the ends of pieces. Of such a text only the one cut piece of
a prefix is looked at again: the file's normaliser and pre-tokenizer split it,
and the dynamic programme counts it. Where a cut leaves the opening of a special
token's string, the library encodes what follows the last whole piece.

Nulls count as empty texts; an empty text has no piece and no tokens. Texts of
any length are counted whole. Repeated rows yield repeated rows. Columns other
than id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._bpe import PIECE, PieceEncoder, PrefixCounts, prefix_counts
from gapfeed.llm._common import text_chunks

#: Bytes of text that a worker encodes at once (a longer text is its own chunk).
CHUNK = 1 << 20


class PrefixTable:
    """The counts of all prefixes of one text: ends of pieces (code points) and running counts."""

    def __init__(self, text: str, encoder: PieceEncoder, counts: np.ndarray | None):
        self.text, self.encoder = text, encoder
        self.plain = counts is not None
        if self.plain:
            self.ends = [0] + [m.end() for m in PIECE.finditer(text.lower())]
            self.running = np.concatenate([[0], np.cumsum(counts)]).tolist()
            return
        encoded = encoder.tokenizer.encode(text, add_special_tokens=False)
        special = set(encoder.tokenizer.get_added_tokens_decoder())
        self.tokens = [b for _, b in encoded.offsets]  # where each token ends
        # a piece's tokens have one word id; a special token is a piece of its own
        self.starts, self.ends, self.running, self.special = [0], [0], [0], [False]
        last = None
        for i, (token, word, (a, b)) in enumerate(zip(encoded.ids, encoded.word_ids, encoded.offsets)):
            own = token in special
            if own or self.special[-1] or word != last:
                self.starts.append(a)
                self.ends.append(b)
                self.running.append(i + 1)
                self.special.append(own)
            else:
                self.ends[-1], self.running[-1] = max(b, self.ends[-1]), i + 1
            last = word
        for i, after in enumerate([*self.starts[1:], len(text)]):  # marks composed with a piece's last character are its own
            while i and self.ends[i] < after and not text[self.ends[i]].isspace():
                self.ends[i] += 1

    def at(self, k: int) -> int:
        """Tokens of text[:k]."""
        i = bisect_right(self.ends, k) - 1
        if not self.plain:
            if i + 1 < len(self.ends) and self.special[i + 1] and self.starts[i + 1] < k and self.ends[i] == self.starts[i + 1] and not self.special[i]:
                i -= 1  # what is left of a special string is ordinary and may belong to the piece before it
            i = max(i, 0)
            return self.running[i] + self._tokens(self.text[self.ends[i] : k])
        rest = self.text[self.ends[i] : k].lower().strip()
        return self.running[i] + (self._counts(rest)[-1] if rest else 0)

    def _tokens(self, rest: str) -> int:
        if any(o in rest for o in self.encoder.openings):
            return len(self.encoder.whole(rest))
        return sum(PrefixCounts(self.encoder.merges).extend(p).ended[-1] for p in self.encoder.split(rest))

    def _counts(self, piece: str, most: int | None = None) -> list[int]:
        """Counts of a piece's prefixes by characters; a cut contraction falls apart into other pieces. With
        `most`, prefixes that must hold more tokens are left out."""
        if piece[:2] in ("'r", "'v", "'l"):
            return [sum(prefix_counts(p, self.encoder.merges)[-1] for p in PIECE.findall(piece[:j])) for j in range(1, len(piece) + 1)]
        return self._by_characters([c.encode() for c in (piece if most is None else piece[: (most + 1) * self.encoder.merges.rules.longest_token])])

    def _by_characters(self, characters: list[bytes]) -> list[int]:
        counts = PrefixCounts(self.encoder.merges).extend(b"".join(characters)).ended
        return [counts[e] for e in (np.cumsum([len(c) for c in characters]) - 1).tolist()]

    def fits(self, budget: int) -> int:
        """The largest k with at most `budget` tokens in text[:k]."""
        n = len(self.text)
        if self.running[-1] <= budget:
            return n
        i = bisect_right(self.running, budget) - 1
        left = budget - self.running[i]
        if not self.plain:
            while i and self.ends[i] == self.ends[i + 1]:  # one character may become several pieces
                i -= 1
            return self._fits_in_piece(i, budget)
        rest = self.text[self.ends[i] : self.ends[i + 1]].lower()
        piece = rest.lstrip()
        start = self.ends[i + 1] - len(piece)
        return start + max((j for j, c in enumerate(self._counts(piece, left), 1) if c <= left), default=0)

    def _fits_in_piece(self, i: int, budget: int) -> int:
        """The longest prefix that ends within the piece after the i-th end, of a text that the library split.

        A prefix of more bytes than (tokens left + 1) times the longest token cannot fit. A piece
        whose characters normalise each on their own is one run of the programme; others
        (composed characters, special strings, contractions) are looked at cut by cut.
        """
        start, end, left = self.ends[i], self.ends[i + 1], budget - self.running[i]
        piece = self.text[start:end]
        bare = piece.lstrip()
        some = bare[: (left + 1) * self.encoder.merges.rules.longest_token]
        whole = self.encoder.tokenizer.normalizer.normalize_str(some)
        characters = [self.encoder.tokenizer.normalizer.normalize_str(c) for c in some]
        alone = "".join(characters) == whole and not any(o in some for o in self.encoder.openings) and not self.special[i + 1]
        if alone and some and not whole.startswith("'") and len(self.encoder.split(some)) == 1:
            counts = self._by_characters([c.encode() for c in characters])
            return end - len(bare) + max((j for j, c in enumerate(counts, 1) if c <= left), default=0)
        high = min(end, start + len(piece) - len(bare) + len(some))
        return next((k for k in range(high, start, -1) if self.at(k) <= budget), start)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_pieces, fit_chars): fit_chars is the length of the longest
    prefix with at most `limit` tokens. One map over the input, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in batches:
            for a, b in text_chunks(batch.column(1), CHUNK):
                part = batch.slice(a, b - a)
                column = part.column(1).fill_null("")
                texts = column.to_pylist()
                counts = encoder.counts(texts)
                tokens = [len(encoder.whole(t)) if c is None else int(c.sum()) for t, c in zip(texts, counts)]
                fit = [len(t) if n <= limit else PrefixTable(t, encoder, c).fits(limit) for t, n, c in zip(texts, tokens, counts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pc.binary_length(column).cast(pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                        pa.array([None if c is None else len(c) for c in counts], pa.int64()),
                        pa.array(fit, pa.int64()),
                    ],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_pieces", "fit_chars"],
                )

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, n_pieces long, fit_chars long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ends, counts): for each text the piece ends (code points) and the token count up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in batches:
            for a, b in text_chunks(batch.column(1), CHUNK):
                part = batch.slice(a, b - a)
                texts = part.column(1).fill_null("").to_pylist()
                tables = [PrefixTable(t, encoder, c) for t, c in zip(texts, encoder.counts(texts))]
                ends = [t.ends[1:] for t in tables]
                counts = [t.running[1:] for t in tables]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=[id_col, "ends", "counts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ends array<int>, counts array<int>")


def truncate(docs: DataFrame, tokenizer: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts cut to their longest prefix of at most `budget` tokens; all columns stay."""
    kept = [f for f in docs.columns if f != text_col]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        for batch in batches:
            for a, b in text_chunks(batch.column(at), CHUNK):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                cut = []
                for t, c in zip(texts, encoder.counts([t or "" for t in texts])):
                    table = None if t is None else PrefixTable(t, encoder, c)
                    cut.append(None if t is None else t[: table.fits(budget)])
                yield part.set_column(at, text_col, pa.array(cut, pa.string()))

    assert kept or text_col in docs.columns
    return docs.mapInArrow(run, docs.schema)


def totals(counted: DataFrame) -> DataFrame:
    """Token and byte totals of a counted table."""
    return counted.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), F.count_if("over_limit").alias("n_over"))
