"""Language identification by interpolated Kneser-Ney character models.

* Characters: every letter of the training documents (case folded) is a class of
  its own, whatever its script; letters they don't have share one class, and
  anything that isn't a letter is one separator.
* Model: for each language an interpolated Kneser-Ney model of one order, from
  counts of all n-grams of the training documents. The model of all languages
  is kept as sorted arrays: hashes of the n-grams seen in any language, and a
  column of log probabilities for each language; one such pair of arrays for
  each order, so that an unseen n-gram is looked up with its shorter suffix.
* Decision: the language of the lowest cross-entropy per character. The score
  is the posterior of a softmax over length-normalised log likelihoods, its
  scale fitted on training documents. A document is rejected if it has no
  letters, or if its cross-entropy is beyond what its language's training
  documents show (mean plus `reject_sds` deviations, widened for short texts)
  and nearer to that of equally likely characters, so that a document in two
  languages, or with a foreign passage, stays.

The fit reads at most about `fit_docs` training documents of each language
(chosen by a hash of id and text; the bound is a parameter); every document's
whole text is scored, in slices, so that memory doesn't follow its length. Null
texts and texts without letters are `und` with score 0. Without any training
document all are `und`. Ties go to the language first in code point order.
Repeated rows are scored each, and alike. Only text is read to predict; other
columns of any name pass through.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import text_chunks
from gapfeed.llm._hashing import mix

ORDER = 4
#: Bits of a character class: 0 is the separator, then the alphabet by frequency, then all other letters as one.
BITS = 15
LETTERS = (1 << BITS) - 2
UNKNOWN = "und"
#: Texts are scored in slices of so many characters, and kept together up to as many bytes.
SLICE = 1 << 18
#: Bytes of a task's cache of n-grams looked up before.
CACHE_BYTES = 16 << 20
JUDGED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def letters_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)], dtype=bool)


def alphabet_table(alphabet: list[str], letters: np.ndarray) -> np.ndarray:
    """The class of each code point; letters outside the alphabet are class len(alphabet) + 1."""
    table = np.where(letters, np.uint16(len(alphabet) + 1), np.uint16(0))
    for i, c in enumerate(alphabet):
        for form in {c, c.upper(), c.lower()}:
            if len(form) == 1:
                table[ord(form)] = i + 1
    return table


def grams(text: str, table: np.ndarray, size: int = SLICE) -> Iterator[np.ndarray]:
    """Slice by slice the codes of the n-grams that end at each character of a text between separators (runs of
    separators as one; the n-grams before the start are padded with separators)."""
    tail = np.zeros(ORDER, dtype=np.uint16)
    for at in range(0, len(text), size):
        c = table[np.frombuffer(text[at : at + size].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + size >= len(text):
            c = np.append(c, np.uint16(0))
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        keep[0] |= tail[-1] != 0
        padded = np.concatenate([tail, c[keep]]).astype(np.int64)
        out = np.zeros(len(padded) - ORDER, dtype=np.int64)
        for i in range(1, ORDER + 1):
            out = (out << BITS) | padded[i : i + len(out)]
        tail = padded[-ORDER:].astype(np.uint16)
        yield out


def low(codes: np.ndarray, n: int) -> np.ndarray:
    """The codes' last n characters."""
    return codes & ((1 << BITS * n) - 1)


@dataclass
class Model:
    """Sorted hash arrays of each order, their log probabilities by language, and the calibration."""

    languages: list[str]
    alphabet: list[str]
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    #: Different characters of each language's training documents.
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reject_sds: float = 12.0

    @property
    def symbols(self) -> int:
        return len(self.alphabet) + 2

    def limit(self, language: int, characters: int) -> float:
        """The cross-entropy beyond which a text isn't taken for the language."""
        mean, spread = self.mean[language], self.spread[language]
        even = math.log(max(64, self.kinds[language]))
        return max(mean + self.reject_sds * spread * (1 + 5 / math.sqrt(max(1, characters))), mean + 0.6 * (even - mean))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each n-gram's last character, a column for each language."""
        out = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(codes))
        for n in range(len(self.keys), 0, -1):
            code = low(codes[todo], n)
            at, hit = _find(self.keys[n - 1], code)
            out[todo[hit]] += self.logs[n - 1][at[hit]]
            todo, code = todo[~hit], code[~hit]
            at, known = _find(self.contexts[n - 1], code >> BITS)
            out[todo[known]] += self.backoffs[n - 1][at[known]]
        out[todo] -= math.log(self.symbols)
        return out


def _find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of codes in a sorted array of their hashes, and whether they are there."""
    h = mix(codes.astype(np.uint64))
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def train(counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: list[str], discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney for each language from its counts of n-grams of the highest order (codes in order, counts)."""
    languages = sorted(counts)
    size = len(alphabet) + 2
    keys: list[np.ndarray] = []
    columns: list[list[np.ndarray]] = []
    contexts: list[np.ndarray] = []
    backoffs: list[np.ndarray] = []
    tables = {g: (np.asarray(c[0], dtype=np.int64), np.asarray(c[1], dtype=np.float64)) for g, c in counts.items()}
    top = [np.unique(low(np.concatenate([tables[g][0] for g in languages]), n)) for n in range(1, ORDER + 1)]
    below_of = {g: np.full(1, 1.0 / size) for g in languages}
    for n in range(1, ORDER + 1):
        seen = top[n - 1]
        columns.append([])
        weights = []
        for g in languages:
            codes, freq = tables[g]
            if n == ORDER:
                own, weight = codes, freq
            else:  # continuation counts: how many different n-grams one longer end so
                own, weight = np.unique(low(np.unique(low(codes, n + 1)), n), return_counts=True)
                weight = weight.astype(np.float64)
            context, inverse = np.unique(own >> BITS, return_inverse=True)
            total = np.bincount(inverse, weights=weight)
            kinds = np.bincount(inverse).astype(np.float64)
            # of every n-gram seen in any language: its own discounted share and the weight of the shorter one
            at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
            mine = np.where(own[at] == seen, weight[at], 0.0)
            ctx = np.minimum(np.searchsorted(context, seen >> BITS), len(context) - 1)
            known = context[ctx] == seen >> BITS
            below = below_of[g][np.searchsorted(top[n - 2], low(seen, n - 1))] if n > 1 else np.full(len(seen), 1.0 / size)
            columns[-1].append(np.where(known, np.maximum(mine - discount, 0) / total[ctx] + discount * kinds[ctx] / total[ctx] * below, below))
            weights.append((context, discount * kinds / total))
        below_of = dict(zip(languages, columns[-1]))
        # the weight of the shorter n-gram behind each context; 1 where a language doesn't know it
        every = np.unique(np.concatenate([c for c, _ in weights]))
        shares = np.ones((len(every), len(languages)))
        for i, (context, share) in enumerate(weights):
            shares[np.searchsorted(every, context), i] = share
        for hashes, of, values, into in ((contexts, every, np.log(shares), backoffs), (keys, seen, np.log(np.stack(columns[-1], axis=1)), None)):
            h = mix(of.astype(np.uint64))
            order = np.argsort(h)
            hashes.append(h[order])
            if into is None:
                columns[-1] = values[order].astype(np.float32)
            else:
                into.append(values[order].astype(np.float32))
    return Model(languages, alphabet, keys, columns, contexts, backoffs, np.array([len(np.unique(low(tables[g][0], 1))) for g in languages]))


class Scorer:
    """Cross-entropies under a model; n-grams looked up before come from a cache with a place for each hash prefix."""

    def __init__(self, model: Model, table: np.ndarray):
        self.model, self.table = model, table
        width = len(model.languages)
        self.bits = max(8, min(18, int(math.log2(CACHE_BYTES / (8 + 4 * width)))))
        self.codes = np.full(1 << self.bits, -1, dtype=np.int64)
        self.logs = np.zeros((1 << self.bits, width), dtype=np.float32)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        place = (mix(codes.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.logs[place]
        missed = np.flatnonzero(self.codes[place] != codes)
        if len(missed):
            new, inverse = np.unique(codes[missed], return_inverse=True)
            found = self.model.log_probabilities(new)
            out[missed] = found[inverse]
            at = place[missed]
            self.codes[at] = codes[missed]
            self.logs[at] = found[inverse]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text under each language, and the number of characters scored
        (0: no letters)."""
        sums = np.zeros((len(texts), len(self.model.languages)))
        sizes = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def score():
            of = np.array([i for i, _ in held])
            lengths = np.array([len(c) for _, c in held])
            found = np.add.reduceat(self.rows(np.concatenate([c for _, c in held])), np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
            np.add.at(sums, of, found)
            np.add.at(sizes, of, lengths)

        for i, t in enumerate(texts):
            for codes in grams(t, self.table) if t else ():
                if len(codes):
                    held.append((i, codes))
                    waiting += len(codes)
                if waiting >= SLICE:
                    score()
                    held, waiting = [], 0
        if held:
            score()
        return -sums / np.maximum(sizes, 1)[:, None], sizes


def held_out(id_col: str) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1 (null ids: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject_sds: float = 12.0) -> Model | None:
    """A model from the training documents; None if there are none."""
    usable = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit("language fit")).alias("h"))
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    space = 1 << 30
    bound = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(space, int(space * fit_docs / n) + 1)))])
    sample = usable.where(F.pmod("h", F.lit(space)) < F.element_at(bound, F.col("lang"))).select("lang", "text")
    letters = letters_table()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch.column(0), SLICE):
                text = "".join(batch.column(0).slice(a, b - a).to_pylist()).lower()
                code, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
                some = letters[code]
                yield pa.RecordBatch.from_arrays([pa.array(code[some], pa.int64()), pa.array(n[some], pa.int64())], names=["c", "n"])

    top = sample.select("text").mapInArrow(spell, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(LETTERS).collect()
    alphabet = [chr(r[0]) for r in top]
    if not alphabet:
        return None
    table = alphabet_table(alphabet, letters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            texts = batch.column(1).to_pylist()
            for g in sorted(set(langs)):
                found = [c for t, x in zip(texts, langs) if x == g for c in grams(t, table)]
                codes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["lang", "g", "n"])

    counted = sample.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).orderBy("lang", "g").toPandas()
    if counted.empty:
        return None
    model = train({g: (p["g"].to_numpy(), p["n"].to_numpy()) for g, p in counted.groupby("lang")}, alphabet)
    model.reject_sds = reject_sds

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, table)
        at = {g: i for i, g in enumerate(model.languages)}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h, n = scorer.entropies(texts)
            own = np.array([at.get(g, 0) for g in langs], dtype=np.int64)
            mine = h[np.arange(len(own)), own]
            h[np.arange(len(own)), own] = np.inf
            other = h.min(axis=1) if len(model.languages) > 1 else mine + 1
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(mine), pa.array(other - mine), pa.array(n)], names=["lang", "h", "gap", "n"])

    # calibration: the spread of the training documents' cross-entropies, and the scale of the posterior
    found = sample.mapInArrow(measure, "lang string, h double, gap double, n long").where("n >= 20")
    stats = {r[0]: r for r in found.groupBy("lang").agg(F.avg("h"), F.stddev_pop("h"), F.avg("gap")).collect()}
    model.mean = np.array([stats[g][1] if g in stats else 0.0 for g in model.languages])
    model.spread = np.array([max(stats[g][2], 0.02) if g in stats else np.inf for g in model.languages])
    gaps = [r[3] for r in stats.values() if r[3] and r[3] > 0]
    # an average document of a language scores about 0.98 against its nearest rival
    model.scale = 4.0 / max(0.02, sum(gaps) / len(gaps)) if gaps else 4.0
    return model


def judge(model: Model | None, text: Column) -> Column:
    """A struct of the columns `JUDGED` for each text. Only texts go to Python, and only this comes back."""
    table = None if model is None else alphabet_table(model.alphabet, letters_table())

    @F.arrow_udf(f"struct<{JUDGED.replace(' ', ':').replace(',:', ', ')}>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None if model is None else Scorer(model, table)
        for batch in batches:
            parts = [_judged(batch.slice(a, b - a), model, scorer) for a, b in text_chunks(batch, SLICE)]
            yield pa.concat_arrays(parts) if parts else _judged(batch, model, None)

    return judged(text)


def _judged(texts: pa.Array, model: Model | None, scorer: Scorer | None) -> pa.StructArray:
    pred, score, ce, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts), [True] * len(texts)
    if scorer is not None:
        h, n = scorer.entropies(texts.fill_null("").to_pylist())
        top = 1.0 / np.exp(-(h - h.min(axis=1, keepdims=True)) * model.scale).sum(axis=1)
        for i, g in enumerate(h.argmin(axis=1).tolist()):
            if n[i]:
                pred[i], score[i], ce[i] = model.languages[g], top[i], float(h[i, g])
                rejected[i] = bool(h[i, g] > model.limit(g, int(n[i])))
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_())], names=[c.split()[0] for c in JUDGED.split(", ")])


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred, score, cross_entropy and rejected. One map, no shuffle."""
    kept = docs.select(F.struct(*keep).alias("row"), judge(model, F.col(text_col)).alias("said"))
    return kept.select("row.*", "said.*")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected, held_out) of every document."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    return predict(docs, model, keep=[id_col], text_col=text_col).withColumn("held_out", held_out(id_col))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Documents that aren't rejected, with all their columns."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    return docs.where(~judge(model, F.col(text_col))["rejected"])
