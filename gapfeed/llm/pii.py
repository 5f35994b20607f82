"""Personal data by weak supervision.

* Candidates: the base patterns (e-mail, IP address, card, phone), whose valid
  matches always stay, their failing matches, and looser patterns (spelled-out
  e-mail, national phone number, identity number, bank account, credentials).
* Labelers: regex labelers judge a candidate's form (its strict pattern, checksum, length, range), gazetteer
  labelers look for listed endings, prefixes and cue words, context labelers at the words
  around it. Each votes yes (1), no (2) or abstains (0).
* Label model: expectation-maximisation over the counts of vote patterns of all
  candidates estimates, for each kind's prior and each labeler, how often it
  votes so on personal and on other spans.
* Span classifier: logistic regression on form and context features, trained on
  the label model's probabilities of a bounded sample of candidates
  (`fit_spans`, those of the least hash), decides on every candidate that no base span covers.

Offsets are code points, ends exclusive. Null texts are empty and have no
spans; texts of any length are searched whole, each pattern in linear time.
Repeated rows yield repeated rows. An empty table yields no rows, and its
model accepts nothing. Columns other than id and text pass through `mask`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._common import materialize, ship, text_chunks

#: Base kinds in the contract's order, then those the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id_number", "account", "secret")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Looser patterns of the method, by kind.
_SPELLED = re.compile(r"(?<![\w.])[A-Za-z0-9_.+-]{1,64} ?[(\[{]? ?(?:at|AT) ?[)\]}]? ?[A-Za-z0-9-]{1,63}(?: ?[(\[{]? ?(?:dot|DOT) ?[)\]}]? ?[A-Za-z0-9-]{1,63}){1,4}(?!\w)")
_SPELLED_HINT = re.compile(r"\b(?:dot|DOT)\b")
_NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|0?[0-9]{2,5}[ /-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![\w-])")
_ID_NUMBER = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b)[\"']? ?[:=]+ ?[\"']?([^\s\"']{6,})|(?<![A-Za-z0-9])(AKIA[A-Z0-9]{16})(?![A-Za-z0-9])|(?<![A-Za-z0-9])(gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9])")
_SECRET_HINT = re.compile(r"(?i:passw|pwd|token|secret|key)|AKIA|gh[opsu]_")

#: Gazetteers: endings of host names, and cue words of each kind.
ENDINGS = frozenset("com org net edu gov io co info biz de fr es uk eu us ca it nl ch at be pl se ru jp cn br".split())
CUES = {
    "email": "mail e-mail email contact write address courriel correo".split(),
    "ip": "ip host server address addr node client login".split(),
    "card": "card visa mastercard credit debit payment karte carte tarjeta".split(),
    "phone": "phone tel telephone call fax mobile cell telefon téléphone teléfono".split(),
    "id_number": "ssn social security id identity".split(),
    "account": "iban account konto compte cuenta bank".split(),
    "secret": "password passwd pwd token secret key apikey api_key access".split(),
}
AGAINST = frozenset("version v section chapter license licence page release figure table no art line".split())
LABELERS = ("form", "checksum", "length", "gazetteer", "cue", "against", "isolated")
FEATURES = len(KINDS) + 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each "@" takes the run before it, up to the last match; without a domain it is no match."""
    done = 0
    for m in _DOMAIN.finditer(text):
        at, step, start = m.start(), 64, m.start()
        while start > done:
            low = max(done, start - step)
            left = len(text[low:start].rstrip(_LOCAL))
            start = low + left
            if left:
                break
            step *= 4
        if start < at:
            yield start, m.end()
            done = m.end()


def base_matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, valid) of the base patterns' matches, kind by kind."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            yield "ip", m.start(), m.end(), all(len(p) < 4 and int(p or "0") <= 255 for p in parts)
        for m in _CARD.finditer(text):
            n = m.end() - m.start()
            if n >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                yield "card", m.start(), m.end(), 12 <= len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = sum(c in "0123456789" for c in m[0])
                yield "phone", m.start(), m.end(), 9 <= n <= 15


def loose_matches(text: str) -> Iterator[tuple[str, int, int]]:
    if _SPELLED_HINT.search(text):
        for m in _SPELLED.finditer(text):
            yield "email", m.start(), m.end()
    if _DIGIT.search(text):
        for m in _NATIONAL.finditer(text):
            yield "phone", m.start(), m.end()
        for m in _ID_NUMBER.finditer(text):
            yield "id_number", m.start(), m.end()
        for m in _ACCOUNT.finditer(text):
            yield "account", m.start(), m.end()
    if _SECRET_HINT.search(text):
        for m in _SECRET.finditer(text):
            g = next(i for i in (1, 2, 3) if m[i])
            yield "secret", m.start(g), m.end(g)


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _words_around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, a - 48) : a].lower())[-4:]
    after = re.findall(r"[^\W\d_][\w-]*", text[b : b + 32].lower())[:2]
    return before, after


def votes(kind: str, text: str, a: int, b: int, valid: bool | None) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1 yes, 2 no, 0 abstains. valid: of a base pattern's match."""
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    before, after = _words_around(text, a, b)
    form = 0 if valid is None else 1 if valid else 2
    checksum = 0
    if kind == "card":
        checksum = 1 if luhn(re.sub(r"\D", "", s)) else 2
    elif kind == "account":
        checksum = 1 if _iban(s) else 2
    elif kind == "ip":
        checksum = 1 if valid else 2
    elif kind == "id_number":
        checksum = 2 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    elif kind == "secret":
        rest = s.lower()
        checksum = 1 if digits and any(c.isalpha() for c in rest) and len(set(rest)) >= min(8, len(rest) // 2) else 2
    bounds = {"email": (6, 80), "ip": (7, 15), "card": (12, 24), "phone": (9, 24), "id_number": (11, 11), "account": (15, 42), "secret": (8, 80)}[kind]
    length = 1 if bounds[0] <= b - a <= bounds[1] else 2
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", s.rstrip(" )]}"))[-1].lower() in ENDINGS else 2
    elif kind == "secret":
        gazetteer = 1 if s.startswith(("AKIA", "gh")) or re.fullmatch(r"[0-9a-fA-F]{16,}", s) else 0
    cue = 1 if any(w in CUES[kind] for w in before) else 0
    against = 2 if before[-1:] and before[-1] in AGAINST or (kind != "secret" and b < len(text) and text[b] in "%€$£") else 0
    isolated = 2 if (a and (text[a - 1].isalnum() or text[a - 1] in "/#_=")) and kind != "secret" or (b < len(text) and (text[b].isalnum() or text[b] in "/_")) else 1
    return form, checksum, length, gazetteer, cue, against, isolated


def features(kind: str, text: str, a: int, b: int) -> list[float]:
    """Form and context of a span as numbers."""
    s = text[a:b]
    n = max(1, b - a)
    before, after = _words_around(text, a, b)
    digits = sum(c.isdigit() for c in s)
    return [
        *(1.0 if kind == k else 0.0 for k in KINDS),
        math.log(n) / 4,
        digits / n,
        sum(c.isalpha() for c in s) / n,
        sum(c.isupper() for c in s) / n,
        len(set(s)) / n,
        1.0 if "@" in s else 0.0,
        1.0 if kind in ("card",) and luhn(re.sub(r"\D", "", s) or "1") else 0.0,
        1.0 if any(w in CUES[kind] for w in before) else 0.0,
        1.0 if before[-1:] and before[-1] in AGAINST else 0.0,
        1.0 if a and text[a - 1].isalnum() else 0.0,
        1.0 if b < len(text) and text[b].isalnum() else 0.0,
        1.0 if any(w in CUES[kind] for w in after) else 0.0,
    ]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, bool | None]]]:
    """The base spans, and all candidates: (kind, start, end, valid; None for the loose patterns)."""
    base, found = [], []
    for kind, a, b, valid in base_matches(text):
        if valid:
            base.append((kind, a, b))
        found.append((kind, a, b, valid))
    covered = _union(base)
    seen = {(k, a, b) for k, a, b, _ in found}
    for kind, a, b in loose_matches(text):
        if (kind, a, b) not in seen and any(kind != "secret" or y - x >= 6 for x, y in _added(kind, a, b, covered)):
            found.append((kind, a, b, None))
    base.sort(key=lambda x: (x[1], BASE.index(x[0])))
    return base, found


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what spans cover, in order and apart."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _added(kind: str, a: int, b: int, covered: tuple[list[int], list[int]]) -> list[tuple[int, int]]:
    """What of a candidate is added to the base spans: all of it if it overlaps none; of a secret the parts beside them."""
    starts, ends = covered
    i = bisect_right(ends, a)  # the first that ends behind a
    if kind != "secret":
        return [] if i < len(starts) and starts[i] < b else [(a, b)]
    out = []
    while i < len(starts) and starts[i] < b:
        if a < starts[i]:
            out.append((a, starts[i]))
        a = max(a, ends[i])
        i += 1
    return out + [(a, b)] if a < b else out


@dataclass
class SpanModel:
    """Label model (prior of each kind, vote rates of each labeler) and span classifier."""

    prior: dict[str, float] = field(default_factory=dict)
    rates: np.ndarray = field(default_factory=lambda: np.full((2, len(LABELERS), 3), 1 / 3))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    threshold: float = 0.5

    def probability(self, kind: str, text: str, a: int, b: int) -> float:
        z = float(self.weights[:-1] @ np.array(features(kind, text, a, b)) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and those of the method besides (none overlaps a base span)."""
        base, found = candidates(text)
        covered = _union(base)
        more = [(k, x, y) for k, a, b, valid in found if not valid and self.weights.any() and (parts := _added(k, a, b, covered)) and self.probability(k, text, a, b) >= self.threshold for x, y in parts]
        return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def expectation_maximisation(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From vote patterns with counts: prior of each kind, vote rates, and each pattern's probability of being personal data.

    Labelers are taken as independent given the class. The start is a majority
    vote; a little is added to all counts, so that no rate is 0.
    """
    yes, no = (patterns == 1).sum(axis=1), (patterns == 2).sum(axis=1)
    q = np.clip((yes + 0.5) / (yes + no + 1.0), 0.05, 0.95)
    number = int(kinds.max()) + 1 if len(kinds) else 0
    for _ in range(rounds):
        w = np.stack([counts * (1 - q), counts * q])
        rates = np.full((2, patterns.shape[1], 3), 0.5)
        for v in range(3):
            rates[:, :, v] += w @ (patterns == v)
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (np.bincount(kinds, weights=w[1], minlength=number) + 1) / (np.bincount(kinds, weights=counts, minlength=number) + 2)
        logs = np.log(rates)
        odds = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(patterns.shape[1]):
            odds = odds + logs[1, j, patterns[:, j]] - logs[0, j, patterns[:, j]]
        q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, rates, q


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, penalty: float = 1e-3) -> np.ndarray:
    """Weights (last: constant) of a logistic regression on probabilities y, by gradient descent."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * (x.T @ (p - y) / max(1, len(x)) + penalty * w)
    return w


_FOUND = "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, kinds array<int>, starts array<int>, ends array<int>, valid array<int>, votes array<int>, features array<array<float>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: base counts and spans, and its candidates with votes and features."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in text_chunks(batch.column(1)):
                part = batch.slice(x, y - x)
                rows: list[list] = [[] for _ in range(12)]
                for text in part.column(1).fill_null("").to_pylist():
                    base, found = candidates(text)
                    said = joined(base)
                    per = [votes(k, text, a, b, v) for k, a, b, v in found]
                    for column, value in zip(
                        rows,
                        (
                            *(sum(k == kind for k, _, _ in base) for kind in BASE),
                            hashlib.sha256(said.encode()).hexdigest(),
                            said,
                            [KINDS.index(k) for k, *_ in found],
                            [a for _, a, _, _ in found],
                            [b for _, _, b, _ in found],
                            [-1 if v is None else int(v) for *_, v in found],
                            [sum(v * 3**i for i, v in enumerate(p)) for p in per],
                            [features(k, text, a, b) for k, a, b, _ in found],
                        ),
                    ):
                        column.append(value)
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 5 + [pa.list_(pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, t) for r, t in zip(rows, types))], names=["key", *(f.split()[0] for f in _FOUND.split(", ")[1:])])

    return docs.select(id_col, text_col).mapInArrow(run, _FOUND.replace("key long", f"key {docs.schema[id_col].dataType.simpleString()}", 1))


def fit(found: DataFrame, fit_spans: int = 20_000, threshold: float = 0.5) -> SpanModel:
    """Label model from the vote patterns of all candidates, classifier from a sample of at most `fit_spans`.

    Patterns are counted on the executors; at most kinds * 3^labelers counts come to the driver.
    """
    each = found.select("key", F.explode(F.arrays_zip("kinds", "votes", "features", "starts")).alias("c")).select("key", "c.*")
    counted = each.groupBy("kinds", "votes").count().collect()
    if not counted:
        return SpanModel()
    kinds = np.array([r[0] for r in counted])
    patterns = np.array([[r[1] // 3**i % 3 for i in range(len(LABELERS))] for r in counted])
    prior, rates, q = expectation_maximisation(kinds, patterns, np.array([float(r[2]) for r in counted]))
    believed = {(r[0], r[1]): p for r, p in zip(counted, q)}
    sample = each.orderBy(F.xxhash64("key", "starts", "kinds"), "key", "starts").limit(fit_spans).select("kinds", "votes", "features").collect()
    x = np.array([r[2] for r in sample], dtype=np.float64)
    y = np.array([believed[(r[0], r[1])] for r in sample])
    return SpanModel({KINDS[k]: float(p) for k, p in enumerate(prior)}, rates, logistic(x, y), threshold)


def detect(docs: DataFrame, fit_spans: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every document."""
    found = materialize(find(docs, id_col, text_col), "pii")
    model = fit(found, fit_spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, added = [], []
            for base, kinds, starts, ends, valid, feats in zip(*(batch.column(i).to_pylist() for i in (6, 7, 8, 9, 10, 12))):
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                covered = _union(spans)
                more = []
                if any(v != 1 for v in valid) and model.weights.any():
                    p = 1 / (1 + np.exp(-np.clip(np.array(feats) @ model.weights[:-1] + model.weights[-1], -50, 50)))
                    more = [(KINDS[k], *part) for k, a, b, v, x in zip(kinds, starts, ends, valid, p) if v != 1 and x >= model.threshold for part in _added(KINDS[k], a, b, covered)]
                said.append(joined(spans + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(said, pa.string()), pa.array(added, pa.int64())], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return found.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, fit_spans: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with each span's text replaced by its kind in brackets; nulls stay null, all columns stay."""
    model = fit(materialize(find(docs, id_col, text_col), "pii"), fit_spans)

    @F.arrow_udf("string")
    def hidden(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else masked(t, [s for some in model.spans(t) for s in some]) for t in batch.to_pylist()], pa.string())

    return docs.withColumn(text_col, hidden(F.col(text_col)))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans are masked as one, by the name of the first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if spans else text
