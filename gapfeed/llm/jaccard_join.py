"""Exact n-gram Jaccard join: universe partition and pigeonhole.

The universe of shingle hashes is cut into segments; how many depends on a
band of set sizes. Two sets of a band that reach the similarity differ in at
most H shingles, so among enough segments one must agree (or differ by one,
where a segment is indexed with its one-deletion neighbourhood). Sets that
share a key are candidates and are verified on their whole sets.

* Bands: sizes l..floor(l / s^2). A pair meets in the band of its larger set, so
  a set is indexed in its own band and, if a partner may be there, in the next.
* Pigeonhole: in the order of segments a set indexes those that aren't empty
  until they weigh H + 1, H being what it may differ by from its largest partner
  in the band. A segment weighs 1; one of two or more shingles weighs 2 where it
  is indexed with its neighbourhood. Of two linked sets take the one whose
  segments end first: if no key were shared, the sets would differ by more than
  H within them, and the other indexes those too. The few sets with too little
  weight in all segments index the empty ones as well.
* Shingles that many texts have (passages, page frames) are cut into segments of their
  own, which come last, so that sets hardly index them: what many have in common makes
  few keys. Pigeonhole holds for any partition and order, so which shingles these
  are, found in a bounded sample of classes, cannot change results.
* Cost-based allocation: how many segments have neighbourhoods is chosen for each
  band by the number of sets in it, weighing keys to shuffle against false candidates.
* Equal sets are one class; keys carry the class. Within a key, members are
  compared with a leader and the member before (in each batch, then over all),
  not with each other. Where that leaves a key's members in several components,
  those outside the key's largest component are compared with all its members,
  after size and parity-sketch bounds; pairs within a component need no
  comparison. Such keys are split by size and salted, so that none is one task.
* Keys of more than FEW members are refined before: pigeonhole again, over single
  shingles in one order for all, those that fewest of these members have first.
  Two linked sets share a shingle, and before the first one they share each has
  no more shingles than it may have alone; so each member indexes only so many,
  and what many members have in common comes last and is rarely indexed.

Components are exact; links within a component are verified only as far as they
connect it. Sets are compared by 64-bit hashes of their shingles; classes by a
64-bit hash of the set.

Nulls and texts without words have empty sets and link with nothing. Repeated
rows link with each other. Null ids take part; an id of a component is the
smallest id that isn't null (null if all are). Ties cannot change results. Very
long texts are sets like others; an empty table yields no rows. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.llm._common import drop_ids, sized_broadcast, text_chunks, utf8
from gapfeed.llm._hashing import mix, shingle_sets
from gapfeed.llm.components import components
from gapfeed.shipping import Scratch, materialize

#: Parity sketches of a set: differing bits never exceed differing shingles. All sets have one of 4 longs, those of
#: pairs that it leaves a wide one, which tells larger sets apart.
SKETCH, WIDE = 256, 4096
SKETCHES = [f"s{i}" for i in range(SKETCH // 64)]
#: Costs of one indexed key, and of one false candidate, and the chance that a shingle of one set is in an unrelated one.
KEY_COST, PAIR_COST, SHARED = 1.0, 5.0, 1e-5
#: A band's largest size is its smallest by the similarity to this power.
BAND_POWER = 2
#: Members of one key that one task compares with all others of the key and of like size.
SALT_ROWS = 2000
#: Members of a key that are compared as they are; keys of more are refined by the rare shingles of their members.
FEW = 32
#: Classes, about, in whose texts common shingles are counted, the tasks that count, how many of the classes have a common
#: shingle at least, and the most common shingles that are kept apart (8 bytes each in every task).
FIT_CLASSES, FIT_TASKS, LEAST, MOST = 16_000, 8, 8, 200_000
#: Bytes of text that are hashed at once (a longer text is its own chunk): hashing takes some 60 times as many.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Similarity:
    """A Jaccard threshold as a fraction, so that bounds are exact: num / den."""

    num: int
    den: int

    def largest(self, n: int) -> int:
        """The largest set that a set of n shingles can reach the threshold with."""
        return n * self.den // self.num

    def differ(self, total: int) -> int:
        """The most shingles by which two sets of `total` shingles together may differ."""
        return (self.den - self.num) * total // (self.den + self.num)


@dataclass(frozen=True)
class Band:
    """Segments of a band of sizes: `deletions` with one-deletion neighbourhoods come first, then exact ones."""

    number: int
    low: int
    high: int
    segments: int
    deletions: int

    def weight(self, n: int, similarity: Similarity) -> int:
        """What the segments that a set of n shingles indexes must weigh: one more than it may differ by from a partner here."""
        return similarity.differ(n + min(self.high, similarity.largest(n))) + 1


def bands(similarity: Similarity, largest: int) -> list[tuple[int, int]]:
    """Size bands up to the one that holds `largest`, and the next."""
    out, low = [], 1
    while True:
        high = low
        for _ in range(BAND_POWER):
            high = max(high, similarity.largest(high))
        out.append((low, high))
        if low > largest:
            return out
        low = high + 1


def allocate(number: int, low: int, high: int, similarity: Similarity, sets: int) -> Band:
    """The cheapest allocation of neighbourhood and exact segments for a band that holds `sets` sets."""
    smallest = max(1, math.ceil(low * similarity.num / similarity.den))  # sets of the band before come too
    most = similarity.differ(2 * high) + 1
    sizes = sorted({smallest, low, (low + high) // 2, high})
    best = None
    for d in sorted({0, most // 8, most // 4, most // 2}):
        exact = max(1, most - 2 * d)
        while not all(_enough(Band(number, low, high, d + exact, d), n, similarity) for n in sizes) and exact < 4 * most + 64:
            exact = exact * 9 // 8 + 1
        m = d + exact
        size = (low + high) / 2 / m
        needed = most * (low + high) / 2 / high
        false = SHARED * size * math.exp(-size)
        in_exact = max(0.0, needed - 2 * d)
        cost = in_exact * (KEY_COST + sets * false * PAIR_COST) + min(d, needed / 2) * ((1 + size) * KEY_COST + sets * false * SHARED * (1 + size) * PAIR_COST)
        if best is None or cost < best[0]:
            best = (cost, Band(number, low, high, m, d))
    return best[1]


def _enough(band: Band, n: int, similarity: Similarity) -> bool:
    """Whether the segments that a random set of n shingles fills weigh enough, four deviations below the mean."""
    none = math.exp(-n / band.segments)
    one = n / band.segments * none
    exact = band.segments - band.deletions
    mean = exact * (1 - none) + band.deletions * (2 - 2 * none - one)
    return mean - 4 * math.sqrt(exact * none * (1 - none) + band.deletions * (4 * none + one)) >= band.weight(n, similarity) or n <= 2


#: No shingles.
NONE = np.zeros(0, np.uint64)


def _mapper(columns, names):
    return pa.RecordBatch.from_arrays(columns, names=names)


def _class_of(tokens: np.ndarray) -> int:
    return int((mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for a, b in text_chunks(batch.column(1), CHUNK):
            part = batch.slice(a, b - a)
            yield part, shingle_sets(*utf8(part.column(1)), k)


def _parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` places whether an odd number of a set's hashes falls there, packed into longs."""
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def set_sizes(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, cls, sketch): size, class and parity sketch of each document's set; class is null for the empty set."""

    def run(batches):
        for part, sets in _sets(batches, k):
            sketches = np.stack([_parity(s, SKETCH) for s in sets])
            yield _mapper(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()), *(pa.array(sketches[:, i]) for i in range(len(SKETCHES)))],
                ["id", "n", "cls", *SKETCHES],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, cls long, {', '.join(f'{x} long' for x in SKETCHES)}")


def segment_cuts(band: Band) -> np.ndarray:
    """Where the segments of the universe of hashes begin, but for the first."""
    m = band.segments
    return np.array([-(-(i << 64) // m) for i in range(1, m)], dtype=np.uint64)


def segment_keys(tokens: np.ndarray, band: Band, cuts: np.ndarray, similarity: Similarity, common: np.ndarray = NONE) -> np.ndarray:
    """The keys of a set in a band: hashes of the segments it indexes, and of those less one shingle. The shingles in
    `common` (sorted) have segments of their own behind the others."""
    m, d = band.segments, band.deletions
    often = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), dtype=bool)
    rest, last = tokens[~often], tokens[often]
    at = np.concatenate([[0], np.searchsorted(rest, cuts), len(rest) + np.concatenate([[0], np.searchsorted(last, cuts), [len(last)]])])
    tokens = np.concatenate([rest, last])
    sizes = np.diff(at)
    weights = np.minimum(sizes, 1)
    weights[:d] = np.minimum(sizes[:d], 2)
    total = np.cumsum(weights)
    need = band.weight(len(tokens), similarity)
    whole = total[-1] < need
    q = len(sizes) if whole else int(np.searchsorted(total, need)) + 1
    mixed = mix(tokens[: at[q]])
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    sums = run[at[1 : q + 1]] - run[at[:q]]
    salt = mix(np.arange(q, dtype=np.uint64) + np.uint64(band.number << 32))
    keys = mix(sums + salt)
    # of two sets with too little weight some segment before the common ones agrees, be it empty
    keys = keys[(sizes[:q] > 0) | (whole & (np.arange(q) < m))]
    if d:
        segment = np.repeat(np.arange(min(d, q)), sizes[: min(d, q)])
        less = mix(sums[segment] - mixed[: len(segment)] + salt[segment])
        keys = np.concatenate([keys, less if whole else less[sizes[segment] > 1]])
    return np.unique(keys)


def _indexed(docs: DataFrame, plan: dict[int, Band], edges: list[int], similarity: Similarity, bits: int, k: int, id_col: str, text_col: str, common: np.ndarray = NONE) -> DataFrame:
    """(key, leader, member, before): keys of each class, once in a map task; classes that share a key with
    an earlier one of the batch come as its members, each with the member before it, so a key passes few
    leaders on to the shuffle. Keys have `bits` bits: shorter ones take less room, and what collides is only
    one more candidate."""

    def run(batches):
        cuts = {b: segment_cuts(p) for b, p in plan.items()}
        shift = np.uint64(64 - bits)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            key = np.concatenate([x for x, _ in held])
            cls = np.concatenate([x for _, x in held])
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            leader = cls[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            before = np.where(first, cls, np.concatenate([cls[:1], cls[:-1]]))
            keep = first | (cls != before)
            yield _mapper([pa.array(x[keep]) for x in (key.view(np.int64), leader, cls, before)], ["key", "leader", "member", "before"])

        for part, sets in _sets(batches, k):
            for s in sets:
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                own = int(np.searchsorted(edges, len(s), side="right")) - 1
                for b in (own, own + 1):
                    if b in plan and (b == own or similarity.largest(len(s)) >= plan[b].low):
                        found = np.unique(segment_keys(s, plan[b], cuts[b], similarity, common) >> shift)
                        held.append((found, np.full(len(found), c, dtype=np.int64)))
                        size += len(found)
            if size > 400_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return docs.select(id_col, text_col).mapInArrow(run, "key long, leader long, member long, before long")


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key and leader: (key, leader, member, before) with the key's first leader for each
    other one and the leader before it; members pass."""
    last_key, last_leader, last_member = None, None, None
    for batch in batches:
        key, leader, member, before = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        passed = leader != member
        out = [(key[passed], leader[passed], member[passed], before[passed])]
        key, own = key[~passed], leader[~passed]
        if len(key):
            first = np.concatenate([[key[0] != last_key if last_key is not None else True], key[1:] != key[:-1]])
            previous = np.concatenate([[own[0] if last_member is None else last_member], own[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
            to = np.where(at >= 0, own[np.maximum(at, 0)], 0 if last_leader is None else last_leader)
            last_key, last_leader, last_member = key[-1], to[-1], own[-1]
            keep = ~first & (own != previous) & (own != to)
            out.append((key[keep], to[keep], own[keep], previous[keep]))
        yield _mapper([pa.array(np.concatenate([x[i] for x in out])) for i in range(4)], ["key", "leader", "member", "before"])


def _with_class(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(cls, text) of each document that has words."""

    def run(batches):
        for part, sets in _sets(batches, k):
            keep = pa.array([len(s) > 0 for s in sets], pa.bool_())
            yield _mapper([pa.array([_class_of(s) for s in sets if len(s)], pa.int64()), part.column(1).filter(keep)], ["cls", "text"])

    return docs.select(F.lit(0).alias("zero"), text_col).mapInArrow(run, "cls long, text string")


def _wide(texts: DataFrame, k: int) -> DataFrame:
    """(cls, n, wide) of rows (cls, text)."""

    def run(batches):
        for part, sets in _sets(batches, k):
            yield _mapper([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_parity(s, WIDE) for s in sets], pa.list_(pa.int64()))], ["cls", "n", "wide"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, n long, wide array<long>")


def _repeated(texts: DataFrame, k: int) -> DataFrame:
    """(key, often): shingles that several texts of a task have, with their number there. Where texts are long, those
    found once are forgotten now and then."""

    def run(batches):
        key, often = NONE, np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold():
            new, times = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(key, new)
            known = key[np.minimum(at, len(key) - 1)] == new if len(key) else np.zeros(len(new), dtype=bool)
            often[at[known]] += times[known]
            return np.insert(key, at[~known], new[~known]), np.insert(often, at[~known], times[~known])

        for _, sets in _sets(batches, k):
            held.extend(sets)
            if sum(map(len, held)) > 1 << 18:
                key, often = fold()
                held = []
                if len(key) > 1 << 20:
                    key, often = key[often > 1], often[often > 1]
        if held or len(key):
            key, often = fold() if sum(map(len, held)) else (key, often)
            key, often = key[often > 1], often[often > 1]
            for i in range(0, len(key), 1 << 16):
                yield _mapper([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(often[i : i + (1 << 16)])], ["key", "often"])

    return texts.select("cls", "text").mapInArrow(run, "key long, often long")


def _shingles(texts: DataFrame, k: int) -> DataFrame:
    """(key, cls, n) for each shingle of rows (cls, text), n being the set's size. A text whose set isn't its class's
    (another row of the same id) yields nothing."""

    def run(batches):
        for part, sets in _sets(batches, k):
            held = [(c, s) for c, s in zip(part.column(0).to_pylist(), sets) if len(s) and _class_of(s) == c]
            sizes = np.array([len(s) for _, s in held], dtype=np.int64)
            keys = np.concatenate([s for _, s in held]) if held else np.zeros(0, np.uint64)
            columns = [keys.view(np.int64), np.repeat(np.array([c for c, _ in held], dtype=np.int64), sizes), np.repeat(sizes, sizes)]
            for i in range(0, len(keys), 1 << 16):
                yield _mapper([pa.array(x[i : i + (1 << 16)]) for x in columns], ["key", "cls", "n"])

    return texts.select("cls", "text").mapInArrow(run, "key long, cls long, n long")


def _parted(members: DataFrame) -> DataFrame:
    """(key, main, size, salts) of the keys whose members (key, cls, component) aren't all in one component, with the largest one."""
    parts = members.groupBy("key", "component").agg(F.count("*").alias("size"))
    keys = parts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("size"))
    return keys.where("parts > 1").select("key", "main", "size", F.ceil(F.col("size") / SALT_ROWS).cast("int").alias("salts"))


def _linked(pairs: DataFrame, k: int, s: Similarity) -> DataFrame:
    """Of pairs (a, b, ta, tb) of classes and texts those whose sets reach the threshold. A text whose set isn't its
    class's (another row of the same id) yields nothing."""

    def run(batches):
        last = None  # the class, text and set of the pair before: pairs come in order of a
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, b, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if last is None or last[0] != a or last[1] != ta:
                    last = (a, ta, *shingle_sets(*utf8(pa.array([ta])), k))
                x, (y,) = last[2], shingle_sets(*utf8(pa.array([tb])), k)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common * s.den >= (len(x) + len(y) - common) * s.num and _class_of(x) == a and _class_of(y) == b:
                    found[0].append(a)
                    found[1].append(b)
            yield _mapper([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _near(s: Similarity, a: str = "x", b: str = "y"):
    """Size and sketch bounds that every linked pair meets."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    bits = sum((F.bit_count(F.col(f"{a}.{i}").bitwiseXOR(F.col(f"{b}.{i}"))) for i in SKETCHES), F.lit(0))
    return (F.greatest(f"{a}.n", f"{b}.n") * s.num <= F.least(f"{a}.n", f"{b}.n") * s.den) & (bits * (s.den + s.num) <= total * (s.den - s.num))


@dataclass
class _Join:
    """One join's documents and tables: `lite` has a row (cls, n, sketch, id) for each class."""

    docs: DataFrame
    lite: DataFrame
    similarity: Similarity
    k: int
    id_col: str
    text_col: str
    scratch: Scratch

    def near(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that sizes and sketches leave."""
        lite = self.lite.select("cls", "n", *SKETCHES)
        one = pairs.alias("p").join(lite.alias("x"), F.col("p.b") == F.col("x.cls")).select("p.a", F.struct("x.*").alias("x"))
        left = one.join(lite.alias("y"), (F.col("a") == F.col("y.cls")) & _near(self.similarity))
        return left.select("a", F.col("x.cls").alias("b"))

    def texts(self, wanted: DataFrame) -> tuple[DataFrame, bool]:
        """(cls, text) of the classes in `wanted` (cls), of one document each, and whether rows of one id make it more."""
        classes = self.scratch.table(wanted.distinct().join(self.lite.select("cls", "id"), "cls"), "classes")
        ids = classes.where("id is not null")
        texts = self.docs.join(sized_broadcast(ids), self.docs[self.id_col] == ids["id"]).select("cls", F.col(self.text_col).alias("text"))
        nameless = sized_broadcast(classes.where("id is null").select("cls"))
        others = _with_class(self.docs.where(F.col(self.id_col).isNull()), self.k, self.text_col).join(nameless, "cls", "left_semi").dropDuplicates(["cls"])
        texts = self.scratch.table(texts.unionByName(others), "texts")
        repeated = texts.count() > classes.count()
        return (self.scratch.table(texts.distinct(), "texts") if repeated else texts), repeated

    def common(self) -> np.ndarray:
        """The shingles that at least LEAST of about FIT_CLASSES classes have, sorted; at most the MOST most frequent."""
        step = -(-self.lite.count() // FIT_CLASSES) or 1
        texts, _ = self.texts(self.lite.where(F.pmod(F.xxhash64("cls"), F.lit(step)) == 0).select("cls"))
        found = _repeated(texts.repartition(FIT_TASKS), self.k).groupBy("key").agg(F.sum("often").alias("often")).where(F.col("often") >= LEAST)
        keys = found.orderBy(F.desc("often"), "key").limit(MOST).select("key").toArrow().column(0).to_numpy()
        return np.sort(keys.astype(np.int64).view(np.uint64))

    def rare(self, wanted: DataFrame) -> DataFrame:
        """(key, cls, at) of the classes in `wanted`: each one's shingles in the order of how many of the classes have
        them, as far as the first that it shares with a linked one may be, with their places; those that it has alone are left out."""
        texts, repeated = self.texts(wanted)
        shingles = _shingles(texts, self.k)
        shingles = self.scratch.table(shingles.distinct() if repeated else shingles, "shingles")
        often = shingles.groupBy("key").agg(F.count("*").alias("often"))
        order = Window.partitionBy("cls").orderBy("often", "key")
        placed = shingles.join(often, "key").withColumn("at", F.row_number().over(order) - 1)
        return placed.where((F.col("often") > 1) & ((F.col("n") - F.col("at")) * self.similarity.den >= F.col("n") * self.similarity.num)).select("key", "cls", "at")

    def crossing(self, members: DataFrame, keys: DataFrame) -> DataFrame:
        """(a, b) of members (key, cls, component, at) of one of `keys` that are in different components and may be linked
        by their sizes, places and sketches. `at` is how many shingles of a member the other surely lacks if this key is
        the first they share."""
        s = self.similarity
        # linked sets' sizes are at most one step apart
        step = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(s.den / s.num) * 1.0001)).cast("int") if s.den > s.num else F.col("n").cast("int")
        open_ = self.scratch.table(members.join(keys, "key").join(self.lite.drop("id"), "cls").withColumn("step", step), "open")
        stray = open_.where("component != main").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
        every = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
        # of two outside the main component the pair comes from the smaller one
        once = (F.col("y.component") == F.col("y.main")) | (F.col("x.cls") < F.col("y.cls"))
        left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) * (s.den + s.num) >= (F.col("x.n") + F.col("y.n")) * s.num
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.step") == F.col("y.step"))
        met = stray.alias("x").join(every.alias("y"), same & (F.col("x.component") != F.col("y.component")) & once & left & _near(s))
        return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))

    def verified(self, near: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold. Texts, one of each class, move only for pairs that wide
        sketches leave; texts shrink in a shuffle, hashes don't."""
        near = self.scratch.table(near, "near-pairs")
        texts, _ = self.texts(near.select(F.col("a").alias("cls")).union(near.select("b")))
        wide = self.scratch.table(_wide(texts, self.k), "wide")
        both = near.join(wide.withColumnsRenamed({"cls": "b", "n": "nb", "wide": "wb"}), "b").join(wide.withColumnsRenamed({"cls": "a", "n": "na", "wide": "wa"}), "a")
        bits = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
        s = self.similarity
        near = self.scratch.table(both.where(bits * (s.den + s.num) <= (F.col("na") + F.col("nb")) * (s.den - s.num)).select("a", "b").distinct(), "close-pairs")
        one = near.join(texts.withColumnsRenamed({"cls": "b", "text": "tb"}), "b")
        both = one.join(texts.withColumnsRenamed({"cls": "a", "text": "ta"}), "a")
        return self.scratch.table(_linked(both, self.k, self.similarity).distinct(), "links")


def class_links(docs: DataFrame, sizes: DataFrame, similarity: Similarity, k: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between classes that are enough to connect every pair of linked classes, and the
    components of the linked classes."""
    docs = docs.select(id_col, text_col)
    lite = sizes.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), *(F.first(x).alias(x) for x in SKETCHES), F.min("id").alias("id"))
    join = _Join(docs, scratch.table(lite, "lite"), similarity, k, id_col, text_col, scratch)
    largest = sizes.agg(F.max("n")).first()[0] or 0
    ranges = bands(similarity, largest)
    edges = [low for low, _ in ranges]
    number = sum((F.when(F.col("n") >= low, 1).otherwise(0) for low in edges[1:]), F.lit(0))
    held = {r[0]: r[1] for r in sizes.where("n > 0").groupBy("n").count().groupBy(number.alias("band")).agg(F.sum("count")).collect()}
    plan = {i: allocate(i, low, high, similarity, held.get(i, 0) + held.get(i - 1, 0)) for i, (low, high) in enumerate(ranges) if held.get(i)}
    expected = sum(2 * held[i] * (b.segments + b.deletions * (b.high // b.segments + 1)) for i, b in plan.items())
    bits = min(64, 20 + expected.bit_length())

    keyed = _indexed(docs, plan, edges, similarity, bits, k, id_col, text_col, join.common())
    dealt = keyed.repartition(F.when(F.col("leader") == F.col("member"), F.col("key")).otherwise(F.xxhash64("member")))
    shared = scratch.table(dealt.sortWithinPartitions("key", "leader").mapInArrow(_lead, "key long, leader long, member long, before long"), "shared")

    # each member meets its key's leader and the member before it
    pairs = shared.select(F.col("leader").alias("a"), F.col("member").alias("b")).union(shared.select("before", "member"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = join.verified(join.near(pairs))
    found = components(links)

    # keys whose members are not all in one component: those outside the largest one meet all members
    members = shared.select("key", F.col("leader").alias("cls")).union(shared.select("key", "member")).distinct()
    placed = scratch.table(members.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component")), "placed")
    keys = scratch.table(_parted(placed).where("size > 2"), "keys")  # two members are leader and member
    if keys.isEmpty():
        return links, found
    more = join.crossing(placed.withColumn("at", F.lit(0)), keys.where(F.col("size") <= FEW))
    crowded = placed.join(keys.where(F.col("size") > FEW), "key", "left_semi").select("cls", "component").distinct()
    crowded = scratch.table(crowded, "crowded")
    if not crowded.isEmpty():
        members = scratch.table(join.rare(crowded.select("cls")).join(crowded, "cls"), "rare")
        more = more.union(join.crossing(members, _parted(members)))
    more = more.distinct()
    more = join.verified(more.join(pairs, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return links, found
    links = links.unionByName(more)
    return links, components(links)


def near_components(docs: DataFrame, k: int = 5, similarity: Similarity = Similarity(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links): n_links counts the verified links of the document's class
    that the join kept to connect it, and copies of its set."""
    with Scratch(docs.sparkSession) as scratch:
        sizes = scratch.table(set_sizes(docs, k, id_col, text_col), "sizes")
        links, found = class_links(docs, sizes, similarity, k, scratch, id_col, text_col)
        degree = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("links"))
        classes = sizes.where("cls is not null").groupBy("cls").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        placed = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").join(degree, "cls", "left")
        placed = placed.select("cls", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cls").alias("component"))
        placed = scratch.table(placed, "classes")
        linked = placed.where("links > 0 or copies > 1")
        named = linked.groupBy("component").agg(F.min("first").alias("component_id"))
        named = linked.join(named, "component").select("cls", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
        out = sizes.join(sized_broadcast(named), "cls", "left")
        component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
        return materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "near")


def keep_one(docs: DataFrame, k: int = 5, similarity: Similarity = Similarity(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. All columns stay. Rows without an id stay."""
    found = near_components(docs, k, similarity, id_col, text_col)
    dropped = found.where(F.col(id_col).isNotNull() & (F.col("component_id") != F.col(id_col))).select(id_col).distinct()
    # an id that several rows have: their rows, apart from the first, go if they are linked
    twice = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("rows"), F.count_if((F.col("component_id") == F.col(id_col)) & (F.col("n_links") > 0)).alias("linked")).where("rows > 1 and linked > 1").select(id_col)
    kept = drop_ids(docs, dropped, id_col)
    if twice.isEmpty():
        return kept
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    again = kept.join(sized_broadcast(twice), id_col, "left_semi")
    once = again.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")
    return drop_ids(kept, twice, id_col).unionByName(once.select(*kept.columns))
