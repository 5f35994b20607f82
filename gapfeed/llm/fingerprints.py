"""Document fingerprints by consistent weighted sampling.

A document's terms are its words, weighted by how much of the text they make
up (occurrences times length); any positive weights will do. For each term and each of the 48 positions a hash
gives r and c, both of a gamma distribution of shape 2, and an even beta between 0 and 1. A term of weight w then has the level
t = floor(ln w / r + beta) and the value ln a = ln c - r (t - beta) - r; the term of the
least value, together with its level, is the position's sample. Two documents have one sample at a position with the
probability of their generalised Jaccard similarity (the sums of min and of max of their terms' weights),
whatever a term weighs, so the share of equal samples estimates it without bias.
Samples are kept in 16 bits. Values are compared to 2^-38.

Everything is DataFrame code: documents are dealt by ranges of id (one shuffle),
and within a range terms are counted and sampled by hash aggregation without
another shuffle of terms.

Nulls are empty texts; an empty text has no terms and a fingerprint of zeros,
which is like itself (1) and unlike all others (0). Rows are in order of id,
nulls first; rows of one id in order of text. Repeated rows have equal
fingerprints. One row is its own next. An empty table yields no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapfeed.llm._common import SPACE, materialize

#: Positions of a fingerprint.
POSITIONS = 48
#: Positions that one row of a term samples, a divisor of POSITIONS: a document's entry in the hash map is looked up once
#: for all of them. With 8 the generated code was seven times slower than with 4.
BLOCK = 4


def _even(h: Column, shift: int, bits: int) -> Column:
    """A number between 0 and 1 from some bits of a hash."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)


def samples(terms: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """For rows (keys, term, weights...) one row for each of keys, with an array of samples for each
    weight column: `fp_<weight>`, POSITIONS ints, all 0 where no term has a positive weight.

    terms holds each (keys, term) once; `term` is a 64-bit hash, weights are numbers.
    """
    level = lambda w: F.when(F.col(w) > 0, F.log(F.col(w).cast("double")))
    held = terms.select(*keys, "term", *[level(w).alias(w) for w in weights])
    held = held.sortWithinPartitions(*keys)  # a document's terms side by side, so that its positions stay in the processor's cache
    js, own = range(BLOCK), [*keys, "block", *weights]
    each = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(POSITIONS // BLOCK - 1))))
    pos = lambda j: F.col("block") * BLOCK + j
    each = each.select(*own, *[F.xxhash64("term", pos(j)).alias(f"_h{j}") for j in js], *[F.xxhash64(pos(j), "term").alias(f"_g{j}") for j in js])
    # -ln(u u') is of gamma distribution of shape 2
    gamma = lambda h: -F.log(_even(F.col(h), 0, 26) * _even(F.col(h), 26, 26))
    beta = lambda j: (F.shiftrightunsigned(f"_h{j}", 52) * 4096 + F.shiftrightunsigned(f"_g{j}", 52)).cast("double") / float(1 << 24)
    each = each.select(*own, *[x for j in js for x in (F.col(f"_g{j}"), gamma(f"_h{j}").alias(f"_r{j}"), F.log(gamma(f"_g{j}")).alias(f"_c{j}"), beta(j).alias(f"_b{j}"))])
    levels = [F.floor(F.col(w) / F.col(f"_r{j}") + F.col(f"_b{j}")).alias(f"_t{j}_{w}") for j in js for w in weights]
    each = each.select(*keys, "block", *[f"_{x}{j}" for j in js for x in "grcb"], *levels)
    # value and sample in one long: the least value brings its sample along
    value = lambda j, w: F.floor((F.col(f"_c{j}") - F.col(f"_r{j}") * (F.col(f"_t{j}_{w}") - F.col(f"_b{j}") + 1) + 128) * float(1 << 38))
    sample = lambda j, w: F.pmod(F.shiftrightunsigned(f"_g{j}", 24) + F.col(f"_t{j}_{w}") * 40503, F.lit(65535)) + 1
    least = each.groupBy(*keys, "block").agg(*[F.min(value(j, w) * 65536 + sample(j, w)).alias(f"_{w}_{j}") for w in weights for j in js])
    low = lambda c: F.coalesce(F.col(c).bitwiseAND(F.lit(65535)), F.lit(0)).cast("int")
    blocks = least.select(*keys, "block", *[F.array(*[low(f"_{w}_{j}") for j in js]).alias(w) for w in weights])
    gathered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", *weights))).alias("_all"))
    return gathered.select(*keys, *[F.flatten(F.transform("_all", lambda x: x[w])).alias(f"fp_{w}") for w in weights])  # noqa: B023


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples among positions that aren't 0 in both; 1 if all are (two texts without terms)."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(both, lambda x: (x["a"] != 0) | (x["b"] != 0)))
    same = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) & (x["a"] != 0)))
    return F.when(used == 0, 1.0).otherwise(same / used).cast("double")


def text_form(a: Column) -> Column:
    """A fingerprint as hexadecimal text."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 4, "0")), "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint array) of each row; rows of one id are told apart by a hash of their text, repeated rows counted."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("id", "text").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    keyed = rows.select("id", "copies", F.xxhash64("text").alias("part"), F.explode_outer(words(F.col("text"))).alias("w"))
    terms = keyed.groupBy("id", "part", "copies", F.xxhash64("w").alias("term")).agg(F.sum(F.coalesce(F.char_length("w"), F.lit(0))).alias("weight"))
    made = samples(terms, ["id", "part", "copies"], ["weight"])
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(F.col("id").alias(id_col), F.col("fp_weight").alias("fingerprint"))


def ranges(docs: DataFrame, id_col: str, buckets: int) -> Column:
    """The number of the id range a row is in: ranges of about equal row counts, ordered like ids, nulls first."""
    cuts = sorted(set(docs.approxQuantile(id_col, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.lit(int(x)) for x in cuts])
    return F.when(F.col(id_col).isNull(), 0).otherwise(F.size(F.filter(edges, lambda x: x <= F.col(id_col))) + 1)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(bucket, rn, ghost, id, text, next_text): rows in order of id and the text of the row after each, after the last the first.

    Rows are dealt by ranges of id; the first row of each range also comes as a
    ghost at the end of the range before, so each range has all it needs.
    """
    spark = docs.sparkSession
    buckets = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", ranges(rows, "id", buckets))
    # one row for each range: its smallest id and the range before it (the last for the first)
    heads = rows.groupBy("bucket").agg(F.min("id").alias("id"))
    heads = materialize(heads.withColumn("before", F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy(F.lit(1))))), "heads")
    head = F.broadcast(heads.select(F.col("bucket").alias("hb"), F.col("id").alias("hid"), "before"))  # a row for each range: at most `buckets` + 1
    first = rows.join(head, (F.col("bucket") == F.col("hb")) & F.col("id").eqNullSafe(F.col("hid"))).groupBy("before").agg(F.min("text").alias("text"), F.first("id").alias("id"))
    ghosts = first.select("id", "text", F.col("before").alias("bucket"), F.lit(1).alias("ghost"))
    both = rows.select("id", "text", "bucket", F.lit(0).alias("ghost")).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("id").asc_nulls_first(), "text")
    return both.select("bucket", F.row_number().over(order).alias("rn"), "ghost", "id", "text", F.lead("text").over(order).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """For each row: fingerprints of its text and of its text with the last quarter replaced by the start
    of the next row's, and the likeness of its fingerprint to that and to the next row's."""
    rows = with_next(docs, id_col, text_col, buckets)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    kept, tail = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), F.expr("right(text, cast(floor(char_length(text) / 4) as int))")
    head = F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut)
    # words are counted once for what both texts share; the word at the cut goes with either end
    open_word = F.regexp_extract("kept", r"[^\x20\x09-\x0D]*$", 0)
    parts = rows.select("bucket", "rn", kept.alias("kept"), tail.alias("tail"), head.alias("head"))
    parts = parts.withColumn("open", open_word).select(
        "bucket",
        "rn",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.expr("left(kept, char_length(kept) - char_length(open))").alias("t")),
                F.struct(F.lit(1).alias("part"), F.concat("open", "tail").alias("t")),
                F.struct(F.lit(2).alias("part"), F.concat("open", "head").alias("t")),
            )
        ).alias("p"),
    )
    said = parts.select("bucket", "rn", F.col("p.part").alias("part"), F.explode_outer(F.split("p.t", SPACE)).alias("w"))
    size = F.char_length("w")
    terms = said.select("bucket", "rn", F.xxhash64("w").alias("term"), F.when(F.col("part") < 2, size).otherwise(0).alias("own"), F.when(F.col("part") != 1, size).otherwise(0).alias("edit"))
    terms = terms.groupBy("bucket", "rn", "term").agg(F.sum("own").alias("own"), F.sum("edit").alias("edited"))
    made = samples(terms, ["bucket", "rn"], ["own", "edited"])
    order = Window.partitionBy("bucket").orderBy("rn")
    made = made.withColumn("fp_next", F.lead("fp_own").over(order))
    made = made.select("bucket", "rn", text_form(F.col("fp_own")).alias("fingerprint"), text_form(F.col("fp_edited")).alias("edited_fingerprint"), likeness(F.col("fp_own"), F.col("fp_edited")).alias("near_edited"), likeness(F.col("fp_own"), F.col("fp_next")).alias("near_next"))
    edited = F.concat(kept, head)
    facts = rows.where("ghost = 0").select("bucket", "rn", F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    return facts.join(made, ["bucket", "rn"]).drop("bucket", "rn")
