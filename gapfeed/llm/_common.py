"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapfeed import shipping
from gapfeed.shipping import materialize, scratch_path, scratch_root  # noqa: F401

#: The contract's words: runs of anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows of two longs that one broadcast may hold (about 64 MB on each executor).
BROADCAST_ROWS = 2_000_000
#: Rows and bytes of one Arrow batch: texts are long, so Spark's 10,000 rows a batch would be tens of MB on either side.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors and bound the session's Arrow batches (smaller settings stay)."""
    shipping.ship(spark)
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower()
        if not now.isdigit() or not 0 < int(now) < bound:
            spark.conf.set(key, str(bound))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count proves that it stays within `rows`; else unchanged,
    so that the join shuffles (AQE splits skewed partitions)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is in `ids` (one column `key`)."""
    return df.join(sized_broadcast(ids), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of `df` whose key is not in `ids`; null keys stay."""
    return df.join(sized_broadcast(ids), key, "left_anti")


def text_chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold at most `most_bytes` of text, or one row."""
    n = len(column)
    if not n:
        return
    lengths = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
        yield at, to
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def texts_of(column: pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def word_count(text: Column | str) -> Column:
    """Number of words of a text (null: 0)."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(c.isNull() | (bare == ""), 0).otherwise(F.size(F.split(bare, SPACE))).cast("long")
