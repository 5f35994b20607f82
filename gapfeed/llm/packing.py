"""Packing by power-of-two decomposition.

Each document's ids (with an end id) are cut into pieces whose lengths are
powers of two: as many of the longest as go in, then the binary digits of the
rest. Every piece is a sequence of its own, so no sequence crosses documents
and none needs padding; sequences of one length form a bucket, and a trainer
takes its batches from one bucket at a time.

Nulls and empty texts hold the end id only. Repeated rows are packed each on
its own. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfeed.llm._bpe import PieceEncoder
from gapfeed.llm._common import materialize, text_chunks

CHUNK = 1 << 20


def lengths_of(n: int, longest: int) -> list[int]:
    """The piece lengths of a document of n ids, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, bucket[, ids]) of every piece; bucket is log2(length)."""
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for a, b in text_chunks(batch.column(1), CHUNK):
                part = batch.slice(a, b - a)
                row, start, length, crc, total, kept = [], [], [], [], [], []
                for i, ids in enumerate(encoder.ids(part.column(1).fill_null("").to_pylist())):
                    ids = np.concatenate([ids.astype("<u4"), end])
                    raw, at = ids.tobytes(), 0
                    for n in lengths_of(len(ids), longest):
                        row.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                        total.append(len(ids))
                        if with_ids:
                            kept.append(ids[at : at + n].astype(np.int64))
                        at += n
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([n.bit_length() - 1 for n in length], pa.int32())]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.forget()

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<long>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. Pieces are written first, so that a sequence keeps its id
    when a lost executor's tasks run again. No shuffle."""
    written = materialize(pieces(docs, tokenizer, longest, end_id, with_ids, id_col, text_col), "pieces")
    return written.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
