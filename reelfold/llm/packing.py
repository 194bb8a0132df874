"""Concatenate and cut: documents end to end, cut into sequences of one length.

Pass 1 tokenises every text where it is read and stores its ids with the token count of its partition
so far; totals of the partitions, summed up in order, turn those counts into offsets in the whole
corpus. Pass 2 cuts at every multiple of the sequence length. Rows are never shuffled: one row for each
partition goes through the running total. Only the last sequence of the corpus is not full.

Rows: a null text counts as empty and still has its end id; repeated rows are packed as often as they
occur; a null id is kept; other columns of the input are not read. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches, stored, totals_before
from reelfold.llm.tokens import encoder, text_runs

SEQUENCE = 2048


def token_rows(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(part, before, doc_id, ids): ids of a text and the end id as little-endian 32-bit integers;
    ``before`` counts the ids of earlier rows of the partition ``part``."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        words = encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in text_runs(texts):
                ids = [i + end for i in words.encode(texts[start:stop])]
                sizes = np.array([len(i) // 4 for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(before + np.cumsum(sizes) - sizes),
                        batch.column(0).slice(start, stop - start),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "before", "doc_id", "ids"],
                )
                before += int(sizes.sum())

    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()),
    ])
    return docs.select(id_col, text_col).transform(in_batches, encode, schema)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = SEQUENCE,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row for each piece of a document within a sequence of ``length`` ids.

    ``start`` counts the document's ids before the piece, ``sequence_id`` and ``offset`` say where it
    lies, ``ids`` (on request) holds it as little-endian 32-bit integers, ``ids_crc32`` is their CRC.
    """
    rows = stored(token_rows(docs, vocabulary, end_id, id_col, text_col), "token-ids")
    bases = totals_before(
        rows.select("part", (F.length("ids") / 4).cast("bigint").alias("n")), "part", {"base": "n"}
    )
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("at"), "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of, starts, sizes, crcs, totals, ats, pieces = [], [], [], [], [], [], []
            ids_column = batch.column(2)
            for row, at in enumerate(batch.column(1).to_pylist()):
                view = memoryview(ids_column[row].as_buffer())
                total, start = len(view) // 4, 0
                while start < total:
                    size = min(total - start, length - (at + start) % length)
                    piece = view[4 * start : 4 * (start + size)]
                    rows_of.append(row)
                    starts.append(start)
                    sizes.append(size)
                    crcs.append(zlib.crc32(piece))
                    totals.append(total)
                    ats.append(at + start)
                    if with_ids:
                        pieces.append(bytes(piece))
                    start += size
            at = np.array(ats, np.int64)
            columns = {
                "doc_id": batch.column(0).take(pa.array(rows_of, pa.int64())),
                "start": pa.array(starts, pa.int64()), "length": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": pa.array(totals, pa.int64()),
                "sequence_id": pa.array(at // length), "offset": pa.array(at % length),
            }
            if with_ids:
                columns["ids"] = pa.array(pieces, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    longs = "start length ids_crc32 doc_tokens sequence_id offset".split()
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in longs]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    return placed.transform(in_batches, cut, schema)
