"""Packing of token documents into sequences by the sum-of-squares rule.

Let N(g) be the number of open sequences with g tokens free. Each piece goes where the sum of all N(g)^2 becomes
smallest: into an open sequence with some gap, or into a new one. The rule keeps many different gaps at hand and
so closes sequences exactly.

Documents become pieces of at most `capacity` tokens; only longer documents are cut. Pieces are dealt at random
into shards of SHARD pieces, packed side by side, in an order that depends on doc_id and piece alone. What stays
open at the end of the shards is packed again as whole sequences, so shards leave next to nothing behind.

Nulls: a null text is empty (the end id only); a null doc_id is returned as null. Repeated rows are packed each.
Ties between gaps go to the least gap. A very long text takes memory in proportion to its length. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import freed, stash, table
from .token_store import grouped
from .tokens import encoder
from .words import flat

CAPACITY, END, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Pieces of one shard: a fixed share of the work, so that shards grow in number with the input.
SHARD = 1 << 15
BATCH_BYTES = 4 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end: int, with_ids: bool, doc_id: str, text: str) -> DataFrame:
    """A row for each piece of each document."""
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def cut(batches):
        encode, row = encoder(vocabulary, spaces=False).encode, TaskContext.get().partitionId() << 40
        for doc, column in grouped(batches, BATCH_BYTES):
            tokens, at = encode(*flat(column))
            count = np.diff(at) + 1
            every = np.empty(int(count.sum()), np.uint32)
            first = np.cumsum(count) - count
            inner = np.ones(len(every), bool)
            inner[first + count - 1] = False
            every[inner], every[~inner] = tokens, end
            times = (count + capacity - 1) // capacity
            of = np.repeat(np.arange(len(count)), times)
            number = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            start = number * capacity
            length = np.minimum(count[of] - start, capacity)
            place = first[of] + start
            data = memoryview(every.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * s : 4 * (s + n)]) for s, n in zip(place.tolist(), length.tolist(), strict=True)]
            out = [doc.take(pa.array(of)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(row + np.arange(len(of)), pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(place, len(every)), pa.int32()), pa.array(every.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "ids"][: len(out)])
            row += len(of)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(freed(cut), schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size in turn, and the fill of each bin."""
    free = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    own, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        if s < capacity:
            # Change of the sum for each gap from s on: one bin fewer there, one more at the gap that is left.
            change = 1 - 2 * free[s:capacity]
            change[1:] += 2 * free[1 : capacity - s] + 1
            change[free[s:capacity] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if change[best] <= 2 * free[capacity - s] + 1:
                gap = s + best
                own[i] = b = stacks[gap].pop()
                free[gap] -= 1
                offset[i] = fill[b]
                fill[b] += s
                if gap > s:
                    free[gap - s] += 1
                    stacks[gap - s].append(b)
                continue
            free[capacity - s] += 1
            stacks[capacity - s].append(len(fill))
        own[i], offset[i] = len(fill), 0
        fill.append(s)
    return own, offset, np.array(fill, np.int64)


def _packed(items: DataFrame, capacity: int, size: str, order: str, tag: int) -> DataFrame:
    """items with bin (long), place (offset in the bin) and fill (of the bin); packed in shards, in ascending `order`."""
    shards = max(1, -(-items.count() // SHARD))
    names = items.columns
    at = names.index(size)

    def pack(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in (order, *(n for n in names if n != order and not pa.types.is_nested(held[0].schema.field(n).type)))])
            own, offset, fill = sum_of_squares(t.column(at).to_numpy(), capacity)
            base = tag << 62 | TaskContext.get().partitionId() << 32
            for c, a in (("bin", own + base), ("place", offset), ("fill", fill[own])):
                t = t.append_column(c, pa.array(a, pa.int64()))
            yield from t.drop_columns("_shard").combine_chunks().to_batches(max_chunksize=1 << 14)

    schema = ", ".join(f"{c} {k}" for c, k in [*items.dtypes, ("bin", "long"), ("place", "long"), ("fill", "long")])
    return items.withColumn("_shard", F.pmod(F.col(order), F.lit(shards)).cast("int")).repartitionById(shards, F.col("_shard")).mapInArrow(freed(pack), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and its offset there."""
    cut = pieces(docs, capacity, vocabulary or public_tokenizers.path(VOCABULARY), end, with_ids, doc_id, text)
    cut = stash(cut.withColumn("rank", F.xxhash64("doc_id", "piece", "ids_crc32", "row")), "pieces")
    once = stash(_packed(cut, capacity, "length", "rank", 0), "packed")
    open_ = stash(once.where(F.col("fill") < capacity).select("bin", "fill").distinct().select(F.col("bin").alias("old"), F.col("fill").alias("size"), F.xxhash64("bin").alias("mixed")), "open")
    again = _packed(open_, capacity, "size", "mixed", 1).select(F.col("old").alias("bin"), F.col("bin").alias("moved"), F.col("place").alias("before"))
    out = once.join(again, "bin", "left")
    ids = ["ids"] if with_ids else []
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, F.coalesce("moved", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("before", F.lit(0))).alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
