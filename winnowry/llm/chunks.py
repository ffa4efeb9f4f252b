"""Questions that pieces of a corpus put to the whole corpus.

A corpus is packed once into chunks of a few MB, kept as a table that is bucketed by chunk. A chunk asks by
sending an array of hashes to each bucket of the hash space; the owner of a bucket sees what all chunks sent
and answers each chunk; the answers, which are small, are joined to the chunks, whose texts stay where they
are. Rows of these exchanges hold packed arrays, so that Spark moves thousands of rows in place of millions,
and a value that many chunks hold costs its bucket one entry a chunk at most. A task sends what its chunks ask of a
bucket in one row (one more every ASKED_BYTES), so rows of an exchange are as many as its blocks: tasks times buckets.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, shared_path, stash, width

#: Bytes of text of a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of questions that a task gathers before it sends them.
ASKED_BYTES = 16 << 20
ASK = "bucket int, chunks array<long>, payloads array<binary>"
ANSWER = "chunk long, bucket int, payload binary"
_IPC = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))

Asker = Callable[[pa.RecordBatch, dict[int, bytes], int], Iterator[tuple[int, bytes]]]


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: pa.Buffer | bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def pack(df: DataFrame, text: str = "text", limit: int | None = None) -> DataFrame:
    """chunk, payload (an Arrow batch of all columns): a table in the shared folder, bucketed by chunk. limit: bytes of text of a chunk."""
    spark = df.sparkSession
    limit = limit or CHUNK_BYTES
    at, n = df.columns.index(text), width(spark)

    def chunked(batches):
        task, seq = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def done():
            nonlocal held, size, seq
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            seq, held, size = seq + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([to_ipc(one)], pa.binary())], names=["chunk", "payload"])

        for b in batches:
            if not b.num_rows:
                continue
            bytes_ = np.cumsum(_lengths(b.column(at)))
            first = 0
            while first < b.num_rows:
                before = bytes_[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(bytes_, before + limit - size, side="right")))
                held.append(b.slice(first, last - first))
                size += int(bytes_[last - 1] - before)
                first = last
                if size >= limit or first < b.num_rows:
                    yield done()
        if held:
            yield done()

    name = f"winnowry_{shared_path(spark, 'x')[-32:]}"
    (
        df.mapInArrow(freed(chunked), "chunk long, payload binary")
        .write.format("parquet")
        .option("path", shared_path(spark, "chunks"))
        .option("compression", "none")
        .option("parquet.enable.dictionary", "false")
        .bucketBy(n, "chunk")
        .saveAsTable(name)
    )
    out = spark.table(name)
    # The plan holds the files and their buckets; the catalog need not. The folder goes with the shared folder.
    spark.sql(f"DROP TABLE {name}")
    return out


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def ask(chunks: DataFrame, asker: Asker, answers: DataFrame | None = None) -> DataFrame:
    """What each chunk sends: asker(batch, earlier answers by bucket, number of buckets) yields (bucket, payload)."""
    n = width(chunks.sparkSession)

    def sent(batches):
        held, size = defaultdict(list), 0

        def rows():
            some = sorted(held.items())
            for i in range(0, len(some), 512):
                part = some[i : i + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in part], pa.int32()), pa.array([[c for c, _ in x] for _, x in part], pa.list_(pa.int64())), pa.array([[p for _, p in x] for _, x in part], pa.list_(pa.binary()))],
                    names=["bucket", "chunks", "payloads"],
                )

        for chunk, batch, got in opened(batches):
            for bucket, payload in asker(batch, got, n):
                held[bucket].append((chunk, payload))
                size += len(payload) + 16
            if size >= ASKED_BYTES:
                yield from rows()
                held, size = defaultdict(list), 0
        yield from rows()

    return joined(chunks, answers).mapInArrow(freed(sent), ASK)


def answer(asked: DataFrame, answerer: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], label: str) -> DataFrame:
    """Bring the questions of each bucket together; answerer takes its (chunk, payload) list and yields (chunk, payload)."""

    def solved(batches):
        by = defaultdict(list)
        for b in batches:
            for k, chunks_, payloads in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                by[k] += [(c, p.as_buffer().to_pybytes()) for c, p in zip(chunks_, payloads.values, strict=True)]
        for k in sorted(by):
            out = list(answerer(sorted(by.pop(k), key=lambda x: x[0])))
            for i in range(0, len(out), 256):
                some = out[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some], pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array([p for _, p in some], pa.binary())], names=["chunk", "bucket", "payload"])

    return stash(asked.repartitionById(width(asked.sparkSession), F.col("bucket")).mapInArrow(freed(solved), ANSWER), label)


def joined(chunks: DataFrame, *answers: DataFrame | None) -> DataFrame:
    """chunk, payload, and for each table of answers an array of them; texts don't move."""
    out = chunks
    for i, a in enumerate(answers):
        if a is not None:
            out = out.join(a.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "payload")).alias(f"got{i}")), "chunk", "left")
    return out


def opened(batches):
    """(chunk, its batch of rows, answers by bucket...) of what joined() gives."""
    for b in batches:
        for i in range(b.num_rows):
            got = [{x["bucket"]: x["payload"] for x in c[i].as_py() or ()} for c in b.columns[2:]]
            yield (b.column(0)[i].as_py(), from_ipc(b.column(1)[i].as_buffer()), *(got or [{}]))


def by_bucket(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that groups hashes by bucket, and where each bucket starts in it. Chosen by the high 32 bits."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))


def repeated(values: np.ndarray) -> np.ndarray:
    """The distinct values that occur more than once, ascending."""
    s = np.sort(values)
    s = s[1:][s[1:] == s[:-1]]
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


def among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which values are among few, which is sorted."""
    if not len(few):
        return np.zeros(len(values), bool)
    seen = np.zeros(1 << 16, bool)
    seen[(few & few.dtype.type(0xFFFF)).astype(np.int64)] = True
    out = seen[(values & values.dtype.type(0xFFFF)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(few, values[maybe])
    out[maybe] = few[np.minimum(at, len(few) - 1)] == values[maybe]
    return out
