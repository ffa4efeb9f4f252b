"""Token ids of a corpus in Re-Pair compressed shards, in ascending doc_id order, readable by document.

A store is a Parquet table; a row is a shard: its documents in order with their counts of ids and of symbols, the
rules of its grammar, the ids each rule stands for, and the sequence of symbols. A document is read by adding up
the symbols before it and expanding its own; no other part of the sequence is touched.

Rows are dealt out by ranges of doc_id, so shards of one partition follow those of the one before, and a shard
closes after SHARD_BYTES of text, so memory is bounded by the longest text.

Nulls: a null text is empty (its only id is the end); null doc_ids come first. Rows with one doc_id are ordered
by a hash of their text, then by text; repeated rows are stored each. A very long text is a shard of its own. An
empty table gives an empty store. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .repair import Grammar, compress, lengths, packed, unpacked
from .shared import freed, shared_path, table, width
from .tokens import encoder
from .words import flat

SHARD_BYTES = 4 << 20
SHARD = "part int, shard long, terminals int, n_tokens long, doc_ids array<long>, tokens array<long>, symbols array<long>, rules binary, expansions binary, sequence binary"
VOCABULARY, TERMINALS, END = "byte_bpe_50k.json", 50_257, 0


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, terminals: int = TERMINALS, end: int = END, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, add the end id, compress by shard and write the store. vocabulary: file of a tokenizers model with white space in its tokens."""
    file = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def shards(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(file, spaces=True).encode
        for ids, column in grouped(batches, SHARD_BYTES):
            tokens, at = encode(*flat(column))
            count = np.diff(at) + 1
            every = np.empty(int(count.sum()), np.uint32)
            last = np.cumsum(count) - 1
            inner = np.ones(len(every), bool)
            inner[last] = False
            every[inner], every[last] = tokens, end
            symbols, rules = compress(every, terminals, end)
            size = lengths(rules, terminals)
            own = np.concatenate((np.ones(terminals, np.int64), size))[symbols]
            per = np.diff(np.searchsorted(np.cumsum(own), np.concatenate(([0], np.cumsum(count))), side="right"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([part << 32 | seq], pa.int64()),
                    pa.array([terminals], pa.int32()),
                    pa.array([len(every)], pa.int64()),
                    *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(count, pa.int64()), pa.array(per, pa.int64()))),
                    pa.array([rules.tobytes()], pa.binary()),
                    pa.array([size.astype(np.uint32).tobytes()], pa.binary()),
                    pa.array([packed(symbols)], pa.binary()),
                ],
                names=["part", "shard", "terminals", "n_tokens", "doc_ids", "tokens", "symbols", "rules", "expansions", "sequence"],
            )
            seq += 1

    # Rows of one doc_id may be many (nulls): the hash parts them too.
    rows = rows.withColumn("mixed", F.xxhash64("text"))
    dealt = rows.repartitionByRange(width(docs.sparkSession), "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "text").drop("mixed")
    dealt.mapInArrow(freed(shards), SHARD).write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)


def grouped(batches, limit: int):
    """(doc_ids, texts) of runs of rows that hold about `limit` bytes of text."""
    from .chunks import _lengths

    held, size = [], 0
    for b in batches:
        total, first = np.concatenate(([0], np.cumsum(_lengths(b.column(1))))), 0
        while first < b.num_rows:
            last = max(first + 1, int(np.searchsorted(total, total[first] + limit - size, side="right")) - 1)
            held.append(b.slice(first, last - first))
            size += int(total[last] - total[first])
            first = last
            if size >= limit or first < b.num_rows:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return t.column(0), t.column(1)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `before`, the ids of all shards before each."""
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    # One row for each partition that was written: as many as the session's partitions at most.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("p"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    place = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("q")).join(parts, "part").select("shard", (F.col("p") + F.col("q")).alias("before"))
    return shards.join(place, "shard")


def documents(store: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, ids_crc32, and its ids if wanted."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell = {n: b.column(n)[i] for n in b.schema.names}
                terminals = cell["terminals"].as_py()
                grammar = Grammar(np.frombuffer(cell["rules"].as_buffer(), np.uint32).reshape(-1, 2), np.frombuffer(cell["expansions"].as_buffer(), np.uint32).astype(np.int64), terminals)
                ids = grammar.expand(unpacked(cell["sequence"].as_buffer(), sum(cell["symbols"].as_py())))
                count = cell["tokens"].values.to_numpy()
                at = np.concatenate(([0], np.cumsum(count)))
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = [cell["doc_ids"].values, pa.array(cell["before"].as_py() + at[:-1], pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return store.select("terminals", "doc_ids", "tokens", "symbols", "rules", "expansions", "sequence", "before").mapInArrow(freed(read), schema)


def one_document(shard, number: int) -> np.ndarray:
    """The ids of document `number` of a collected shard row, expanding its own symbols only."""
    grammar = Grammar(np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2), np.frombuffer(shard["expansions"], np.uint32).astype(np.int64), shard["terminals"])
    first = sum(shard["symbols"][:number])
    return grammar.expand(unpacked(shard["sequence"], sum(shard["symbols"]), first, first + shard["symbols"][number]))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ids in Re-Pair shards, read back from the files."""
    path = shared_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path)
    return documents(read_store(spark, path), with_ids=False)


QUERIES = {"op3_token_store": op3_token_store}
