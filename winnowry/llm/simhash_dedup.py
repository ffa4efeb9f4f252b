"""Near-duplicate texts: 64-bit SimHash, Golay-code keys, pigeonhole over segments, exact check.

1. A text's fingerprint has a bit set if over half of the XXH64 hashes of its word shingles have it.
2. Equal fingerprints are one from here on. Each gives the keys of golay.py: those within 3 bits share one.
3. Owners of the key space check all that share a key and give, for each group that links join, a tree of it (no
   node has over three neighbours there), so no group makes more than one edge a member and key.
4. Components of these edges are the groups; the least doc_id names each.

Nulls: a null text has no words, fingerprint zero; a null doc_id never names a component unless all of it are
null. Repeated rows are all returned. A very long text is read in one piece. An empty table gives an empty result.
Other columns are ignored here, whatever their names, and kept by keep_one().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .components import components
from .golay import keys
from .near_groups import groups, shingle_hashes
from .shared import freed, stash, table, width, without
from .words import U64, flat

RADIUS = 3
_BATCH = 1 << 20


def shingle_prints(column: pa.Array, shingle: int) -> np.ndarray:
    """The fingerprint of each text of a column."""
    buf, offsets = flat(column)
    out = np.zeros(len(column), U64)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BATCH, side="right")) - 1)
        out[first:last] = _prints(buf[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], shingle)
        first = last
    return out


def _prints(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    h, own, n = shingle_hashes(buf, offsets, shingle)
    many = np.bincount(own, minlength=n)
    has = np.flatnonzero(many)
    first = np.searchsorted(own, has)
    out = np.zeros(n, U64)
    out[has] = np.packbits(2 * bit_counts(h, first) > many[has][:, None], axis=1).view(">u8").ravel()
    return out


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit (highest first), for each group of hashes from `first` on."""
    out = np.empty((len(first), 64), np.int64)
    ends = np.append(first[1:], len(h))
    for byte in range(8):
        part = (h >> U64(56 - 8 * byte)).astype(np.uint8)
        for bit in range(8):
            total = np.concatenate(([0], np.cumsum((part >> np.uint8(7 - bit)) & np.uint8(1), dtype=np.int32)))
            out[:, 8 * byte + bit] = total[ends] - total[first]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """docs with a column fingerprint (long, the 64 bits); a column of docs of that name gives way."""
    docs = docs.drop("fingerprint")
    at = docs.columns.index(text)
    rows = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    schema = T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])

    def printed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shingle_prints(b.column(at), shingle).view(np.int64))], names=[*b.schema.names, "fp"])

    return rows.mapInArrow(freed(printed), schema).toDF(*docs.columns, "fingerprint")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a tree of each group that links of RADIUS bits or fewer join among the distinct fingerprints."""
    edges, rest = [], np.unique(prints)
    while len(rest) > 1:
        member, rest = [rest[0]], rest[1:]
        at = 0
        while at < len(member) and len(rest):
            near = np.bitwise_count(rest ^ member[at]) <= RADIUS
            member.extend(rest[near])
            rest = rest[~near]
            at += 1
        edges += [(member[i], member[(i - 1) // 2]) for i in range(1, len(member))]
    return edges


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) of distinct fingerprints (column fp) that join the same components as all links do."""
    n = width(prints.sparkSession)

    def keyed(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(U64)
            for i in range(0, len(fp), 1 << 15):
                some = fp[i : i + (1 << 15)]
                owner, key = keys(some)
                order, at = C.by_bucket(key, n)
                low, own = key.astype(np.uint32)[order], some[owner][order]
                used = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.uint64(at[k + 1] - at[k]).tobytes() + own[at[k] : at[k + 1]].tobytes() + low[at[k] : at[k + 1]].tobytes() for k in used], pa.binary())], names=["bucket", "payload"])

    def verified(batches):
        held = {}
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(k, []).append(p)
        for parts in held.values():
            size = [int(np.frombuffer(p, U64, 1)[0]) for p in parts]
            fp = np.concatenate([np.frombuffer(p, U64, m, 8) for p, m in zip(parts, size, strict=True)])
            key = np.concatenate([np.frombuffer(p, np.uint32, m, 8 + 8 * m) for p, m in zip(parts, size, strict=True)])
            order = np.argsort(key, kind="stable")
            fp, key = fp[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.append(first, len(key)))
            pair = first[count == 2]
            a, c = fp[pair], fp[pair + 1]
            near = (np.bitwise_count(a ^ c) <= RADIUS) & (a != c)
            edges = [np.stack([a[near], c[near]], 1)]
            for i, m in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                if got := _forest(fp[i : i + m]):
                    edges.append(np.array(got, U64))
            e = np.unique(np.concatenate(edges), axis=0).view(np.int64)
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return prints.select("fp").mapInArrow(freed(keyed), "bucket int, payload binary").repartitionById(n, F.col("bucket")).mapInArrow(freed(verified), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row doc_id, fingerprint (16 lowercase hex digits) and component_id, the least doc_id that links reach."""
    printed = fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle)
    own = stash(printed.select("doc_id", F.col("fingerprint").alias("fp")), "prints")
    least = stash(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = components(links(least))
    of = least.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stash(of.join(named, "root").select("fp", "component_id"), "named")
    return own.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay if one document of each group of near duplicates does, the one of least doc_id.

    Near duplicates are texts of a Jaccard similarity of 0.8 or more over their shingles, found by fingerprints and Golay
    keys in near_groups.py and verified there. A row without doc_id has no group and stays. Of repeated rows with the same doc_id all stay.
    """
    own = groups(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), shingle)
    gone = own.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return without(docs, gone, lambda d, g: d[doc_id].cast("long") == g["_gone"])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document over 3-word shingles, linked at 3 bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
