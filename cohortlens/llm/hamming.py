"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments. Two codes within distance m * (s + 1) - 1 of each
other agree in some of their m segments up to s bits, so looking up every value
within s bits of each query segment finds all of them. The search radius s grows
until the k-th verified distance is within that bound; then nothing unseen can
be nearer.

Codes are indexed in blocks of bounded size and queries come in blocks too; each
pair of blocks is one task's work and returns at most k rows a query. Equal
codes keep only the k smallest ids, chosen before the shuffle, which is all an
exact answer can need.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_BLOCK = 1 << 16
QUERY_BLOCK = 512


def binary_codes(vectors: DataFrame) -> DataFrame:
    """(id, code): one bit for every dimension of ``vectors(id, vector)``, set where the value is positive.

    NULL and NaN values give 0; NULL and empty vectors have no code.
    """
    def run(batches):
        for batch in batches:
            codes = [np.packbits(np.array([x is not None and x > 0 for x in v])).tobytes() if v else None
                     for v in batch.column("vector").to_pylist()]
            bits = [len(v) if v else 0 for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(bits, pa.int32()), pa.array(codes, pa.binary())],
                                             ["id", "bits", "code"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "vector").mapInArrow(run, f"id {kind}, bits int, code binary").where("code is not null")


class MultiIndex:
    """Segment tables of one block of codes (rows of bytes of equal length)."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        wide = max(1, min(16, int(np.log2(max(len(codes), 2)))))  # about one code a bucket
        self.cuts = [(a, min(a + wide, bits)) for a in range(0, bits, wide)]
        unpacked = np.unpackbits(codes, axis=1)[:, :bits]
        self.tables = []
        for a, b in self.cuts:
            value = self._values(unpacked, a, b)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << (b - a)) + 1))))

    @staticmethod
    def _values(unpacked: np.ndarray, a: int, b: int) -> np.ndarray:
        return unpacked[:, a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1))

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest by (distance, id) among rows of other ids than ``own``."""
        m, n = len(self.cuts), int(np.count_nonzero(ids != own))
        bits = np.unpackbits(query[None], axis=1)[:, :self.bits]
        seen = np.zeros(len(ids), bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        if not n:
            return rows, dist
        for radius in range(max(b - a for a, b in self.cuts) + 1):
            fresh = []
            for (a, b), (order, starts) in zip(self.cuts, self.tables):
                if radius > b - a:
                    continue
                near = self._values(bits, a, b)[0] ^ masks(b - a, radius)
                lo, size = starts[near], starts[near + 1] - starts[near]
                at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                fresh.append(order[at])
            found = np.unique(np.concatenate(fresh))
            found = found[~seen[found]]
            seen[found] = True
            found = found[ids[found] != own]
            rows = np.concatenate((rows, found))
            dist = np.concatenate((dist, np.bitwise_count(self.codes[found] ^ query).sum(axis=1, dtype=np.int64)))
            if len(rows) >= k or len(rows) == n:
                best = np.lexsort((ids[rows], dist))[:k]
                rows, dist = rows[best], dist[best]
                if len(rows) == min(k, n) and (dist[-1] <= m * (radius + 1) - 1):
                    break
        best = np.lexsort((ids[rows], dist))[:k]
        return rows[best], dist[best]


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with ``radius`` bits set."""
    if (width, radius) not in _MASKS:
        _MASKS[width, radius] = np.array([sum(1 << x for x in c) for c in combinations(range(width), radius)], np.int64)
    return _MASKS[width, radius]


def _smallest(rows: DataFrame, k: int, by: list[str], order: list[str]) -> DataFrame:
    """The first k rows of each group; Spark limits groups before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest codes of every query but itself.

    ``codes`` and ``queries`` have (id long, bits, code). Codes of different
    lengths are not compared; ties go to the smaller id; rows without an id are
    not indexed and ask nothing; repeated rows count once an id, and other rows
    of a query's own id are passed over in the search, so they cost no neighbour.
    """
    codes = codes.where("id is not null").dropDuplicates(["id", "code"])
    queries = queries.where("id is not null").dropDuplicates(["id", "code"])
    entries = _smallest(codes, k + 1, ["code", "bits"], ["id"]).drop("place")
    asked = queries.select("id", "bits", "code")
    blocks = lambda rows, size, key: rows.withColumn(
        key, F.pmod(F.xxhash64("code"), F.lit(max(1, -(-rows.count() // size)))))
    index = (blocks(entries, INDEX_BLOCK, "ib").groupBy("bits", "ib")
             .agg(F.collect_list(F.struct("code", "id")).alias("entries")))
    asking = blocks(asked, QUERY_BLOCK, "qb").groupBy("bits", "qb").agg(F.collect_list(F.struct("code", "id")).alias("asked"))
    pairs = index.join(asking, "bits").repartition("bits", "ib", "qb")

    def run(batches):
        kept = None
        for batch in batches:
            for bits, ib, entries_, asked_ in zip(*(batch.column(c).to_pylist() for c in ("bits", "ib", "entries", "asked"))):
                if kept is None or kept[0] != (bits, ib):
                    matrix = np.frombuffer(b"".join(e["code"] for e in entries_), np.uint8).reshape(len(entries_), -1)
                    kept = ((bits, ib), MultiIndex(matrix, bits), np.array([e["id"] for e in entries_], np.int64))
                _, tree, ids = kept
                out = [[], [], [], []]
                for q in asked_:
                    rows, dist = tree.search(np.frombuffer(q["code"], np.uint8), ids, q["id"], k)
                    out[0] += [q["id"]] * len(rows)
                    out[1] += [q["code"]] * len(rows)
                    out[2].append(ids[rows])
                    out[3].append(dist)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                     pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3]).astype(np.int32))],
                    ["query_id", "code", "id", "distance"])

    near = pairs.mapInArrow(run, "query_id long, code binary, id long, distance int")
    return _smallest(near, k, ["query_id", "code"], ["distance", "id"]).select(
        "query_id", F.col("place").cast("int").alias("rank"), "id", "distance")
