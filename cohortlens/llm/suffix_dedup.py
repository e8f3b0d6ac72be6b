"""Removal of repeated byte strings with a sparse, range-partitioned suffix sort.

A byte goes if some ``width``-byte string that covers it also starts anywhere
else in the corpus. Sorting all suffixes would move every text many times over,
so starts that are plainly unique or plainly repeated are settled first, by
hashes of content-defined cells, without moving text:

1. A start's *anchor* is the smallest k-gram hash among its ``width`` bytes, so
   equal strings have equal anchors at equal offsets. Starts with one anchor
   form a cell. A cell whose k-gram occurs once holds no repeated start; a cell
   that occurs twice as a whole holds only repeated starts.
2. Cells that share a k-gram but differ are cut into blocks of ``BLOCK`` starts
   by their offset from the anchor, settled in the same way: by the bytes that
   all strings of a block share, and by the block as a whole.
3. The starts left are true suffixes. Sampled splitters range-partition them by
   their leading bytes, each bucket sorts its suffixes by multikey quicksort and
   compares neighbours, and equal strings that lie on both sides of a bucket's
   boundary are matched by comparing bucket edges. Splitters cover the whole row
   (bytes, fingerprint, document, position), so a string that fills a third of
   all rows spreads over many buckets.

Every grouping counts before it shuffles, so hot cells and blocks shrink to a
row per task. Strings are equal when their leading 16 bytes and 64-bit
fingerprints of all their bytes are.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch, list_column, row_key, text_bytes
from cohortlens.llm.kernels import gram_hashes, multikey_quicksort, sliding_min

GRAM = 24
BLOCK = 32
LEAD = 16
_POS = np.uint64((1 << 24) - 1)
PIECE = 1 << 22           # texts longer than this are cut into overlapping pieces


def _cells(data: np.ndarray, width: int):
    """(start, count, anchor - start, k-gram hash, cell hash) of every cell of one text.

    Cells tile the starts; pieces of a very long text overlap by ``width - 1``
    bytes, and a cell cut at a piece's end is two cells with the same anchor.
    """
    raw = data.tobytes()
    for base in range(0, max(len(data) - width + 1, 0), PIECE):
        part = data[base:base + PIECE + width - 1]
        grams = gram_hashes(part, GRAM)
        packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        at = (sliding_min(packed, width - GRAM + 1) & _POS).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        count = np.diff(np.append(start, len(at)))
        s, e = (start + base).tolist(), (start + count + base + width - 1).tolist()
        whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(s, e)), np.uint64, len(s))
        yield start + base, count, at[start] - start, grams[at[start]], whole


def _cell_table(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("rk").to_numpy(zero_copy_only=False)
            rows, cols, size = [], [[] for _ in range(5)], [0]

            def flush():
                parts = [np.concatenate(c) for c in cols]
                ends = np.array(size)
                return pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64())]
                    + [list_column(p.astype(np.int32), ends, pa.int32()) for p in parts[:3]]
                    + [list_column(p.view(np.int64), ends, pa.int64()) for p in parts[3:]],
                    ["rk", "s", "n", "a", "lead", "cell"])

            for i in range(len(keys)):
                for cells in _cells(data[offsets[i]:offsets[i + 1]], width):
                    rows.append(int(keys[i]))
                    size.append(size[-1] + len(cells[0]))
                    for c, values in zip(cols, cells):
                        c.append(values)
                if size[-1] > 1 << 18:
                    yield flush()
                    rows, cols, size = [], [[] for _ in range(5)], [0]
            if rows:
                yield flush()

    return docs.select("rk", "text").mapInArrow(
        run, "rk long, s array<int>, n array<int>, a array<int>, lead array<long>, cell array<long>")


def _cell_bytes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Bytes of the wanted cells: (rk, s, n, a, lead, once, data)."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            keys = batch.column("rk").to_pylist()
            for i, key in enumerate(keys):
                if key in seen:  # a repeated row
                    continue
                seen.add(key)
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                cells = batch.column("cells")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(cells), pa.int64()),
                    *(pa.array([c[x] for c in cells], t) for x, t in
                      (("s", pa.int32()), ("n", pa.int32()), ("a", pa.int32()), ("lead", pa.int64()), ("once", pa.bool_()))),
                    pa.array([raw[c["s"]:c["s"] + c["n"] + width - 1] for c in cells], pa.binary()),
                ], ["rk", "s", "n", "a", "lead", "once", "data"])

    return (docs.select("rk", "text").join(wanted, "rk").select("rk", "text", "cells")
            .mapInArrow(run, "rk long, s int, n int, a int, lead long, once boolean, data binary"))


def _block_table(cells: DataFrame, width: int) -> DataFrame:
    """Blocks of starts by offset from the anchor: (rk, s, lo, hi, once, core, whole)."""
    names = ["rk", "s", "lo", "hi", "once", "core", "whole"]
    mask = (1 << 64) - 1

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = [[] for _ in names]
            for rk, s, n, a, lead, once, raw in zip(*(batch.column(c).to_pylist() for c in
                                                      ("rk", "s", "n", "a", "lead", "once", "data"))):
                for b in range((a - n + 1) // BLOCK, a // BLOCK + 1):
                    lo, hi = max(BLOCK * b, a - n + 1), min(BLOCK * b + BLOCK - 1, a)
                    core = raw[a - BLOCK * b:a - BLOCK * b - BLOCK + 1 + width]
                    whole = raw[a - hi:a - lo + width]
                    for c, v in zip(out, (rk, s, lo, hi, once,
                                          digest(core, seed=((lead & mask) + b) & mask),
                                          digest(whole, seed=lo << 16 | hi))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), *(pa.array(x, pa.int32()) for x in out[1:4]),
                pa.array(out[4], pa.bool_()),
                *(pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in out[5:])], names)

    return cells.mapInArrow(run, "rk long, s int, lo int, hi int, once boolean, core long, whole long")


def _suffixes(cells: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """One row per start of the blocks: leading bytes, fingerprint, row key, position."""
    names = ["w0", "w1", "fp", "rk", "at", "once"]

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            lead, fp, rks, ats, onces = [], [], [], [], []

            def flush():
                words = np.frombuffer(b"".join(lead), ">u8").astype(np.uint64).reshape(-1, LEAD // 8)
                # signed columns sort as the bytes do
                w0, w1 = ((words[:, j] ^ np.uint64(1 << 63)).view(np.int64) for j in (0, 1))
                return pa.RecordBatch.from_arrays([
                    pa.array(w0), pa.array(w1), pa.array(np.array(fp, np.uint64).view(np.int64)),
                    pa.array(rks, pa.int64()), pa.array(ats, pa.int32()), pa.array(onces, pa.bool_())], names)

            for rk, s, a, once, raw, parts in zip(*(batch.column(c).to_pylist() for c in
                                                    ("rk", "s", "a", "once", "data", "parts"))):
                for part in parts:
                    for o in range(part["lo"], part["hi"] + 1):
                        text = raw[a - o:a - o + width]
                        lead.append(text[:LEAD])
                        fp.append(digest(text))
                        rks.append(rk)
                        ats.append(s + a - o)
                        onces.append(once)
                if len(rks) > 1 << 16:
                    yield flush()
                    lead, fp, rks, ats, onces = [], [], [], [], []
            if rks:
                yield flush()

    parts = blocks.groupBy("rk", "s").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    return (cells.join(parts, ["rk", "s"]).select("rk", "s", "a", "once", "data", "parts")
            .mapInArrow(run, "w0 long, w1 long, fp long, rk long, at int, once boolean"))


def _sorted_buckets(suffixes: DataFrame) -> DataFrame:
    """Per bucket: starts of strings that recur in it, and its first and last suffix."""
    names = ["w0", "w1", "fp", "rk", "at", "once", "again", "edge", "bucket"]

    def run(batches):
        cols = [[] for _ in names[:6]]
        for batch in batches:
            for c, col in zip(cols, batch.columns):
                c.append(col.to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        w0, w1, fp, rk, at, once = (np.concatenate(c) for c in cols)
        order = multikey_quicksort([w0, w1, fp])
        w0, w1, fp, rk, at, once = (x[order] for x in (w0, w1, fp, rk, at, once))
        same = (w0[1:] == w0[:-1]) & (w1[1:] == w1[:-1]) & (fp[1:] == fp[:-1])
        again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        edge = np.zeros(len(w0), bool)
        edge[[0, -1]] = True
        keep = (again & once) | edge
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (w0, w1, fp, rk, at, once, again, edge)]
            + [pa.array(np.full(int(keep.sum()), part), pa.int32())], names)

    return suffixes.repartitionByRange("w0", "w1", "fp", "rk", "at").mapInArrow(
        run, "w0 long, w1 long, fp long, rk long, at int, once boolean, again boolean, edge boolean, bucket int")


def repeated_spans(docs: DataFrame, scratch: Scratch, width: int = 200) -> DataFrame:
    """(rk, starts) of every distinct row of ``docs(rk, text)`` with repeated strings.

    ``starts`` is an array of (at, n): the strings that start at ``at`` up to
    ``at + n - 1`` start elsewhere too.
    """
    cells = scratch.save(_cell_table(docs, width), "cells")
    flat = (cells.select("rk", F.explode(F.arrays_zip("s", "n", "a", "lead", "cell")).alias("c"))
            .select("rk", "c.*"))
    kinds = flat.groupBy("lead", "cell").agg(F.count("*").alias("cnt"), *(F.first(c).alias(c) for c in ("rk", "s", "n", "a")))
    kinds = scratch.save(kinds, "kinds")
    leads = (kinds.groupBy("lead").agg(F.count("*").alias("kinds"), F.sum("cnt").alias("total"),
                                       F.count_if(F.col("cnt") == 1).alias("singles")).where("total > 1"))
    leads = scratch.save(leads, "leads")
    scratch.release()

    whole = kinds.where("cnt > 1").select("lead", "cell")
    hit = flat.join(whole, ["lead", "cell"], "left_semi").select("rk", F.col("s").alias("at"), "n").distinct()
    hit = scratch.save(hit, "hit_cells")
    mixed = leads.where("kinds > 1 and singles > 0").select("lead")
    wanted = (kinds.join(mixed, "lead", "left_semi").select("rk", "s", "n", "a", "lead", (F.col("cnt") == 1).alias("once"))
              .groupBy("rk").agg(F.collect_list(F.struct("s", "n", "a", "lead", "once")).alias("cells")))
    wanted = scratch.save(wanted, "wanted")
    scratch.drop("cells", "kinds", "leads")

    bodies = scratch.save(_cell_bytes(docs, wanted, width), "bodies")
    blocks = scratch.save(_block_table(bodies, width), "blocks")
    scratch.drop("wanted")
    shapes = scratch.save(blocks.groupBy("core", "whole").agg(F.count("*").alias("cnt")), "shapes")
    cores = shapes.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("cnt").alias("total"))
    shapes = shapes.join(cores.where("total > 1"), "core")
    settled = (blocks.where("once").join(shapes.where("cnt > 1").select("core", "whole"), ["core", "whole"], "left_semi")
               .join(bodies.select("rk", "s", "a"), ["rk", "s"])
               .select("rk", (F.col("s") + F.col("a") - F.col("hi")).alias("at"),
                       (F.col("hi") - F.col("lo") + 1).alias("n")))
    settled = scratch.save(settled, "hit_blocks")
    open_cores = shapes.where("kinds > 1").groupBy("core").agg(F.min("cnt").alias("least")).where("least = 1")
    left = blocks.join(open_cores.select("core"), "core", "left_semi").select("rk", "s", "lo", "hi")
    suffixes = scratch.save(_suffixes(bodies, left, width), "suffixes")
    scratch.drop("bodies", "blocks", "shapes")

    buckets = scratch.save(_sorted_buckets(suffixes), "buckets")
    edges = (buckets.where("edge").groupBy("w0", "w1", "fp").agg(F.count_distinct("bucket").alias("buckets"))
             .where("buckets > 1").drop("buckets"))
    across = buckets.where("edge and once and not again").join(edges, ["w0", "w1", "fp"], "left_semi")
    single = (buckets.where("again and once").select("rk", "at").unionByName(across.select("rk", "at"))
              .withColumn("n", F.lit(1)))
    spans = hit.unionByName(settled).unionByName(single).groupBy("rk").agg(
        F.collect_set(F.struct("at", "n")).alias("starts"))
    spans = scratch.save(spans, "spans")
    scratch.drop(*(scratch.live - {"spans"}))
    return spans


def covered_runs(starts, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings at ``starts`` (pairs of at, n)."""
    out: list[list[int]] = []
    for at, n in sorted(starts):
        end = at + n + width - 1
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, scratch: Scratch, width: int = 200, carry: tuple[str, ...] | list[str] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: the ``carry`` columns, n_bytes, runs, kept_sha256, kept text.

    ``runs`` are the maximal removed runs (byte offsets); ``kept`` is the text
    of the characters that keep at least one byte (NULL for a NULL text). NULL and
    empty texts have no bytes; texts shorter than ``width`` lose nothing; equal rows, also under one
    id, are copies of each other, so all of their strings repeat. Other columns
    of ``docs`` are ignored.
    """
    inner = {c: f"in_{i}" for i, c in enumerate(carry)}
    docs = docs.select(*[F.col(c).alias(x) for c, x in inner.items()], "text", row_key("doc_id", "text").alias("rk"))
    spans = repeated_spans(docs.select("rk", "text"), scratch, width)
    kinds = "".join(f"{x} {docs.schema[x].dataType.simpleString()}, " for x in inner.values())

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            size, runs, sha, kept = [], [], [], []
            starts = batch.column("starts").to_pylist()
            for i in range(batch.num_rows):
                raw = data[offsets[i]:offsets[i + 1]].tobytes()
                gone = covered_runs(((x["at"], x["n"]) for x in starts[i] or ()), width)
                rest, soft, last = [], [], 0
                for a, b in gone:
                    rest.append(raw[last:a])
                    last = b
                rest.append(raw[last:])
                last = 0
                for a, b in gone:  # whole characters only
                    while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    soft.append(raw[last:a])
                    last = b
                soft.append(raw[last:])
                size.append(len(raw))
                runs.append([{"at": a, "n": b - a} for a, b in gone])
                sha.append(hashlib.sha256(b"".join(rest)).hexdigest())
                kept.append(b"".join(soft).decode("utf-8", "ignore") if batch.column("text")[i].is_valid else None)
            span = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(x) for x in inner.values()), pa.array(size, pa.int64()), pa.array(runs, span),
                pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                [*inner.values(), "n_bytes", "runs", "kept_sha256", "kept"])

    out = docs.join(spans, "rk", "left").select(*inner.values(), "text", "starts").mapInArrow(
        run, f"{kinds}n_bytes long, runs array<struct<at:long,n:long>>, kept_sha256 string, kept string")
    return out.select(*[F.col(x).alias(c) for c, x in inner.items()], "n_bytes", "runs", "kept_sha256", "kept")
