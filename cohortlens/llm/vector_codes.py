"""Vector code compression: product codes with exact integer codebooks.

Every vector is cut into 16 parts. Vectors are kept in chunks; within a chunk
each part position has its own flat table, sorted along a Hilbert curve and cut
into blocks that carry a min/max box, a component sum and a size. A round never
shuffles a vector. For each block the distances from the box to all entries give
a shortlist: an entry whose least distance to the box exceeds the greatest
distance of another entry cannot be nearest to any row of it. A block with one
entry left adds its stored sum; in the others exact integer kernels compare the
rows with the shortlist only. What leaves a task is one sum a part and entry.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch

# fixed by the contract
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_VALUES = 1 << 20      # components a chunk: bounds the memory of a task
BLOCK = 16                  # rows a block
MOST_LABELS = 1 << 20       # label sums up to this many may be broadcast (16 bytes each)
_CHUNK_SCHEMA = "n int, ids array<bigint>, labels binary, parts array<struct<place:binary,rows:binary>>"


@dataclass
class Blocks:
    """One part position of a chunk: rows in Hilbert order, the place each came from, and its blocks."""
    rows: np.ndarray        # (n, d) int64
    place: np.ndarray       # (n,) int32
    low: np.ndarray         # (blocks, d)
    high: np.ndarray
    sums: np.ndarray
    sizes: np.ndarray       # (blocks,)


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place of every integer point on a Hilbert curve through the points' bounding box.

    Coordinates are scaled to as many bits as 60 bits allow for all of them (at
    most the first 60 coordinates, 10 bits each). The walk over the bits, high to
    low, swaps or inverts lower bits so that neighbouring cells stay neighbours;
    a Gray code of the result, bits interleaved, is the key.
    """
    n, d = points.shape
    dims = min(d, 60)
    bits = max(1, min(10, 60 // dims))
    low = points[:, :dims].min(axis=0) if n else np.zeros(dims, np.int64)
    span = np.maximum(points[:, :dims].max(axis=0) - low, 1) if n else np.ones(dims, np.int64)
    x = (((points[:, :dims] - low) / span) * ((1 << bits) - 1)).astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for i in range(dims):
            up = (x[i] >> b) & 1
            swap = np.where(up == 0, (x[0] ^ x[i]) & lower, 0)
            x[0] ^= np.where(up == 1, lower, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[dims - 1] >> b) & 1, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def build_blocks(rows: np.ndarray, place: np.ndarray) -> Blocks:
    """Blocks over rows that are in Hilbert order already."""
    starts = np.arange(0, len(rows), BLOCK)
    sizes = np.diff(np.append(starts, len(rows)))
    return Blocks(rows, place, np.minimum.reduceat(rows, starts), np.maximum.reduceat(rows, starts),
                  np.add.reduceat(rows, starts), sizes)


def shortlists(blocks: Blocks, book: np.ndarray) -> np.ndarray:
    """(blocks, entries) booleans: entries that may be nearest to some row of the block.

    An entry leaves if its least distance to the box exceeds another's greatest.
    It also leaves if the entry whose greatest distance is least is closer in
    every point of the box: the difference of the two squared distances is linear
    in the point, so its extreme over the box lies in a corner, found by coordinate.
    """
    low, high, at = blocks.low[:, None, :], blocks.high[:, None, :], book[None, :, :]
    gap = np.maximum(np.maximum(low - at, at - high), 0)
    reach = np.maximum(np.abs(at - low), np.abs(at - high))
    furthest = (reach * reach).sum(axis=2)
    may = (gap * gap).sum(axis=2) <= furthest.min(axis=1)[:, None]
    central = book[furthest.argmin(axis=1)][:, None, :]
    step = 2 * (at - central)
    lead = np.maximum(step * low, step * high).sum(axis=2) + (central * central).sum(axis=2) - (at * at).sum(axis=2)
    return may & (lead >= 0)


def nearest(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row the nearest entry (ties: lower index) and its squared distance; per block its only entry or -1.

    Rows of a block with one candidate are not compared; their distance stays -1.
    """
    may = shortlists(blocks, book)
    n, counts = len(blocks.rows), may.sum(axis=1)
    only = np.where(counts == 1, may.argmax(axis=1), -1)
    entry, best = np.repeat(only, blocks.sizes), np.full(n, -1, np.int64)
    order = np.argsort(~may, axis=1, kind="stable")          # candidates first, by index
    of_row = np.repeat(np.arange(len(blocks.sizes)), blocks.sizes)
    for r in range(int(counts.max(initial=0))):
        live = np.flatnonzero(np.repeat((counts > 1) & (counts > r), blocks.sizes))
        if not len(live):
            break
        candidate = order[of_row[live], r]
        gap = blocks.rows[live] - book[candidate]
        distance = np.einsum("ij,ij->i", gap, gap)
        closer = (best[live] < 0) | (distance < best[live])
        best[live[closer]], entry[live[closer]] = distance[closer], candidate[closer]
    return entry, best, only


def round_sums(blocks: Blocks, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and sizes of every entry's rows."""
    entry, _, only = nearest(blocks, book)
    sums, sizes = np.zeros_like(book), np.zeros(len(book), np.int64)
    whole = only >= 0
    np.add.at(sums, only[whole], blocks.sums[whole])
    np.add.at(sizes, only[whole], blocks.sizes[whole])
    rows = ~np.repeat(whole, blocks.sizes)
    np.add.at(sums, entry[rows], blocks.rows[rows])
    return sums, sizes + np.bincount(entry[rows], minlength=len(book))


def quantized(values: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``, refused where squared distances over a vector could leave 64 bits."""
    whole = np.floor(values.astype(np.float64) * SCALE)
    most = 2.0 ** 30 / max(1.0, np.sqrt(values.shape[1] if values.ndim == 2 else 1))
    if whole.size and np.abs(whole).max() > most:
        raise OverflowError(f"a component is beyond +-{most / SCALE:.0f}; its squared distances leave 64 bits")
    return whole.astype(np.int64)


def _write_chunk(ids: pa.Array, labels: pa.Array, points: np.ndarray) -> pa.RecordBatch:
    width = points.shape[1] // PARTS
    parts = []
    for p in range(PARTS):
        part = points[:, p * width:(p + 1) * width]
        place = np.argsort(hilbert_keys(part), kind="stable")
        parts.append({"place": place.astype("<i4").tobytes(), "rows": np.ascontiguousarray(part[place].astype("<i4")).tobytes()})
    sink = pa.BufferOutputStream()
    held = pa.record_batch([labels], ["label"])
    with pa.ipc.new_stream(sink, held.schema) as w:
        w.write_batch(held)
    kind = pa.list_(pa.struct([("place", pa.binary()), ("rows", pa.binary())]))
    return pa.record_batch([pa.array([len(points)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                            pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([parts], kind)],
                           ["n", "ids", "labels", "parts"])


def _chunk_writer(width: int):
    size = max(BLOCK, CHUNK_VALUES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size).combine_chunks()
                flat = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                yield _write_chunk(part["id"].combine_chunks(), part["label"].combine_chunks(), quantized(flat.reshape(-1, width)))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                whole = pa.Table.from_batches(held)
                full = whole.num_rows // size * size
                yield from flush(whole.slice(0, full))
                held = whole.slice(full).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))
    return run


def _read_parts(parts) -> Iterator[Blocks]:
    for part in parts:
        place = np.frombuffer(part["place"].as_buffer(), "<i4")
        rows = np.frombuffer(part["rows"].as_buffer(), "<i4").reshape(len(place), -1).astype(np.int64)
        yield build_blocks(rows, place)


def _round(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        sums, sizes = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for parts in batch.column("parts"):
                for p, blocks in enumerate(_read_parts(parts)):
                    add, count = round_sums(blocks, book[p])
                    sums[p] += add
                    sizes[p] += count
        part, entry = np.nonzero(sizes)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(sizes[part, entry], pa.int64()),
                               pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
    return run


def _encode(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        hexes = np.array([f"{i:02x}" for i in range(book.shape[1])])
        for batch in batches:
            for ids, labels, parts in zip(batch.column("ids"), batch.column("labels"), batch.column("parts")):
                n = len(ids)
                codes, error = np.empty((n, PARTS), hexes.dtype), np.zeros(n, np.int64)
                for p, blocks in enumerate(_read_parts(parts)):
                    entry, best, _ = nearest(blocks, book[p])
                    rest = np.flatnonzero(best < 0)
                    gap = blocks.rows[rest] - book[p][entry[rest]]
                    best[rest] = np.einsum("ij,ij->i", gap, gap)
                    codes[blocks.place, p] = hexes[entry]
                    error[blocks.place] += best
                joined = np.ascontiguousarray(codes).view(f"<U{2 * PARTS}").ravel()
                label = pa.ipc.open_stream(labels.as_buffer()).read_all()["label"].combine_chunks()
                yield pa.record_batch([ids.values, label, pa.array(joined), pa.array(error)], ["id", "label", "code", "error"])
    return run


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vector").isNotNull() & ~bad)


def first_books(vectors: DataFrame) -> np.ndarray | None:
    """(parts, entries, width) from the smallest ids; None if no vector is left."""
    rows = vectors.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not rows:
        return None
    width = len(rows[0]["vector"])
    if width == 0 or width % PARTS:
        raise ValueError(f"vectors of {width} components cannot be cut into {PARTS} equal parts")
    points = quantized(np.array([r["vector"] for r in rows if len(r["vector"]) == width], np.float64))
    return points.reshape(len(points), PARTS, -1).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of ``vectors(id, vector, label)`` and the codebooks: (id, label, code, error, label_error).

    A NULL vector or one with a NULL, NaN or infinite component is left out, and
    so is one whose length differs from that of the smallest id's vector. With
    fewer than 64 vectors a codebook has as many entries. Equal ids are ordered
    by vector, NULL ids are last; each of several equal rows has its own row;
    other columns are ignored. No vector: no rows and no codebooks. Lengths that
    16 does not divide are refused, as are components so large that a squared
    distance leaves 64 bits.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors.select("id", "vector", "label"))
    label_type = vectors.schema["label"].dataType.simpleString()
    out_schema = f"id bigint, label {label_type}, code string, error bigint"
    books = first_books(kept)
    if books is None:
        return spark.createDataFrame([], out_schema + ", label_error bigint"), None
    width = PARTS * books.shape[2]
    same = kept.where(F.size("vector") == width).select(F.col("id").cast("bigint").alias("id"), "vector", "label")
    chunks = scratch.save(same.mapInArrow(_chunk_writer(width), _CHUNK_SCHEMA), "chunks")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = chunks.select("parts").mapInArrow(_round(sent), "part int, entry int, n bigint, sums array<bigint>")
        # one row a task, part and entry is added up on the executors; one a part and entry comes back
        per_place = [F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(books.shape[2])]
        books = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *per_place).collect():
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(books.shape[2])]
        sent.destroy()
    sent = spark.sparkContext.broadcast(books)
    codes = scratch.save(chunks.mapInArrow(_encode(sent), out_schema), "codes")
    sent.destroy()
    scratch.drop("chunks")
    totals = scratch.save(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    if totals.count() <= MOST_LABELS:
        totals = F.broadcast(totals)
    totals = totals.withColumnRenamed("label", "of_label")
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("id", "label", "code", "error", "label_error"), books


def books_sha256(books: np.ndarray | None) -> str:
    """Hash of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()


CODES_SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id ASC NULLS LAST, embedding) AS row_no FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
cut AS (
  SELECT row_no, part, list_transform(embedding[part * w + 1:(part + 1) * w], lambda x: floor(x::DOUBLE * 256)::BIGINT) AS xs
  FROM (SELECT row_no, embedding, len(embedding) // 16 AS w FROM kept), (SELECT unnest(range(16)) AS part)),
book0 AS (SELECT part, row_no - 1 AS entry, xs FROM cut WHERE row_no <= 64),
{rounds}
final AS (
  SELECT c.row_no, c.part, min(struct_pack(d := list_sum(list_transform(list_zip(c.xs, b.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
    entry := b.entry)) AS best FROM cut c JOIN book{last} b USING (part) GROUP BY c.row_no, c.part),
coded AS (
  SELECT row_no, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY row_no),
hashed AS (
  SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{last})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256
FROM kept k JOIN coded c USING (row_no), hashed h
"""
_ROUND_SQL = """
near{k} AS (
  SELECT c.row_no, c.part, min(struct_pack(d := list_sum(list_transform(list_zip(c.xs, b.xs), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT,
    entry := b.entry)).entry AS entry FROM cut c JOIN book{before} b USING (part) GROUP BY c.row_no, c.part),
moved{k} AS (
  SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY pos) AS xs FROM (
    SELECT part, entry, pos, sum(x) AS total, count(*) AS n FROM (
      SELECT c.part, m.entry, unnest(c.xs) AS x, unnest(range(len(c.xs))) AS pos FROM cut c JOIN near{k} m USING (row_no, part))
    GROUP BY part, entry, pos) GROUP BY part, entry),
book{k} AS (SELECT b.part, b.entry, coalesce(m.xs, b.xs) AS xs FROM book{before} b LEFT JOIN moved{k} m USING (part, entry)),"""
CODES_SQL = CODES_SQL.format(rounds="".join(_ROUND_SQL.format(k=k, before=k - 1) for k in range(1, ROUNDS + 1)), last=ROUNDS)
