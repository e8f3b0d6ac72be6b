"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark items are normalised (lower case, white space runs as one space) and
cut into overlapping segments. A segment of n characters that lies in a document
within e edits shares at least ``n + 1 - q * (e + 1)`` of its q-grams with it, on
diagonals no more than e apart. Shared q-grams are counted in overlapping
diagonal bands, so every such alignment falls into one band whole; bands that
reach the bound are kept and verified by banded alignment. Nothing that meets
the edit budget is missed.

The benchmark goes to the executors in blocks of a fixed size, one pass over the
documents each, so the broadcast does not grow with it.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
SEGMENT = 96              # characters of a segment; items no longer are one segment
STRIDE = 48
LEAST = 24                # items of fewer normalised characters are not searched for
BLOCK_CHARS = 2_000_000   # benchmark characters broadcast at once
CHUNK_CHARS = 1 << 18
_SPACE = np.zeros(0x3002, bool)
_SPACE[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True


def edit_budget(n: int) -> int:
    """Edits allowed in a segment of n characters: a tenth, as far as the lemma still filters."""
    return max(min(n // 10, n // Q - 1), 0)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of the texts with a 0 after each, the place of each code point
    in the texts so joined, and where each text begins and the last one ends."""
    joined = "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    codes = np.frombuffer(_lower(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(codes, 0x3001)]
    keep = ~space
    keep[1:] |= ~space[:-1]
    place = np.flatnonzero(keep)
    codes = np.where(space, np.uint32(32), codes)[place]
    return codes, place, np.concatenate(([0], np.flatnonzero(codes == 0) + 1))


def segments(items) -> list[tuple[int, np.ndarray]]:
    """(index of the item, code points) of every segment of (id, text) items."""
    out = []
    for i, (_, text) in enumerate(items):
        codes = normalise([(text or "").strip()])[0][:-1]
        n = len(codes)
        if n < LEAST:
            continue
        starts = list(range(0, max(n - SEGMENT, 0), STRIDE)) + [max(n - SEGMENT, 0)]
        out += [(i, codes[s:s + SEGMENT]) for s in sorted(set(starts))]
    return out


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 code points at every position, by doubling."""
    h, step = codes.astype(np.uint64), 1
    while step < Q:
        n = max(len(h) - step, 0)
        h = (h[:n] * np.uint64(0x9E3779B97F4A7C15) + h[step:step + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
        step *= 2
    return h


class SegmentIndex:
    """q-grams of a block of benchmark segments, sorted by hash."""

    def __init__(self, items):
        self.items = [i for i, _ in items]
        found = segments(items)
        self.owner = np.array([i for i, _ in found], np.int64)
        self.codes = [c for _, c in found]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array([edit_budget(int(n)) for n in sizes], np.int64)
        self.least = np.maximum(sizes + 1 - Q * (self.budget + 1), 1)
        hashes = [_grams(c) for c in self.codes]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        seg = np.repeat(np.arange(len(found)), [len(x) for x in hashes]) if hashes else np.empty(0, np.int64)
        off = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.seg, self.off = h[order], seg[order], off[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, segment, offset) of every shared q-gram."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.hash, grams[at])
        n = np.searchsorted(self.hash, grams[at], side="right") - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(lo, n) + rank
        return np.repeat(at, n), self.seg[entry], self.off[entry]

    def regions(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first diagonal, last diagonal) of every band with enough shared q-grams."""
        at, seg, off = self.hits(grams)
        if len(at):
            some = np.bincount(seg, minlength=len(self.least)) >= self.least
            at, seg, off = (x[some[seg]] for x in (at, seg, off))
        width = self.budget[seg] + 1
        band = (at - off + (1 << 20)) // width
        # bands are two widths wide and start every width: a hit lies in two of them;
        # a q-gram of the segment counts once a band, however often the text repeats it
        key = seg << 40 | band << 8
        key = np.sort(np.concatenate((key | off, key - (1 << 8) | off)))
        key = key[np.diff(key, prepend=-1) != 0] >> 8
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[edge], np.diff(edge, append=len(key))
        seg, band = key >> 32, key & ((1 << 32) - 1)
        good = count >= self.least[seg]
        seg, band = seg[good], band[good]
        width = self.budget[seg] + 1
        first = band * width - (1 << 20)
        return seg, first, first + 2 * width - 1


def align(patterns: np.ndarray, text: np.ndarray, lo: np.ndarray, hi: np.ndarray,
          first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edits of each pattern against any stretch of its part of ``text``, and that stretch.

    Pattern k (rows of equal length) is aligned with ``text[lo[k]:hi[k]]`` on
    the ``width`` diagonals from ``first[k]`` on, all patterns at once: cell j of
    a row stands for text position ``row + first + j``. Returns (edits, begin, end).
    """
    n = patterns.shape[1]
    base = 1 << 32
    big = 1 << 62
    j = np.arange(width)
    begin = first[:, None] + j
    lo, hi = lo[:, None], hi[:, None]
    # edits packed above the negated begin, so the least edits with the latest begin win
    row = np.where((begin >= lo) & (begin <= hi), lo - begin, big)
    edge = np.full((len(patterns), 1), big)
    for i in range(n):
        place = begin + i
        inside = (place >= lo) & (place < hi)
        char = text[np.clip(place, 0, len(text) - 1)]
        step = np.where(inside, row + np.where(char == patterns[:, i:i + 1], 0, base), big)
        drop = np.concatenate((row[:, 1:], edge), axis=1) + base  # a pattern character without a text character
        ends = (place + 1 >= lo) & (place + 1 <= hi)
        row = np.where(ends, np.minimum(step, drop), big)
        # text characters without a pattern character
        row = np.minimum.accumulate(row - j * base, axis=1) + j * base
        row = np.where(ends, row, big)
    best = row.argmin(axis=1)
    least = row[np.arange(len(best)), best]
    edits = -(-least // base)
    return edits, lo[:, 0] + edits * base - least, first + n + best


def _verified(codes: np.ndarray, offsets: np.ndarray, index: SegmentIndex):
    """(segment, text, edits, begin, end) of every alignment within its budget, in places of that text."""
    seg, first, last = index.regions(_grams(codes))
    # a band may touch two texts: each is aligned on its own
    size = np.array([len(c) for c in index.codes], np.int64)[seg] if len(seg) else seg
    a = np.searchsorted(offsets, np.maximum(first, 0), side="right") - 1
    b = np.searchsorted(offsets, np.clip(last + size, 0, len(codes) - 1), side="right") - 1
    n = np.maximum(b - a + 1, 0)
    doc = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    seg, first, size = (np.repeat(x, n) for x in (seg, first, size))
    for length in np.unique(size):
        some = np.flatnonzero((size == length) & (doc < len(offsets) - 1))
        for part in (some[k:k + 256] for k in range(0, len(some), 256)):
            s, d = seg[part], doc[part]
            patterns = np.stack([index.codes[x] for x in s])
            edits, begin, end = align(patterns, codes, offsets[d], offsets[d + 1] - 1, first[part],
                                      2 * (edit_budget(int(length)) + 1))
            good = edits <= index.budget[s]
            yield from zip(s[good].tolist(), d[good].tolist(), edits[good].tolist(),
                           (begin - offsets[d])[good].tolist(), (end - offsets[d])[good].tolist())


def find(texts: list[str], index: SegmentIndex) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, begin, end, edits, segments) of every item found in every text.

    ``begin`` and ``end`` span the found segments in characters of the text;
    ``edits`` are the fewest of any of them.
    """
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK_CHARS):
            size += len(texts[hi]) + 1
            hi += 1
        codes, place, offsets = normalise(texts[lo:hi])
        origin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])))
        found: dict[tuple[int, int], list[int]] = {}
        for seg, doc, edits, begin, end in _verified(codes, offsets, index):
            have = found.setdefault((doc, int(index.owner[seg])), [begin, end, edits, set()])
            have[0], have[1], have[2] = min(have[0], begin), max(have[1], end), min(have[2], edits)
            have[3].add(seg)
        for (doc, item), (begin, end, edits, segs) in sorted(found.items()):
            spot = place[offsets[doc] + np.array([begin, end - 1])] - origin[doc]
            out.append((lo + doc, item, int(spot[0]), int(spot[1]) + 1, edits, len(segs)))
        lo = hi
    return out


def matches(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of ``docs(text, ...)`` and item of ``benchmark(item_id, text)`` found in it.

    ``keep`` columns of docs, then item_id, begin, end (characters of the text),
    edits, segments. NULL and empty texts match nothing; repeated items give one
    row per distinct (item_id, text); items shorter than ``LEAST`` normalised
    characters are not searched for; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"{kinds}, item_id {item_kind}, begin long, end long, edits int, segments int"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        shared = spark.sparkContext.broadcast(SegmentIndex([(r.item_id, r.text) for r in part.collect()]))
        found = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_search(shared, keep, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(shared, keep: list[str], schema: str):
    def run(batches):
        index = shared.value
        ids = pa.array(index.items) if index.items else None
        for batch in batches:
            found = find([t or "" for t in batch.column("text").to_pylist()], index) if index.items else []
            if not found:
                continue
            row, item, begin, end, edits, n = (pa.array(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(row) for c in keep]
                + [ids.take(item), begin.cast(pa.int64()), end.cast(pa.int64()), edits.cast(pa.int32()), n.cast(pa.int32())],
                [*keep, "item_id", "begin", "end", "edits", "segments"])
    return run
