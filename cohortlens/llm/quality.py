"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A document is a bag of hashed terms: the shapes of its characters (letters,
capitals, digits, each other sign) in 4-grams, and how often its words, word
pairs and lines recur. Terms weighted by inverse document frequency and reduced
by a truncated singular value decomposition give its latent vector. The labelled
vectors are a bounded sample, so they are broadcast; every document is compared
with all of them in exact blocked cosine products and its nearest labels vote,
weighted by similarity.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import row_chunks, text_bytes
from cohortlens.llm.kernels import line_hashes, word_hashes

FIT_ROWS = 4_000      # documented bound on the labelled rows (the broadcast vectors)
TERMS = 4096          # hashed shape terms
BINS = 16             # bins of each recurrence measure
MEASURES = 5
DIMENSIONS = 48
NEIGHBOURS = 15
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[ord("a"):ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A"):ord("Z") + 1] = ord("A")
_CLASS[ord("0"):ord("9") + 1] = ord("0")
_CLASS[[9, 11, 12, 13]] = 32
WIDTH = TERMS + BINS * MEASURES


def _recurrence(keys: np.ndarray) -> float:
    return 1 - len(np.unique(keys)) / len(keys) if len(keys) else 1.0


def term_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term weights of every text: log-damped shares of shape terms, then recurrence bins."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    shape = _CLASS[data]
    gram = np.zeros(max(len(shape) - 3, 0), np.uint32)
    for j in range(4):
        gram = gram * np.uint32(0x01000193) ^ shape[j:j + len(gram)]
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
    words, wo = word_hashes(data, offsets)
    lines, lo = line_hashes(data, offsets)
    for i in range(len(out)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b - a >= 4:
            n = np.bincount(gram[a:b - 3], minlength=TERMS)
            out[i, :TERMS] = np.sqrt(n / (b - a - 3))
        w = words[wo[i]:wo[i + 1]]
        line = lines[lo[i]:lo[i + 1]]
        up = np.count_nonzero(shape[a:b] == ord("A")) / max(b - a, 1)
        near = np.count_nonzero(w[1:] == w[:-1]) / max(len(w) - 1, 1)
        measures = (_recurrence(w) * (BINS - 1), near * (BINS - 1),
                    (_recurrence(line) if len(line) > 1 else 0.0) * (BINS - 1),
                    np.log2(len(w) + 1), up * (BINS - 1))
        for m, value in enumerate(measures):
            low = min(int(value), BINS - 1)
            part = min(value - low, 1.0)
            out[i, TERMS + m * BINS + low] += 0.5 * (1 - part)
            out[i, TERMS + m * BINS + min(low + 1, BINS - 1)] += 0.5 * part
    return out


def _rows(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for lo, hi in row_chunks(offsets, 1 << 19):
        for a in range(lo, hi, 512):
            b = min(a + 512, hi)
            yield a, b, term_vectors(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """Projection, labelled vectors and labels from ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    About ``fit_rows`` labelled documents are used, chosen by a hash of doc_id
    (all of them if there are no more). NULL labels teach nothing; of several
    labels of one document the lowest counts, of several texts the first in
    order. Returns None if nothing is labelled.
    """
    labels = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    share = min(1.0, fit_rows / max(labels.count(), 1))
    labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the chosen labels are bounded by fit_rows, so they are broadcast and no text is shuffled before the choice
    chosen = (docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
              .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))

    def run(batches):
        for batch in batches:
            labels = batch.column("label").cast(pa.int32())
            for a, b, x in _rows(batch):
                x = x.astype(np.float16)
                row, term = np.nonzero(x)
                cuts = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [labels.slice(a, b - a), pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(cuts, pa.array(x[row, term].astype(np.float32)))], ["label", "terms", "weights"])

    rows = (chosen.select("text", "label").mapInArrow(run, "label int, terms array<int>, weights array<float>")
            .orderBy("terms", "weights").toArrow())
    if not rows.num_rows:
        return None
    x = SparseRows(rows["terms"].combine_chunks(), rows["weights"].combine_chunks())
    labels = rows["label"].to_numpy().astype(np.float32)
    idf = (np.log((len(x) + 1) / (x.frequencies() + 1)) + 1).astype(np.float32)
    x.scale(idf)
    # truncated decomposition by a seeded randomised range finder with power steps
    span = x.times(np.random.default_rng(7).standard_normal((WIDTH, DIMENSIONS + 16), dtype=np.float32))
    for _ in range(4):
        span = x.times(x.transposed_times(np.linalg.qr(span)[0]))
    q = np.linalg.qr(span)[0]
    _, values, rows_t = np.linalg.svd(x.transposed_times(q).T, full_matrices=False)
    basis = rows_t[:DIMENSIONS][values[:DIMENSIONS] > 1e-6 * max(float(values[0]), 1e-30)].T
    projection = (idf[:, None] * basis).astype(np.float32)
    return projection, _unit(x.times(basis.astype(np.float32))), labels


class SparseRows:
    """Term weights of the labelled sample; only a block of rows is ever dense."""

    BLOCK = 256

    def __init__(self, terms: pa.Array, weights: pa.Array):
        self.cuts = terms.offsets.to_numpy().astype(np.int64)
        self.terms = terms.flatten().to_numpy(zero_copy_only=False)
        self.weights = weights.flatten().to_numpy(zero_copy_only=False).copy()

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def frequencies(self) -> np.ndarray:
        """Rows that hold each term."""
        return np.bincount(self.terms, minlength=WIDTH)

    def scale(self, factors: np.ndarray) -> None:
        self.weights *= factors[self.terms]

    def _blocks(self):
        for lo in range(0, len(self), self.BLOCK):
            hi = min(lo + self.BLOCK, len(self))
            dense, cuts = np.zeros((hi - lo, WIDTH), np.float32), self.cuts[lo:hi + 1] - self.cuts[0]
            row = np.repeat(np.arange(hi - lo), np.diff(cuts))
            dense[row, self.terms[cuts[0]:cuts[-1]]] = self.weights[cuts[0]:cuts[-1]]
            yield lo, hi, dense

    def times(self, matrix: np.ndarray) -> np.ndarray:
        return np.concatenate([dense @ matrix for _, _, dense in self._blocks()])

    def transposed_times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((WIDTH, matrix.shape[1]), np.float32)
        for lo, hi, dense in self._blocks():
            out += dense.T @ matrix[lo:hi]
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def vote(vectors: np.ndarray, model, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors."""
    _, known, labels = model
    k = min(k, len(known))
    cosine = vectors @ known.T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 8 + 1e-9
    return (weight * labels[near]).sum(axis=1) / weight.sum(axis=1)


def score(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs(text, ...)`` with score (0 to 1) and predicted (0 or 1).

    NULL texts count as empty; empty texts are scored like any other by their
    recurrence and length terms. Without any labelled row every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, x in _rows(batch):
                    out[a:b] = vote(_unit(x @ model[0]), model)
            out = np.clip(out, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                [*keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, score double, predicted int")
