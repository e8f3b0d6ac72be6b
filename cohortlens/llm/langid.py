"""Language identification by multinomial naive Bayes over hashed character n-grams."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import CHUNK_BYTES

BITS = 15                  # hashed features per n-gram order
ORDERS = (2, 3)
FIT_ROWS = 20_000          # documented bound on the labelled rows a model is fitted on
MATRIX_BYTES = 64 << 20    # bound on the broadcast matrix
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased words, one space around each, and row offsets."""
    clean = [" " + _NOT_LETTER.sub(" ", t.lower()).strip() + " " for t in texts]
    raw = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    return raw, np.concatenate(([0], np.cumsum([len(t) for t in clean], dtype=np.int64)))


def _features(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Feature of the n-gram that starts at every position (the last ``order - 1`` cross the end)."""
    h = np.zeros(max(len(codes) - order + 1, 0), np.uint32)
    for j in range(order):
        h = h * np.uint32(0x01000193) ^ codes[j:j + len(h)]
        h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)) + np.uint32(ORDERS.index(order) << bits)


def _pieces(texts: list[str]):
    """Runs of texts of bounded size together."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_BYTES):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def fit(labelled: DataFrame, alpha: float = 0.5, fit_rows: int = FIT_ROWS):
    """Log-probability matrix of ``labelled(key, text, lang)``: (languages, bits, matrix).

    Fitted on about ``fit_rows`` whole rows, chosen by a hash of ``key`` (all of
    them if there are no more). Rows without a language or a letter teach nothing.
    The matrix has one column per language; hash bits are given up until it
    keeps within ``MATRIX_BYTES``, so the broadcast has a fixed bound.
    """
    labelled = labelled.where("lang is not null and text is not null")
    total = labelled.select("key").count()
    share = min(1.0, fit_rows / max(total, 1))
    chosen = labelled.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    langs = [r.lang for r in chosen.select("lang").distinct().orderBy("lang").collect()]
    bits = BITS
    while bits > 8 and len(langs) * (len(ORDERS) << bits) * 4 > MATRIX_BYTES:
        bits -= 1
    width = len(ORDERS) << bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lo, hi in _pieces(texts):
                for lang in set(labels[lo:hi]):
                    some = [t for t, x in zip(texts[lo:hi], labels[lo:hi]) if x == lang and _LETTER.search(t)]
                    codes, offsets = _codes(some)
                    for order in ORDERS:
                        f = _features(codes, order, bits)
                        for j in range(1, order):  # n-grams that cross into the next text
                            cut = offsets[1:-1] - j
                            f[cut[cut < len(f)]] = width
                        part = np.bincount(f, minlength=width + 1)[:width]
                        sums[lang] = sums[lang] + part if lang in sums else part
        for lang, total_ in sums.items():
            at = np.flatnonzero(total_)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total_[at], pa.int64())],
                ["lang", "feature", "n"])

    counts = (chosen.select("text", "lang").mapInArrow(count, "lang string, feature int, n long")
              .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())  # at most the matrix
    langs = sorted(counts.lang.unique())  # a language without a letter was not learned
    matrix = np.full((width, len(langs)), alpha)
    column = {x: i for i, x in enumerate(langs)}
    matrix[counts.feature.to_numpy(np.int64), counts.lang.map(column).to_numpy(np.int64)] += counts.n.to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=0))
    return langs, bits, matrix.astype(np.float32)


def predict(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs(text, ...)`` with lang_pred and score.

    Every whole text is scored; ``score`` is the posterior probability of the
    predicted language under equal priors. NULL texts and texts without a
    letter, and every text if no language was learned, are ``und`` with score 0.
    Ties go to the language first in order.
    """
    langs, bits, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        logs = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = [], []
            for lo, hi in _pieces(texts):
                has = [bool(langs) and _LETTER.search(t) is not None for t in texts[lo:hi]]
                codes, offsets = _codes([t if ok else "" for t, ok in zip(texts[lo:hi], has)])
                total = np.zeros((hi - lo, max(len(langs), 1)))
                for order in ORDERS:
                    f = _features(codes, order, bits)
                    starts, ends = offsets[:-1], np.maximum(offsets[1:] - order + 1, offsets[:-1])
                    for c in range(len(langs)):
                        sums = np.concatenate(([0.0], np.cumsum(logs[f, c], dtype=np.float64)))
                        total[:, c] += sums[ends] - sums[starts]
                top = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                odds = odds[np.arange(len(top)), top] / odds.sum(axis=1)
                for ok, t, p in zip(has, top.tolist(), odds.tolist()):
                    best.append(langs[t] if ok else "und")
                    score.append(min(p, 1.0) if ok else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(best, pa.string()), pa.array(score, pa.float64())],
                [*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, lang_pred string, score double")
