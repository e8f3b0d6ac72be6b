"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes.

A byte-level BPE (A) encodes a space and the text, a piece BPE (B) the text. The
byte offsets where tokens of both end cut them into groups. Links are the pairs
of tokens with overlapping bytes; a pair's count is the number of documents that
hold it.

Identity fast path: an array gives for every A id the B id of the same bytes.
Links along it are counted in one vector over A's vocabulary per task. All other
pairs come from irregular groups, are reduced to distinct pairs per document and
summed per task, and only these sums are shuffled.

Texts are encoded word by word: no A token runs from a non-space into a space and
no B piece has its space sign after another character (checked when loaded), so
both tokenizers treat the parts of a text cut before a single space on their own.
What a part gives is kept for its next occurrence.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import Scratch

SPACE_SIGN = "▁"
B_BITS = 15                     # a pair of ids is one int: A id above, B id in the low bits
KEPT_PARTS = 1 << 20            # bytes of parts whose result a worker keeps
LONG_PART = 1 << 10             # parts above this many characters are not kept
RUN = 1 << 12                   # characters of parts encoded together
PAIR_BUFFER = 1 << 20           # distinct pairs a task holds before it hands their sums on
HOT_PAIRS = 1 << 18             # pairs whose counts may be broadcast (12 bytes each)
_PART = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs the tasks side by side
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes, self.by_parts = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace(SPACE_SIGN, " ").encode())
                self.by_parts &= SPACE_SIGN not in piece.lstrip(SPACE_SIGN)
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("vocabularies too large for pairs in 31 bits")
        self.same = np.full(len(self.a_bytes), -1, np.int32)
        of_bytes: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            # a piece stands before the byte piece of the same byte
            if x and (x not in of_bytes or self.b.is_byte(of_bytes[x])):
                of_bytes[x] = i
        for i, x in enumerate(self.a_bytes):
            if x:
                self.same[i] = of_bytes.get(x, -1)
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.a_names, self.b_names = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))

    def align(self, parts: list[str]) -> list[tuple | None]:
        """Per part (tokens of A, of B, groups, links as pairs of ids, groups in writing); None where the bytes differ.

        Parts that begin with one space and end with another character are encoded
        in runs, because no token crosses from one into the next; a run whose
        tokens do not give its parts back is encoded part by part.
        """
        runs, own, size = [], [], 0
        for i, p in enumerate(parts):
            if not self.by_parts or p[-1].isspace() or p[1:2].isspace() or len(p) > RUN:
                runs.append([i])
            else:
                if size + len(p) > RUN and own:
                    runs.append(own)
                    own, size = [], 0
                own.append(i)
                size += len(p)
        out: list[tuple | None] = [None] * len(parts)
        for again in self._align_runs(parts, runs + [own] * bool(own), out):
            self._align_runs(parts, [[i] for i in again], out)
        return out

    def _align_runs(self, parts: list[str], runs: list[list[int]], out: list[tuple | None]) -> list[list[int]]:
        """Align all parts of the runs into ``out``; returns the runs that did not come back whole."""
        texts = ["".join([parts[i] for i in run]) for run in runs]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([x[1:] for x in texts], num_threads=1)
        failed, good = [], []
        for k, run in enumerate(runs):
            whole = texts[k].encode()
            if b"".join([self.a_bytes[i] for i in a[k]]) == whole == b"".join([self.b_bytes[i] for i in b[k]]):
                good.append(k)
            elif len(run) > 1:
                failed.append(run)
        if not good:
            return failed
        who = [i for k in good for i in runs[k]]
        ids_a, ids_b = (np.array([i for k in good for i in x[k]], np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        ends = np.cumsum([len(parts[i].encode()) for i in who])
        first = np.searchsorted(end_b, end_a - self.a_length[ids_a], side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        times = last - first + 1
        upto = np.cumsum(times)
        other = np.arange(upto[-1]) - np.repeat(upto - times, times) + np.repeat(first, times)
        links = (np.repeat(ids_a, times) << B_BITS | ids_b[other]).astype(np.int32)
        closes = np.flatnonzero(end_b[last] == end_a)           # A tokens that end a group
        cut_a, cut_b = closes + 1, last[closes] + 1
        part_a, part_b = np.searchsorted(end_a, ends) + 1, np.searchsorted(end_b, ends) + 1
        part_group = np.searchsorted(end_a[closes], ends) + 1
        part_link = upto[part_a - 1]
        word_a, word_b = [self.a_names[i] for i in ids_a.tolist()], [self.b_names[i] for i in ids_b.tolist()]
        groups, i, j = [], 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist()):
            left = word_a[i] if x == i + 1 else ",".join(word_a[i:x])
            groups.append(left + "|" + (word_b[j] if y == j + 1 else ",".join(word_b[j:y])))
            i, j = x, y
        i = j = g = n = 0
        for w, x, y, h, m in zip(who, part_a.tolist(), part_b.tolist(), part_group.tolist(), part_link.tolist()):
            out[w] = (x - i, y - j, h - g, links[n:m], groups[g] if h == g + 1 else ";".join(groups[g:h]))
            i, j, g, n = x, y, h, m
        return failed


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def text_parts(text: str) -> list[str]:
    """A space and the text, cut before single spaces between other characters."""
    return _PART.split(" " + text)


class Aligner:
    """Aligns texts, remembering the parts they share.

    Two tables of bounded size: parts seen lately, and those of the table before,
    from which a part that occurs again moves over.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.t, self.known, self.older, self.held = tokenizers, {}, {}, 0

    def texts(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """Aligned parts of every text; None for NULL, empty and texts whose bytes differ."""
        split = [(text_parts(x) if self.t.by_parts else [" " + x]) if x else None for x in texts]
        if self.held > KEPT_PARTS:
            self.known, self.older, self.held = {}, self.known, 0
        known = self.known
        missing = set().union(*[x for x in split if x]).difference(known)
        again = missing & self.older.keys()
        known.update({p: self.older[p] for p in again})
        new = list(missing - again)
        known.update(zip(new, self.t.align(new)))
        out = []
        for parts in split:
            aligned = [known[p] for p in parts] if parts else None
            out.append(None if aligned is None or None in aligned else aligned)
        for p in [p for p in new if len(p) > LONG_PART]:
            del known[p]
            missing.discard(p)
        self.held += sum(map(len, missing))
        return out


_DOC = ("row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<int>, times array<int>")


def _documents(path_a: str, path_b: str, carry: list[str], with_groups: bool):
    """Arrow batches of (text, carry...) to the carried columns and _DOC: one row a document, its pairs distinct."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = Aligner(load(path_a, path_b)), TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            at = 0
            while at < batch.num_rows:
                stop, total = at, 0
                while stop < batch.num_rows and (stop == at or total + sizes[stop] <= 1 << 20):
                    total += sizes[stop]
                    stop += 1
                part = batch.slice(at, stop - at)
                at = stop
                counts, hashes, pairs, times, offsets, groups = [], [], [], [], [0], []
                for aligned in aligner.texts(part.column("text").to_pylist()):
                    if aligned is None:
                        counts.append((0, 0, 0, 0))
                        hashes.append("")
                        groups.append("")
                    else:
                        n_a, n_b, n_groups, links, writings = zip(*aligned)
                        links = np.concatenate(links)
                        distinct, n = np.unique(links, return_counts=True)
                        pairs.append(distinct)
                        times.append(n)
                        counts.append((sum(n_a), sum(n_b), sum(n_groups), len(links)))
                        written = ";".join(writings)
                        hashes.append(hashlib.sha256(written.encode()).hexdigest())
                        groups.append(written if with_groups else "")
                    offsets.append(offsets[-1] + (len(pairs[-1]) if aligned is not None else 0))
                numbers = np.array(counts, np.int64).reshape(-1, 4)
                cut = pa.array(offsets, pa.int32())
                flat = [pa.array(np.concatenate(x).astype(np.int32) if x else [], pa.int32()) for x in (pairs, times)]
                columns = [part.column(c) for c in carry] + [pa.array(np.arange(row, row + part.num_rows))]
                columns += [pa.array(numbers[:, i]) for i in range(4)] + [pa.array(hashes, pa.string())]
                columns += [pa.ListArray.from_arrays(cut, x) for x in flat]
                row += part.num_rows
                names = [*carry, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if with_groups:
                    columns, names = columns + [pa.array(groups, pa.string())], names + ["groups"]
                yield pa.record_batch(columns, names)
    return run


def _pair_sums(same: np.ndarray):
    """Batches of distinct pairs per document to (pair, n): identity pairs by vector, others in sorted runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(same), np.int64)
        held, waiting = [], 0

        def handed(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(pairs.astype(np.int32)), pa.array(n.astype(np.int64))], ["pair", "n"])

        def flush():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                yield handed(pairs[at:at + (1 << 16)], n[at:at + (1 << 16)])

        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            regular = same[pairs >> B_BITS] == (pairs & ((1 << B_BITS) - 1))
            vector += np.bincount(pairs[regular] >> B_BITS, minlength=len(same))
            held.append(pairs[~regular])
            waiting += len(held[-1])
            if waiting >= 4 * PAIR_BUFFER:
                yield from flush()
                held, waiting = [], 0
        if waiting:
            yield from flush()
        ids = np.flatnonzero(vector)
        yield handed(ids << B_BITS | same[ids], vector[ids])
    return run


def _totals(sent):
    """Batches of (row, n_a, ..., pairs, times) to sums over links whose count is at hand, and the other links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            document = np.repeat(np.arange(len(sizes)), sizes)
            place = np.minimum(np.searchsorted(codes, pairs), max(len(codes) - 1, 0))
            known = codes[place] == pairs if len(codes) else np.zeros(len(pairs), bool)
            count = np.where(known, counts[place] if len(codes) else 0, 0)
            sums, top = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(sums, document, count * times)
            np.add.at(top, document, times * (known & (count == best[pairs >> B_BITS])))
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(np.bincount(document[~known], minlength=len(sizes)), out=offsets[1:])
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[~known])) for x in (pairs, times)]
            yield pa.record_batch([batch.column("row"), pa.array(sums), pa.array(top), *rest], ["row", "sums", "top", "pairs", "times"])
    return run


def pair_counts(documents: DataFrame, same: np.ndarray, scratch: Scratch) -> DataFrame:
    """(pair, n): number of documents that hold each pair of ids, over rows with distinct ``pairs``."""
    sums = documents.select("pairs").mapInArrow(_pair_sums(same), "pair int, n long")
    return scratch.save(sums.groupBy("pair").agg(F.sum("n").alias("n")), "counts")


def hot_counts(counts: DataFrame, limit: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and counts above the smallest power of two that at most ``limit`` pairs reach."""
    size = F.floor(F.log2("n")).cast("int")
    of_size = sorted(((r["size"], r["pairs"]) for r in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("pairs")).collect()),
                     reverse=True)
    least, total = None, 0
    for power, pairs in of_size:
        total += pairs
        if total > limit:
            break
        least = power
    if least is None:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    rows = counts.where(F.col("n") >= F.lit(1 << least)).orderBy("pair").toArrow()
    return rows["pair"].to_numpy(), rows["n"].to_numpy()


def align(docs: DataFrame, scratch: Scratch, path_a: str, path_b: str, carry: list[str], with_groups: bool = False) -> DataFrame:
    """Rows of ``docs(text, ...)`` with ``carry`` and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` is the number of links whose count is the highest of their A id
    (ties included), ``count_sum`` the sum of counts over links; ``with_groups``
    adds the groups in writing. NULL and empty texts, and texts whose tokens do
    not give back the bytes of space and text (such as those with U+2581), have
    zeros and an empty hash and count for no pair. Equal rows are documents of
    their own; carried columns of a new name are replaced.

    Counts of the most frequent pairs, at most HOT_PAIRS of them, are broadcast;
    links of all rarer pairs meet their counts in a join by pair, in which no
    pair is frequent.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    carry = [c for c in carry if c not in new]
    rows = docs.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)], F.col("text").alias("text"))
    inner = rows.columns[:-1]
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + _DOC + ", groups string" * with_groups
    documents = scratch.save(rows.mapInArrow(_documents(path_a, path_b, inner, with_groups), schema), "documents")
    spark, tokenizers = docs.sparkSession, load(path_a, path_b)
    counts = pair_counts(documents, tokenizers.same, scratch)
    best = np.zeros(len(tokenizers.a_bytes), np.int64)         # bounded by the vocabulary
    of_a = F.shiftright("pair", B_BITS)
    for r in counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = r["n"]
    sent = spark.sparkContext.broadcast((*hot_counts(counts), best))
    summed = documents.select("row", "pairs", "times").mapInArrow(
        _totals(sent), "row long, sums long, top long, pairs array<int>, times array<int>")
    summed = scratch.save(summed, "sums")
    sent.destroy()
    # rare links: the count of a pair is joined, the best count of its A id is an aggregate of the vocabulary's size
    tops = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("best"))
    rare = (summed.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
            .select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")))
    rare = (rare.join(counts, "pair").withColumn("a", of_a).join(F.broadcast(tops), "a").groupBy("row")
            .agg(F.sum(F.col("n") * F.col("times")).alias("rare_sum"),
                 F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("rare_top")))
    out = (documents.drop("pairs", "times").join(summed.select("row", "sums", "top"), "row").join(rare, "row", "left")
           .withColumn("n_best", F.col("top") + F.coalesce("rare_top", F.lit(0)))
           .withColumn("count_sum", F.col("sums") + F.coalesce("rare_sum", F.lit(0))))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(carry)], *new)
