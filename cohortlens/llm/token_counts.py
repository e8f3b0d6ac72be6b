"""Exact token counts of byte-level BPE by dynamic programming over prefixes.

A text is cut where a run of white space starts; the tokenizer never joins
tokens across such a cut, so counts add up and one table per distinct piece
serves the whole corpus. Inside a word the table is built prefix by prefix: the
encoding of ``w[:j]`` is that of ``w[:j - len(t)]`` and its last token ``t``,
where ``t`` is the only suffix whose pair with the token before it the merges
leave as it is. The table answers how many tokens any prefix has, how far a
budget reaches and where a cut falls, without encoding again. Prefixes of short
words are remembered by their letters; a long word has its table by position, so
time and memory grow with its length.
"""
from __future__ import annotations

import json
import re
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_PIECES = 800_000     # pieces and word prefixes remembered by a worker; more only cost time
CACHE_LETTERS = 16_000_000 # letters of the pieces remembered
SHORT = 64                 # letters of a word up to which its prefixes are remembered
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# cuts are made at these characters alone; texts with other white space are one piece
_PIECE = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Token counts of every prefix under one tokenizer file (``tokenizers`` JSON, byte-level BPE)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.vocab = spec["model"]["vocab"]
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pairs: dict[tuple[str, str], bool] = {}
        # per word prefix (in vocabulary letters): token count * 2^16 + length of its last token
        self.table: dict[str, int] = {}
        # the last longer word with the token count and the length of the last token of each of its prefixes
        self.long: tuple[str, array, array] = ("", array("q"), array("i"))
        self.pieces = _Pieces(self)

    # -- inside a word
    def _stays(self, left: str, right: str) -> bool:
        """Whether the merges keep the two tokens apart."""
        known = self.pairs.get((left, right))
        if known is None:
            got = self.model.tokenize(left + right)
            known = len(got) == 2 and got[0].value == left
            if len(self.pairs) > CACHE_PIECES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def _letters(self, word: str) -> str:
        return "".join(map(self.letters.__getitem__, word.encode("utf-8")))

    def _extend(self, w: str) -> int:
        """Entries of the table for ``w`` and its prefixes; words with a known beginning go on from it."""
        table, vocab, longest, stays = self.table, self.vocab, self.longest, self._stays
        if len(table) > CACHE_PIECES:
            table.clear()
        known = len(w) - 1
        while known and w[:known] not in table:
            known -= 1
        rows = [0] + [0] * len(w)
        for j in range(1, known + 1):
            rows[j] = table.get(w[:j]) or 0
        for j in range(1, len(w) + 1):
            if rows[j]:
                continue
            for i in range(max(0, j - longest), j):
                token = w[i:j]
                if token in vocab and (not i or stays(w[i - (rows[i] & 0xFFFF):i], token)):
                    rows[j] = table[w[:j]] = rows[i] + 0x10000 - (rows[i] & 0xFFFF) + len(token)
                    break
            else:
                raise ValueError(f"no encoding of {w!r}: the vocabulary lacks a byte")
        return rows[-1]

    def _by_position(self, w: str) -> tuple[array, array]:
        """Token count and length of the last token of every prefix of a word longer than ``SHORT``."""
        if self.long[0] != w:
            vocab, longest, stays = self.vocab, self.longest, self._stays
            counts, lasts = array("q", [0]), array("i", [0])
            for j in range(1, len(w) + 1):
                for i in range(max(0, j - longest), j):
                    token = w[i:j]
                    if token in vocab and (not i or stays(w[i - lasts[i]:i], token)):
                        counts.append(counts[i] + 1)
                        lasts.append(len(token))
                        break
                else:
                    raise ValueError(f"no encoding of {w[max(0, j - longest):j]!r}: the vocabulary lacks a byte")
            self.long = w, counts, lasts
        return self.long[1:]

    def word_prefixes(self, word: str) -> list[int]:
        """Token count of every byte prefix of one pre-split word (index 0: none)."""
        w = self._letters(word)
        if len(w) > SHORT:
            return self._by_position(w)[0].tolist()
        self._extend(w)
        return [0] + [(self.table.get(w[:j]) or self._extend(w[:j])) >> 16 for j in range(1, len(w) + 1)]

    def word(self, word: str) -> int:
        w = self._letters(word)
        if len(w) > SHORT:
            return self._by_position(w)[0][-1]
        return (self.table.get(w) or self._extend(w)) >> 16

    # -- whole texts
    def parts(self, text: str):
        """(piece, whether it is one special token) in order."""
        last = 0
        for m in self.split.finditer(text) if self.split else ():
            yield from ((p, False) for p in self._cut(text[last:m.start()]))
            yield m.group(), True
            last = m.end()
        yield from ((p, False) for p in self._cut(text[last:]))

    @staticmethod
    def _cut(text: str) -> list[str]:
        if _OTHER_SPACE.search(text):
            return [text]
        return _PIECE.findall(text)

    def count(self, text: str) -> int:
        if self.split and self.split.search(text):
            return sum(1 if special else self.pieces[p] for p, special in self.parts(text))
        return sum(map(self.pieces.__getitem__, self._cut(text)))

    def prefixes(self, text: str) -> tuple[list[int], list[int]]:
        """Ends (in bytes) of the text's words and the token count up to each."""
        ends, counts, at, n = [0], [0], 0, 0
        for piece, special in self.parts(text):
            for w in [piece] if special else _WORDS.findall(piece):
                at += len(w.encode("utf-8"))
                n += 1 if special else self.word(w)
                ends.append(at)
                counts.append(n)
        return ends, counts

    def within(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix, cut between tokens, of at most ``budget`` tokens."""
        at, left = 0, budget
        for piece, special in self.parts(text):
            for w in [piece] if special else _WORDS.findall(piece):
                n = 1 if special else self.word(w)
                if n > left:
                    if special:
                        return at
                    # w splits as its last tokens say; walk back to the budget
                    return at + self._reach(w, left)
                left -= n
                at += len(w.encode("utf-8"))
        return at

    def _reach(self, word: str, budget: int) -> int:
        w, ends = self._letters(word), []
        lasts = self._by_position(w)[1] if len(w) > SHORT else None
        at = len(w)
        while at:
            ends.append(at)
            at -= lasts[at] if lasts else (self.table.get(w[:at]) or self._extend(w[:at])) & 0xFFFF
        return ends[-budget] if budget else 0


class _Pieces(dict):
    """Token count of a piece, from its words' tables when it is new."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.letters = counter, 0

    def __missing__(self, piece: str) -> int:
        n = sum(map(self.counter.word, _WORDS.findall(piece)))
        if len(piece) < 256:
            if len(self) > CACHE_PIECES or self.letters > CACHE_LETTERS:
                self.clear()
                self.letters = 0
            self[piece] = n
            self.letters += len(piece)
        return n


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter of a tokenizer file, read once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, keep: list[str], budget: int = 1024, prefixes: bool = False) -> DataFrame:
    """``keep`` columns of every row of ``docs(text, ...)`` with n_bytes, n_tokens, over_limit.

    With ``prefixes``, also ``ends`` and ``counts`` (byte ends of the text's words
    and the exact token count up to each) and ``fits`` (bytes of the longest
    prefix within the budget). NULL and empty texts have 0 tokens; special
    strings in a text are the tokenizer's special tokens. ``path`` is the place
    of the tokenizer file on every executor.
    """
    def run(batches):
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [c.count(t) for t in texts]
            cols = [batch.column(k) for k in keep] + [
                pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([x > budget for x in n], pa.bool_())]
            names = [*keep, "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                tables = [c.prefixes(t) for t in texts]
                cols += [pa.array([t[0] for t in tables], pa.list_(pa.int64())),
                         pa.array([t[1] for t in tables], pa.list_(pa.int64())),
                         pa.array([c.within(t, budget) for t in texts], pa.int64())]
                names += ["ends", "counts", "fits"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = ", ends array<long>, counts array<long>, fits long" if prefixes else ""
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(
        run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean{more}")
