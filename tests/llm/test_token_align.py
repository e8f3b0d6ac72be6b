"""Tokenizer alignment against the libraries and plain loops, with and without broadcast counts, odd rows."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import token_align as T
from cohortlens.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]

TEXTS = ["The quick brown fox jumps over the lazy dog.", "the the the the", "  two  spaces   and\ttabs \n\n new lines\r\n end ",
         "naïve café — über straße 東京タワー 🙂🙂  nbsp　wide", "<|endoftext|> <s> </s> <0x41> <unk>", "a▁b", "▁", None, "", " ",
         "12345 67890 3.14159 don't we'll it's", "x" * 3000, "{\r\n};\r\n", "\x00\x01\x1c y", "ﬁ ﬂ Å Å é",
         "Übergrößenträger Kraftfahrzeughaftpflichtversicherung"]


def brute(texts):
    """Contract columns by plain loops over whole texts encoded by the libraries."""
    t = T.load(*PATHS)
    held, rows = Counter(), []
    for x in texts:
        a = t.a.encode(" " + x, add_special_tokens=False).ids if x else []
        b = t.b.encode(x) if x else []
        whole = (" " + x).encode() if x else b""
        if not x or b"".join(t.a_bytes[i] for i in a) != whole or b"".join(t.b_bytes[i] for i in b) != whole:
            rows.append(None)
            continue
        spans = []
        for ids, of in ((a, t.a_bytes), (b, t.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(of[i])))
                at += len(of[i])
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, last = [], 0
        for end in ends:
            sides = [",".join(str(i) for i, s, e in own if s >= last and e <= end) for own in spans]
            groups.append("|".join(sides))
            last = end
        held.update(set(links))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((r[0], r[1], r[2], len(r[3]), sum(held[k] == best[k[0]] for k in r[3]), sum(held[k] for k in r[3]),
                        hashlib.sha256(r[4].encode()).hexdigest()))
    return out


def aligned(spark, scratch, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in T.align(df, scratch, *PATHS, ["doc_id"]).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("hot", [0, 20, T.HOT_PAIRS])
def test_equals_plain_loops(spark, scratch, corpus, monkeypatch, hot):
    monkeypatch.setattr(T.hot_counts, "__defaults__", (hot,))
    texts = TEXTS + [r[1] for r in corpus if not r[1] or len(r[1]) < 1500][:40] + TEXTS[:3]
    assert aligned(spark, scratch, texts) == brute(texts)


def test_parts_encode_as_the_whole_text(corpus):
    t = T.load(*PATHS)
    assert t.by_parts
    texts = [x for x in TEXTS + [r[1] for r in corpus] if x]
    parts = [T.text_parts(x) for x in texts]
    for x, aligned in zip(texts, T.Aligner(t).texts(texts)):
        a, b = t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x)
        if b"".join(t.b_bytes[i] for i in b) != (" " + x).encode():
            assert aligned is None
            continue
        groups = [g.split("|") for p in aligned for g in p[4].split(";")]
        assert [int(i) for g in groups for i in g[0].split(",")] == a
        assert [int(i) for g in groups for i in g[1].split(",")] == b
    assert all("".join(p) == " " + x for p, x in zip(parts, texts))


def test_identity_map():
    t = T.load(*PATHS)
    for i in np.flatnonzero(t.same >= 0):
        assert t.a_bytes[i] == t.b_bytes[t.same[i]]
    assert (t.same >= 0).sum() > 10_000


def test_odd_rows_and_clashing_columns(spark, scratch):
    rows = [(None, "one two"), (1, None), (1, "one two"), (1, "one two"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("n_a", F.lit(-1))
    out = T.align(df, scratch, *PATHS, df.columns, with_groups=True)
    assert out.columns == ["doc_id", "text", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    got = out.collect()
    assert len(got) == 5 and sum(r.n_links == 0 for r in got) == 2
    for r in got:
        if r.n_links:
            assert r.count_sum == 3 * r.n_links and r.n_best == r.n_links
            assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256
        else:
            assert (r.groups, r.groups_sha256, r.count_sum) == ("", "", 0)
    assert T.align(df.limit(0), Scratch(spark, "none"), *PATHS, ["doc_id"]).count() == 0


def test_long_texts(spark, scratch):
    texts = ["word " * 60_000, "y" * 200_000, ("é" * 50 + "\n") * 2_000]
    got = aligned(spark, scratch, texts)
    assert all(r[0] and r[1] and r[2] for r in got)
    assert got[0][3] >= 60_000
