"""Operators on documents against brute force, with odd rows and empty tables."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import decontaminate, jaccard_join, kernels, langid, mixing, quality, suffix_dedup, token_counts
from cohortlens.llm.common import Scratch, ship_package


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) or rows[i] == rows[j]:
                up[max(root(i), root(j))] = min(root(i), root(j))
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in low[root(i)] if x is not None), default=None))
                   for i, (d, _) in enumerate(rows))


def test_jaccard_components(docs, corpus, scratch):
    got = jaccard_join.jaccard_components(docs.withColumn("node", F.lit(1)).withColumn("n", F.lit("x")), scratch)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert got == brute_components([r[:2] for r in corpus])


def test_jaccard_empty(none, scratch):
    assert jaccard_join.jaccard_components(none, scratch).count() == 0


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(2)
    for _ in range(400):
        base = rng.choice(100_000, rng.integers(1, 60), replace=False)
        a, b = (np.sort(np.concatenate((base, rng.choice(1000, rng.integers(0, 8), replace=False) + 200_000 * k)))
                for k in (1, 2))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        pa_, pb = (x[np.argsort(x * 7919 % 65_537, kind="stable")][:jaccard_join.prefix_length(len(x), 80)] for x in (a, b))
        shared = len(np.intersect1d(pa_, pb))
        for n in (len(a), len(b)):
            assert shared >= -(-n * 80 // 100) * 4 // 100 + 1


@pytest.mark.parametrize("share", [jaccard_join.HASH_SHARE, jaccard_join.RARE_SHARE])
def test_needed_prefix_tokens_are_a_lower_bound(spark, share):
    """Of linked sets of n and m tokens, prefixes share at least what the least favourable order leaves."""
    rows = [(n, m) for n in range(1, 90) for m in range(-(-n * 80 // 100), n * 100 // 80 + 1)]
    got = spark.createDataFrame(rows, "n long, m long").select(
        "n", "m", jaccard_join._needed("n", share).alias("alone"),
        jaccard_join._pair_needed("n", "m", "m", 80).alias("pair"), *[
            jaccard_join._pair_needed("n", F.greatest(F.col("m") - d, F.lit(1)), F.col("m") + d, 80).alias(f"wide{d}") for d in (3, 40)])
    for r in got.collect():
        both = -(-80 * (r.n + r.m) // 180)
        least = min(jaccard_join.prefix_length(x, 80, share) - x + both for x in (r.n, r.m))
        assert r.alone <= least
        if share == jaccard_join.RARE_SHARE:
            assert max(r.pair, r.wide3, r.wide40) <= least


def test_unlike_versions_of_a_text_do_not_ask_each_other(spark, monkeypatch):
    """Versions that share most words but never link make no comparisons by the square of their number."""
    rng = random.Random(4)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(150)], []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(150), 4):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    seen = {}

    class Counting(Scratch):
        def save(self, df, name):
            out = super().save(df, name)
            seen[name] = out.count()
            return out

    out = Counting(spark, "versions")
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), out)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)
    out.drop_all()
    assert seen["asks"] <= 2 * len(rows)


def brute_removed(rows, width=200):
    seen = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for k in range(len(raw) - width + 1):
            seen[raw[k:k + width]] += 1
    out = Counter()
    for (d, _), raw in zip(rows, raws):
        runs = []
        for k in range(len(raw) - width + 1):
            if seen[raw[k:k + width]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + width
                else:
                    runs.append([k, k + width])
        rest, last = b"", 0
        for a, b in runs:
            rest, last = rest + raw[last:a], b
        out[d, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(rest + raw[last:]).hexdigest()] += 1
    return out


def test_suffix_dedup(docs, corpus, scratch):
    out = suffix_dedup.remove_repeats(docs.withColumn("rk", F.lit(0)).withColumn("kept", F.lit("x")), scratch,
                                      carry=["doc_id", "kept", "text"]).toDF("doc_id", "x", "text", "n_bytes", "runs", "sha", "kept")
    rows = out.collect()
    got = Counter((r.doc_id, r.n_bytes, sum(x.n for x in r.runs), len(r.runs), r.sha) for r in rows)
    assert got == brute_removed([r[:2] for r in corpus])
    for r in rows:
        assert (r.kept is None) == (r.text is None)
        assert r.kept is None or set(r.kept) <= set(r.text)


def test_suffix_dedup_empty(none, scratch):
    assert suffix_dedup.remove_repeats(none, scratch).count() == 0


def test_very_long_texts_are_cut_into_pieces(spark, scratch, monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    text += text[1200:1700] + "Q"
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    at = [np.concatenate(c) for c in zip(*suffix_dedup._cells(np.frombuffer(text.encode(), np.uint8), 200))]
    assert at[0][0] == 0 and (at[0] + at[1])[-1] == len(text) - 199 and (at[0][1:] == (at[0] + at[1])[:-1]).all()


def test_multikey_quicksort_is_a_stable_sort():
    rng = np.random.default_rng(3)
    words = [rng.integers(-4, 4, 5000), rng.integers(0, 3, 5000), rng.integers(0, 50, 5000)]
    order = kernels.multikey_quicksort(words)
    assert (order == np.lexsort(words[::-1])).all()


def test_boundaries_of_buckets(spark):
    """Equal suffixes on both sides of a boundary are found whatever the splitters."""
    rows = [(1, 1, 7, i, 0, True) for i in range(40)] + [(2, 2, i, 100 + i, 0, True) for i in range(40)]
    df = spark.createDataFrame(rows, "w0 long, w1 long, fp long, rk long, at int, once boolean").repartition(4)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        out = suffix_dedup._sorted_buckets(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({r.bucket for r in out if r.w0 == 1}) > 1
    alone = [r for r in out if not r.again and r.w0 == 1]
    edges = Counter((r.w0, r.w1, r.fp) for r in {(x.w0, x.w1, x.fp, x.bucket): x for x in out if x.edge}.values())
    assert all(edges[r.w0, r.w1, r.fp] > 1 for r in alone)
    assert len({r.rk for r in out if r.w0 == 1}) == 40


def test_language_id(spark, docs, none):
    rows = [(i, ("the house and the tree " if i % 2 else "der hund und das haus ") * (i % 5 + 1), "en" if i % 2 else "de")
            for i in range(60)]
    train = spark.createDataFrame(rows, "key long, text string, lang string")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(train), ["doc_id"]).collect()
    assert len(out) == docs.count()
    assert {r.lang_pred for r in out} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in out)
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, "the tree"), (5, "das haus"), (6, "x" * 200_000)]
    out = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"),
                                                         langid.fit(train), ["doc_id"]).collect()}
    assert [out[i] for i in range(1, 6)] == ["und", "und", "und", "en", "de"] and out[6] != "und"
    nothing = langid.fit(none.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text"), nothing, ["doc_id"]).collect()} == {"und"}


def test_language_id_held_out(spark, sf_dir):
    from cohortlens.llm.queries import QUERIES
    got = QUERIES["op1_language_id"](spark, sf_dir).where("held_out")
    got = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0


def test_decontamination(spark, docs, none):
    ship_package(spark)
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    edited = item.replace("gamma", "gama").replace("theta", "tteta")
    far = " ".join(reversed(item.split()))
    rows = [(1, "before. " + item + " after"), (2, item.upper().replace(" ", "\n\t ")), (3, "pre " + edited), (4, far),
            (5, None), (6, ""), (7, item), (7, item), (8, "lead " * 4000 + item), (9, "abc " * 9000), (10, item[:50])]
    bench = spark.createDataFrame([(100, item), (100, item), (101, None), (102, "short one"), (103, "q w e r t z u i o p a s")],
                                  "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), bench, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter({(1, 100): 1, (2, 100): 1, (3, 100): 1, (7, 100): 2, (8, 100): 1})
    first = next(r for r in found if r.doc_id == 1)
    assert (first.begin, first.end, first.edits) == (8, 8 + len(item), 0)
    assert decontaminate.matches(none, bench, ["doc_id"]).count() == 0
    assert decontaminate.matches(docs, bench.where("false"), ["doc_id"]).count() == 0


def test_alignment_is_the_least_edit_distance():
    rng = np.random.default_rng(4)
    for _ in range(150):
        p, t = (rng.integers(1, 4, rng.integers(lo, 15)).astype(np.uint32) for lo in (1, 0))
        row = [0] * (len(t) + 1)
        for i in range(1, len(p) + 1):
            new = [i]
            for j in range(1, len(t) + 1):
                new.append(min(row[j - 1] + (p[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
        edits, begin, end = decontaminate.align(p[None], np.append(t, 9).astype(np.uint32), np.array([0]), np.array([len(t)]),
                                                np.array([-len(p)]), len(p) + len(t) + 1)
        assert edits[0] == min(row) and 0 <= begin[0] <= end[0] <= len(t)


def test_filter_keeps_every_region_within_the_budget():
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgh "))
    item = "".join(rng.choice(letters, 150))
    index = decontaminate.SegmentIndex([(1, item)])
    for _ in range(60):
        text = list(item)
        for _ in range(rng.integers(0, 9)):
            k = rng.integers(0, len(text))
            text[k:k + 1] = [["", "z", "zz"][rng.integers(0, 3)]]
        assert decontaminate.find(["x" * int(rng.integers(0, 300)) + " " + "".join(text) + " y"], index)


def test_token_counts(spark, docs, corpus, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    ship_package(spark)
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    out = token_counts.token_counts(docs.withColumn("n_tokens", F.lit("clash")), path, ["doc_id", "text"], 100, prefixes=True)
    for r in out.collect():
        raw = (r.text or "").encode()
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(raw), n, n > 100)
        assert r.ends[-1] == len(raw) and r.counts[-1] == n
        assert len(lib.encode(raw[:r.fits].decode("utf-8", "ignore"), add_special_tokens=False).ids) <= 100
        assert r.fits == len(raw) if n <= 100 else r.fits < len(raw)
    assert token_counts.token_counts(none, path, ["doc_id"]).count() == 0


@pytest.mark.parametrize("text", ["a<|endoftext|> b", "  two  spaces\n\n x\t\ty ", "don't I'LL we've '", "\xa0x\xa0 y　z \x1c q",
                                  "日本語 テキスト 🎉🎉", "<|endoftext|>", "   ", "x\r\ny", "١٢٣ ²³ ½", "ßß éé"])
def test_token_prefix_table(text):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    assert counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)
    for word in text.split():
        if "<" in word:
            continue
        table = counter.word_prefixes(word)
        for j in range(1, len(word) + 1):
            if len(token_counts._WORDS.findall(word[:j])) == 1:
                assert table[len(word[:j].encode())] == len(lib.encode(word[:j], add_special_tokens=False).ids)


@pytest.mark.parametrize("unit, n", [("x", 100_000), ("ACGT", 3_000), ("-=", 3_000), ("日本語の文", 700), ("word", 16), ("word", 17)])
def test_long_words(unit, n):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path("byte_bpe_50k.json")
    lib, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    encode = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(3)
    text = "".join(rng.permutation(list(unit * n)))
    total = counter.count(text)
    assert total == encode(text)
    assert all(len(w) <= 64 for w in counter.table)        # no string key for every prefix of a long word
    table = counter.word_prefixes(text)
    assert len(table) == len(text.encode()) + 1 and table[-1] == total
    for j in (1, 7, 63, 64, 65, 66, 1_000, len(text) - 1):
        assert j > len(text) or table[len(text[:j].encode())] == encode(text[:j])
    for budget in (0, 1, total // 2, total - 1, total):
        cut = counter.within(text, budget)
        assert table[cut] == budget


def test_quality(spark, docs, none):
    ship_package(spark)
    good = [(i, " ".join(f"w{i * k % 97}or" for k in range(1, 80)), 1) for i in range(40)]
    bad = [(100 + i, "BUY!! NOW!! " * 30 + "\n*** " * (i % 5), 0) for i in range(40)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string, label int")
    model = quality.fit(train.select("doc_id", "text"), train.select("doc_id", "label").union(train.select("doc_id", F.lit(None))))
    got = quality.score(train, model, ["doc_id", "label"]).collect()
    assert all(r.predicted == r.label and 0 <= r.score <= 1 for r in got)
    rest = quality.score(docs, model, ["doc_id"]).collect()
    assert len(rest) == docs.count() and all(r.predicted == int(r.score >= 0.5) for r in rest)
    assert quality.score(none, model, ["doc_id"]).count() == 0
    empty = quality.fit(none, train.select("doc_id", "label"))
    assert {r.score for r in quality.score(docs, empty, ["doc_id"]).collect()} == {0.5}


def test_lines_recur_at_every_size():
    texts = [b"same line\n" * 10_000, b"same line\n" * 3_900, b"", b"a\nb\n\nb\na", b"\n" * 5_000,
             b"".join(b"line %d\n" % i for i in range(9_000))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hashes, lo = kernels.line_hashes(data, offsets)
    for i, t in enumerate(texts):
        lines = [x + b"\n" for x in t.split(b"\n")[:-1]] + [t.split(b"\n")[-1]]
        assert lo[i + 1] - lo[i] == len(lines) and len(np.unique(hashes[lo[i]:lo[i + 1]])) == len(set(lines))
    recurrence = quality.term_vectors(data, offsets)[:, quality.TERMS + 2 * quality.BINS:quality.TERMS + 3 * quality.BINS]
    assert recurrence[0, -2:].sum() == recurrence[1, -2:].sum() == 0.5 and recurrence[5, 0] > 0.49


def test_quality_votes_are_exact():
    rng = np.random.default_rng(1)
    known, labels = quality._unit(rng.normal(size=(50, 8))), rng.integers(0, 2, 50).astype(np.float32)
    x = quality._unit(rng.normal(size=(9, 8)))
    got = quality.vote(x, (None, known, labels), k=5)
    for row, score in zip(x, got):
        near = sorted(((float(row @ k_), y) for k_, y in zip(known, labels)), reverse=True)[:5]
        w = [max(c, 0) ** 8 + 1e-9 for c, _ in near]
        assert score == pytest.approx(sum(a * y for a, (_, y) in zip(w, near)) / sum(w), rel=1e-4)


def test_mixing(docs, scratch, corpus, none):
    rows = mixing.mix(docs.withColumn("taken", F.lit("clash")).withColumn("range", F.lit(1)), scratch).collect()
    assert len(rows) == len(corpus)
    size, taken, target, own = Counter(), Counter(), {}, {}
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r.size and r["range"] == 1
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], own[r.source] = r.target, r.source_size
    assert own == dict(size)
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [5, 2, 1, 5]))
    want, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        share = {s: left * weights[s] / sum(weights[x] for x in weights if x not in capped) for s in weights if s not in capped}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            want = {s: 2 * size[s] if s in capped else share[s] for s in weights}
            break
        capped |= over
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert mixing.mix(none, scratch.__class__(docs.sparkSession, "mix-empty")).count() == 0
