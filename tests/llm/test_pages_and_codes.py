"""Operators on pages and vectors, and the pipeline."""
import gzip
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortlens.llm import hamming, html_extract, warc
from cohortlens.llm.common import Scratch, ship_package


def test_top_k_equals_brute_force(spark):
    ship_package(spark)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in rng.normal(size=24)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [(900, None), (901, []), (None, rows[1][1]), (0, rows[0][1]),
                                                          (902, [1.0, None, float("nan")])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("code_", F.lit(1))
    codes = hamming.binary_codes(df)
    got = hamming.top_k(codes, codes.where("id % 20 = 0"), k=7).collect()
    bits = {i: [x is not None and x > 0 for x in v] for i, v in rows if i is not None and v}
    want = set()
    for q in bits:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits if i != q and len(bits[i]) == len(bits[q]))
            want |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near[:7])}
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert hamming.top_k(codes.where("false"), codes.where("false")).count() == 0


def page(i, body, url="http://h.example/x"):
    return (i, url, body)


def test_main_text(spark, scratch):
    rows = [page(i, f"<html><head><title>t</title><style>p{{}}</style><script>a='</p>'</script></head><body><nav><a>m</a></nav>"
                    f"<div class=\"ad\">x</div><article><h1>Head {i}</h1><p><b>One {i}&amp;<br>two\n\n three<p>Four</article>"
                    f"<footer>&copy; f</footer>") for i in range(8)]
    rows += [(20, None, None), (21, "http://h.example/y", ""), (22, "nonsense", "plain <b>te</b>xt"), (22, "nonsense", "plain <b>te</b>xt")]
    rows += [(30 + i, f"https://s.example:80/{i}", f"<div id=top>Same site line</div><div><p>Own words {i * 7}</p></div>") for i in range(9)]
    rows += [(50, "http://z.example", "<p>" + "long " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = html_extract.main_text(df, scratch, ["page_id", "url"]).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[3] == "Head 3\nOne 3& two three\nFour"
    assert text[20] == text[21] == "" and text[22] == "plain text"
    assert text[34] == "Own words 28"                      # the repeated line of the site is gone by its entropy
    assert text[50] == ("long " * 50_000).strip()
    assert html_extract.main_text(df.where("false"), Scratch(spark, "none"), ["page_id"]).count() == 0


def test_main_text_branches():
    source = ("<header class=site>Top</header><main><article><header><h1>T</h1></header><p title=\"a>b\">One<ul><li>a<li>b</ul>"
              "<aside>s</aside><form>f</form><div class='share-box'>z</div>&#8212;&nbsp;tail</article>"
              "<section id=comments><article>c</article></section></main>")
    assert html_extract.kept_blocks(html_extract.Page(source), set()) == ["T", "One", "a", "b", "— tail"]


def test_main_text_scope():
    kept = lambda source: html_extract.kept_blocks(html_extract.Page(source), set())
    long = "The text of the page itself, which is longer than anything around it."
    assert kept(f"<div><p>{long}</p></div><aside><article>Teaser</article></aside>") == [long]
    assert kept(f"<div><p>{long}</p></div><section id=comments><article>{long * 3}</article></section>") == [long]
    assert kept(f"<div><p>{long}</p></div><article>Teaser</article>") == [long, "Teaser"]
    assert kept(f"<p>{long}</p><main>Short</main>") == [long, "Short"]
    assert kept(f"Menu<main><p>{long}</p></main>") == [long]
    assert kept(f"Menu<article><p>{long}</p></article>") == [long]
    assert kept(f"<form id=aspnetForm><div>Menu</div><p>{long}</p></form><footer>f</footer>") == ["Menu", long]
    assert kept(f"<form><article>{long}</article></form><div>{long}</div><div>Outside</div>")[0] == long
    assert kept(f"<p>{long}</p><form><p>Your mail</p></form>") == [long]
    assert kept(f"<p>{long}</p><form class=search><article>{long}</article></form>") == [long]


def test_main_text_under_a_repeated_label(spark, scratch):
    words = lambda i: f"Words of page {i * 7}"
    rows = [(i, f"http://a.example/{i}", f"<article class=post>By our staff<p>{words(i)}</p></article>") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", f"<div class=content>Published by X<p>{words(i)}</p><div class=box><b>Same</b>"
              f"<p>box</p></div></div>") for i in range(8)]
    rows += [(40 + i, f"http://c.example/{i}", f"<div class=content>Published by X<div id=p{i}>{words(i)}</div></div>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.main_text(df, scratch, ["page_id"]).collect()
    # no measured text of the third host varies, so nothing of it is boilerplate
    assert {r.page_id: r.text for r in got} == {r[0]: ("Published by X\n" if r[0] >= 40 else "") + words(r[0] % 20) for r in rows}
    tree = {(r.host, r.path): r for r in html_extract.style_tree(df.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1))).collect()}
    assert tree["b.example", "/div.content"].content < 0.2 < tree["b.example", "/div.content"].importance
    assert tree["b.example", "/div.content/div.box"].importance < 0.2


def test_warc_round_trip(spark, tmp_path):
    ship_package(spark)
    rows = [(f"http://h/{i}", "a\r\nWARC/1.1 é" * i) for i in range(5)]
    recs = [bytes(r[0]) for r in spark.createDataFrame(rows, "u string, h string").select(warc.record(F.col("u"), F.col("h"))).collect()]
    (tmp_path / "a.warc").write_bytes(b"".join(recs))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in recs))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert Counter((r.url, bytes(r.payload).decode()) for r in got) == Counter(rows * 2)
    assert {bytes(r.record) for r in got} == set(recs)


def leaves(spark, rows):
    return spark.createDataFrame(rows, "file long, offset long, leaf string")


def test_audit(spark, scratch):
    rng = np.random.default_rng(9)
    a = {(int(f), int(o)): f"h{f}-{o}" for f in range(40) for o in np.cumsum(rng.integers(1, 1 << 17, 60))}
    b = dict(a)
    keys = sorted(a)
    b[keys[5]] = "changed"
    del b[keys[77]]
    b[(3, keys[-1][1] + 10**8)] = "new"
    b[(55, 1)] = "file"
    dup = [(f, o, x) for (f, o), x in b.items()] + [(*keys[200], "second")]
    got = warc.audit(leaves(spark, [(f, o, x) for (f, o), x in a.items()]), leaves(spark, dup), scratch).collect()
    assert {(r.file, r.offset, r.kind) for r in got} == {
        (*keys[5], "altered"), (*keys[77], "missing"), (3, keys[-1][1] + 10**8, "extra"), (55, 1, "extra"), (*keys[200], "altered")}


def test_audit_of_equal_and_empty_replicas(spark):
    a = leaves(spark, [(0, 0, "x"), (0, 9, "y"), (1, 0, "z")])
    for x, y, n in ((a, a, 0), (a, a.where("false"), 3), (a.where("false"), a, 3), (a.where("false"), a.where("false"), 0)):
        assert warc.audit(x, y, Scratch(spark, "audit")).count() == n


def test_audit_of_odd_pages(spark, scratch):
    rows = [(i, None if i % 7 == 0 else f"u{i}", None if i % 5 == 0 else "<p>%d" % i) for i in range(900)] + [(1, "u1", "<p>1")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("length", F.lit("clash"))
    got = warc.audit_pages(df, scratch).collect()
    assert got and all(r.kind in ("altered", "missing", "extra") for r in got)
    assert warc.audit_pages(df.where("false"), Scratch(spark, "none")).count() == 0


def test_oracles(spark, sf_dir):
    """SQL and Spark agree for the operators that SQL can express."""
    import duckdb

    from cohortlens.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, sf_dir)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        cols = sorted(df.columns)
        assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(
            map(str, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    rng = np.random.default_rng(4)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(n))
    item, passage = prose(40), prose(60)
    good = [prose(150) for _ in range(40)]
    rows = [(i, t, "en", "s%d" % (i % 3), len(t)) for i, t in enumerate(good)]
    rows += [(100, good[0], "en", "s0", 1), (101, good[1].replace("a", "b", 1), "en", "s0", 1), (102, None, None, None, None),
             (103, prose(50) + " " + item + " " + prose(50), "en", "s1", 1), (104, prose(60) + " " + passage, "en", "s1", 1),
             (105, passage + " " + prose(60), "en", "s2", 1)] + [(200 + i, "WIN!! CASH!! " * 40, "en", "s0", 1) for i in range(20)]
    path = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("score", F.lit("clash")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(30), *range(200, 215)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        before = docs.columns
        docs = Scratch(spark, "stage").save(stage(spark, docs, path), "out")
        assert docs.columns[:len(before)] == before
        seen.append({r.doc_id: r for r in docs.collect()})
    ids = [set(x) for x in seen]
    assert not ids[0] & set(range(200, 220)) and set(range(40)) <= ids[0]
    assert not ids[1] & {100, 101} and set(range(40)) <= ids[1] and {103, 104, 105} <= ids[1]
    assert passage not in seen[2][104].text and passage not in seen[2][105].text and seen[2][104].n_chars == len(seen[2][104].text)
    assert all(seen[2][i].text == good[i] for i in range(40))
    assert 103 not in ids[3] and set(range(40)) <= ids[3]
    assert all(r.taken > 0 for r in seen[4].values())
    empty = spark.read.parquet(f"{path}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0, name


def test_formulas_stay_and_deep_pages_stay_small():
    import tracemalloc
    page = html_extract.Page("<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> ends"
                             "<annotation>E=mc^2</annotation></p><p>next</p>")
    assert [b[1] for b in page.blocks] == ["Energy E=mc2 ends", "next"]
    tracemalloc.start()
    deep = html_extract.Page("<div>" * 100_000 + "inner" + "</div>" * 100_000 + "<p>after</p>")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b[1] for b in deep.blocks] == ["inner", "after"] and peak < 100 << 20
