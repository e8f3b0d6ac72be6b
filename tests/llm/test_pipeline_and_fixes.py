"""The corpus pipeline from end to end, and cases in which single operators once crashed or lost rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import hamming, langid, mixing, quality
from cohortlens.llm.common import Scratch, ship_package

pipeline = pytest.importorskip("corpus_pipeline")


def written(spark, tmp_path, docs, labels, benchmark):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_run_finishes_and_keeps_clean_documents(spark, tmp_path, docs, none):
    labels = docs.where("doc_id is not null and length(text) > 40").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    bench = spark.createDataFrame([(1, "no document holds this question at all, whatever it asks about colours")], "item_id long, text string")
    odd = docs.withColumn("size", F.lit("clash")).withColumn("__row", F.lit(1))
    out = pipeline.run(spark, written(spark, tmp_path / "a", odd, labels, bench))
    rows = out.collect()
    assert {"doc_id", "text", "taken", "size", "target"} <= set(out.columns) and len(rows) > 40
    assert all(r.taken > 0 and r["size"] == len(r.text.split()) for r in rows)
    same = pipeline.run(spark, str(tmp_path / "a")).select("doc_id", "taken").collect()
    assert sorted(map(tuple, same), key=repr) == sorted(((r.doc_id, r.taken) for r in rows), key=repr)


def test_run_over_nothing(spark, tmp_path, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert pipeline.run(spark, written(spark, tmp_path / "b", none, labels, bench)).count() == 0


def test_drop_without_names_deletes_nothing(spark):
    scratch = Scratch(spark, "keep")
    kept = scratch.save(spark.range(3).toDF("x"), "t")
    scratch.drop()
    assert kept.count() == 3
    scratch.drop_all()
    assert not scratch.live


def test_language_of_letterless_labelled_rows(spark):
    ship_package(spark)
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(50)] + [(100, "", "xx"), (101, "123 456", "yy"), (102, None, "zz")]
    df = spark.createDataFrame(rows, "key long, text string, lang string").coalesce(1)
    model = langid.fit(df)
    assert model[0] == ["en"]
    out = langid.predict(df, model, ["key"]).collect()
    assert {r.lang_pred for r in out if r.key < 100} == {"en"} and {r.lang_pred for r in out if r.key >= 100} == {"und"}
    assert langid.fit(df.where("lang <> 'en'"))[0] == []


def test_language_scores_equal_plain_counts(spark):
    ship_package(spark)
    texts = [("ab ba", "x"), ("ba ba bb", "x"), ("cc ab", "y"), ("cd dc", "y")]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "key long, text string, lang string")
    langs, bits, matrix = langid.fit(df, alpha=0.5)
    counts = {x: {} for x in ("x", "y")}

    def grams(text):
        codes, _ = langid._codes([text])
        return [int(f) for order in langid.ORDERS for f in langid._features(codes, order, bits)]
    for t, lang in texts:
        for g in grams(t):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    width = len(langid.ORDERS) << bits
    total = {x: sum(c.values()) + 0.5 * width for x, c in counts.items()}
    for probe in ("ab", "cc dc", "ba zz"):
        logs = [sum(np.log((counts[x].get(g, 0) + 0.5) / total[x]) for g in grams(probe)) for x in langs]
        odds = np.exp(np.array(logs) - max(logs))
        row = langid.predict(spark.createDataFrame([(1, probe)], "key long, text string"), (langs, bits, matrix), ["key"]).first()
        assert row.lang_pred == langs[int(np.argmax(logs))] and abs(row.score - (odds / odds.sum()).max()) < 1e-5


def test_own_codes_cost_no_neighbour(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)

    def near(flips):
        v = base.copy()
        v[rng.choice(64, flips, replace=False)] *= -1
        return [float(x) for x in v]
    rows = [(20, near(1 + i % 3)) for i in range(15)] + [(1 + i, near(6 + i % 4)) for i in range(12)] + [(40, near(5))]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    codes = hamming.binary_codes(df)
    got = hamming.top_k(codes, codes.where("id % 20 = 0"), k=10).collect()
    distinct = len({r["code"] for r in codes.where("id = 20").collect()})
    assert sum(r.query_id == 20 for r in got) == 10 * distinct and sum(r.query_id == 40 for r in got) == 10
    assert all(r.id != r.query_id for r in got)
    alone = codes.where("id = 20")
    assert hamming.top_k(alone, alone, k=3).count() == 0


def test_draws_agree_after_any_repartition(spark):
    rows = [(None, f"word{i % 26} " * 5, "s", None, None) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    one, two = (mixing.mix(df.repartition(n), Scratch(spark, f"m{n}")).groupBy("text").agg(F.sum("taken").alias("t")).collect()
                for n in (1, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_sparse_products_equal_dense_ones():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    dense = np.zeros((600, quality.WIDTH), np.float32)
    for r in dense:
        r[rng.choice(quality.WIDTH, 30, replace=False)] = rng.random(30)
    row, term = np.nonzero(dense)
    cuts = pa.array(np.searchsorted(row, np.arange(601)), pa.int32())
    x = quality.SparseRows(pa.ListArray.from_arrays(cuts, pa.array(term.astype(np.int32))),
                           pa.ListArray.from_arrays(cuts, pa.array(dense[row, term])))
    m, n = rng.random((quality.WIDTH, 5), np.float32), rng.random((600, 5), np.float32)
    assert np.allclose(x.times(m), dense @ m, rtol=1e-4) and np.allclose(x.transposed_times(n), dense.T @ n, rtol=1e-4)
    assert (x.frequencies() == (dense > 0).sum(axis=0)).all()
