import random

import pytest

pytest.importorskip("cohortlens.llm")

WORDS = [a + b for a in ("ka", "lo", "mi", "ren", "tus", "va", "zor", "pel") for b in ("", "da", "ne", "sti", "rum")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and odd rows."""
    rng = random.Random(11)
    rows, texts = [], []
    passage = prose(rng, 70)
    for i in range(60):
        texts.append(prose(rng, rng.randint(1, 200)) + (" " + passage + " " + prose(rng, 9) if i % 9 == 0 else ""))
    texts += texts[3:8] + [texts[12]] * 6                         # exact copies
    for t in texts[20:30]:                                         # near copies of one another
        w = t.split()
        for k in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "edit%d" % k
            texts.append(" ".join(v))
    texts += [None, None, "", "   \n", "one two", "ONE  Two", "é" * 150 + " " + passage, "x" * 30_000, "ab " * 9_000, "é" * 260]
    for i, t in enumerate(texts):
        rows.append((i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], len(t) if t else None))
    rows += [(5, texts[5], "en", "a", 1), (5, texts[5], "en", "a", 1), (None, texts[6], None, None, None),
             (None, "no id at all here now", "en", None, 3), (7, "another text under a taken id", "en", "a", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def scratch(spark):
    from cohortlens.llm.common import Scratch
    s = Scratch(spark, "test")
    yield s
    s.drop_all()
