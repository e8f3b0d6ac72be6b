"""Vector codes: integer codebooks against plain loops, shortlists, the Hilbert walk, odd rows."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import vector_codes as V
from cohortlens.llm.common import Scratch

SCHEMA = "id long, vector array<float>, label int"


def brute(rows):
    """{row place: (code, error)} and codebooks by plain loops."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda e: (e[1][0] is None, e[1][0] or 0, e[1][1]))
    points = [[math.floor(float(np.float32(x)) * 256) for x in r[1]] for _, r in kept]
    w = len(points[0]) // 16
    parts = [[p[k * w:(k + 1) * w] for p in points] for k in range(16)]
    books = [part[:64] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(2):
        for k in range(16):
            own = [near(x, books[k])[1] for x in parts[k]]
            moved = list(books[k])
            for j in range(len(moved)):
                mine = [x for x, o in zip(parts[k], own) if o == j]
                if mine:
                    moved[j] = [sum(c) // len(mine) for c in zip(*mine)]
            books[k] = moved
    out = {}
    for n, (i, _) in enumerate(kept):
        best = [near(parts[k][n], books[k]) for k in range(16)]
        out[i] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best))
    return out, np.array(books)


def vectors(n, width, seed, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(7)]
    return [[float(np.float32(c + rng.gauss(0, spread / 3))) for c in rng.choice(centres)] for _ in range(n)]


def check(spark, scratch, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, books = V.compress(df, scratch)
    want, want_books = brute(rows)
    assert books.tolist() == want_books.tolist()
    by_label = {}
    for i, (_, error) in want.items():
        by_label[rows[i][2]] = by_label.get(rows[i][2], 0) + error
    expect = sorted(((rows[i][0], rows[i][2], code, error, by_label[rows[i][2]]) for i, (code, error) in want.items()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == expect


@pytest.mark.parametrize("width", [16, 32, 48])
def test_equals_plain_loops(spark, scratch, width):
    data = vectors(300, width, width)
    rows = [(i * 3 % 300, v, [None, 0, 0, 0, 1][i % 5]) for i, v in enumerate(data)]
    check(spark, scratch, rows)


def test_ties_copies_and_odd_rows(spark, scratch):
    data = vectors(90, 16, 5)
    rows = [(i, v, 1) for i, v in enumerate(data)] + [(i, data[0], None) for i in range(100, 150)]
    rows += [(7, data[3], 2), (7, data[3], 2), (None, data[4], 2), (None, data[4], 2)]
    rows += [(200, None, 1), (201, data[1][:-1] + [None], 1), (202, data[1][:-1] + [float("nan")], 1),
             (203, data[1][:-1] + [float("inf")], 1), (-5, [0.5] * 16, 3), (-4, [0.5] * 16, 3), (-3, [-0.001] * 16, 3)]
    check(spark, scratch, rows)


def test_few_vectors(spark, scratch):
    check(spark, scratch, [(i, v, 0) for i, v in enumerate(vectors(5, 32, 1))])


def test_other_lengths_empty_table_and_clashing_columns(spark, scratch):
    rows = [(1, [0.1] * 32, 0), (2, [0.1] * 16, 0), (3, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("n", F.lit(1))
    out, books = V.compress(df, scratch)
    assert [r.id for r in out.collect()] == [1] and books.shape == (16, 1, 2)
    out, books = V.compress(df.limit(0), Scratch(spark, "none"))
    assert out.count() == 0 and books is None and len(V.books_sha256(books)) == 64
    assert out.columns == ["id", "label", "code", "error", "label_error"]
    with pytest.raises(ValueError):
        V.compress(spark.createDataFrame([(1, [0.1] * 17, 0)], SCHEMA), Scratch(spark, "odd"))


def test_too_large_components_are_refused():
    with pytest.raises(OverflowError):
        V.quantized(np.array([[1e30, 0.0]]))


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(3)
    points = rng.integers(-60, 60, (20_000, 4))
    points = points[np.argsort(V.hilbert_keys(points), kind="stable")]
    book = np.concatenate([rng.integers(-60, 60, (60, 4)), points[:4]])
    book[10] = book[3]
    blocks = V.build_blocks(points, np.arange(len(points), dtype=np.int32))
    distance = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    entry, best, only = V.nearest(blocks, book)
    assert (entry == distance.argmin(axis=1)).all()
    assert (best[best >= 0] == distance.min(axis=1)[best >= 0]).all()
    # blocks are compact enough for the boxes to rule entries out
    assert V.shortlists(blocks, book).mean() < 0.25
    sums, sizes = V.round_sums(blocks, book)
    assert sizes.sum() == len(points) and (sums.sum(axis=0) == points.sum(axis=0)).all()


def test_hilbert_walk_moves_one_step_at_a_time():
    side = 8
    grid = np.array([(x, y) for x in range(side) for y in range(side)])
    # the full box maps to the full range of 10 bits a coordinate, so compare cells of equal size
    key = V.hilbert_keys(grid)
    walk = grid[np.argsort(key)]
    assert len(set(key.tolist())) == side * side
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).mean() > 0.7
    cube = V.hilbert_keys(np.random.default_rng(1).integers(0, 1000, (500, 70)))
    assert len(cube) == 500 and (cube >= 0).all()
